"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the
columns of `documents`. `run` writes each stage's rows to the shared folder and goes on from
there, so a lost executor costs a part of one stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.llm import decontaminate, jaccard, language, packing, pseudonyms
from tabshift.llm.common import checked_broadcast, fresh, load, written
from tabshift.llm.queries import language_model, pseudonym_key


NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Text bytes packed at once: small, as the executors still hold what the Jaccard stage took.
PACKED_BYTES = 1 << 20


def _counted(docs: DataFrame) -> DataFrame:
    """`n_chars`, where there is one, follows a changed text; a null text keeps its value."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown go: null or without a letter."""
    guess = fresh(docs.columns, "lang_pred", "score", "languages", "shares")
    found = language.identify(docs, language_model(docs), names=tuple(guess))
    return found.filter(F.col(guess[0]) != language.UNKNOWN).drop(*guess)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near duplicates: five-word shingles, similarity 0.8. One document of each component
    stays: the least id, then the least text hash; of repeated rows any one. Texts without
    words link with nothing and stay."""
    key, repeated = fresh(docs.columns, "key", "key_again")
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    texts = docs.select(own.alias(key), "text")
    found = written(jaccard.jaccard_components(texts, id=key, size=NEAR_WORDS, percent=NEAR_PERCENT))
    linked = found.filter("n_shingles > 0").select(F.col(key).alias(repeated), F.col(key).eqNullSafe(F.col("component_id")).alias("first"))
    gone = written(linked.filter(~F.col("first")).select(repeated).distinct())
    again = written(linked.filter("first").groupBy(repeated).count().filter("count > 1").select(repeated))

    def same() -> Column:
        mine, other = F.col(key), F.col(repeated)
        return mine["id"].eqNullSafe(other["id"]) & (mine["h"] == other["h"])

    keyed = docs.withColumn(key, own)
    kept = keyed.join(checked_broadcast(gone), same(), "left_anti")
    once = kept.join(checked_broadcast(again), same(), "left_anti")
    more = kept.join(checked_broadcast(again), same(), "left_semi").dropDuplicates([key])
    return once.union(more).drop(key)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every benchmark window is cut out of the texts."""
    return _counted(decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark")))


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to pseudonyms of the same format."""
    (spans,) = fresh(docs.columns, "private")
    return _counted(pseudonyms.pseudonymise(docs, key=pseudonym_key(spark), found=spans).drop(spans))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their places in sequences."""
    return packing.pack(docs, slice_bytes=PACKED_BYTES)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", remove_benchmark),
    ("PII", replace_private),
    ("best-fit packing", pack_sequences),
]

#: Learned language models, ciphers and a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
