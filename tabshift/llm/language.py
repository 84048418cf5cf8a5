"""Language mixtures of documents by expectation-maximisation.

A language is a model of byte trigrams inside words: p(byte | two bytes before), learned from
labelled documents. The unit of a mixture is the word. For a document, EM estimates the share
of words of each language; language sets grow from the best single one along those shares,
and the set with the best penalised likelihood (log n / 2 for each further language) wins.
The prediction is the largest share. All documents of a slice go through EM at once.

At most `SAMPLE_PER_LANGUAGE` labelled documents of a language are learned from (a documented
bound of the classifier, chosen by a hash of the id); all documents are scored, whole.

Defined cases: a null text or one without a letter is `und` with score 0; without labelled
rows every document is `und`; repeated rows get equal rows; documents whose label is null
are scored, not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.llm.common import column, fresh, map_arrow, slices
from tabshift.llm.text import Words, words

SAMPLE_PER_LANGUAGE = 4000
UNKNOWN = "und"
BUCKETS = 1 << 16
SMOOTHING = 0.05
EM_ROUNDS = 6
#: A byte of text needs some hundred bytes of numbers here.
SLICE_BYTES = 1 << 20
ALPHABET = 64  # bytes that may follow a pair, for smoothing

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # log p by trigram bucket, before the pair's total
    pairs: np.ndarray  # log of the smoothed total of each pair


@dataclass
class Grams:
    words: Words
    first: np.ndarray  # first gram of each word
    triple: np.ndarray
    pair: np.ndarray


def grams(texts: pa.Array) -> Grams:
    """Trigram buckets and leading pairs of all words, one for each byte and one at the end."""
    w = words(pc.utf8_lower(texts.cast(pa.large_string()).fill_null("")), _LETTER, lower=False)
    size = w.ends - w.starts + 1
    first = np.cumsum(size) - size
    at = np.arange(size.sum()) + np.repeat(w.starts - first, size)
    bytes_ = np.append(w.data, np.uint8(0x20)).astype(np.uint32)
    gram = bytes_[at]
    gram[first + size - 1] = 0x20
    one, two = np.roll(gram, 1), np.roll(gram, 2)
    one[first] = 0x20
    two[first] = 0x20
    two[first + 1] = 0x20  # a word has a byte and an end at least
    pair = two << 8 | one
    triple = ((pair << 8 | gram) * np.uint32(2654435761)) >> np.uint32(16)
    return Grams(w, first, triple, pair)


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """`labelled`: id, text, lang."""
    rows = labelled.filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((BUCKETS, 0), np.float32))
    number = {n: k for k, n in enumerate(languages)}
    share = F.create_map(*(F.lit(x) for n in languages for x in (n, min(1.0, per_language / counts[n]))))
    draw = F.pmod(F.xxhash64(F.lit("language"), F.col("id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = rows.filter(draw < share[F.col("lang")])

    def count(batches):
        total = np.zeros((2, len(languages), BUCKETS), np.int64)
        for part in slices(batches, "text", SLICE_BYTES):
            g = grams(column(part, "text"))
            lang = np.array([number[x] for x in column(part, "lang").to_pylist()])
            of = np.repeat(lang[g.words.owner()], g.words.ends - g.words.starts + 1)
            for k, x in enumerate((g.triple, g.pair)):
                total[k] += np.bincount(of * BUCKETS + x, minlength=len(languages) * BUCKETS).reshape(-1, BUCKETS)
        kind, lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"kind": kind, "lang": lang, "bucket": bucket, "n": total[kind, lang, bucket]})

    found = (
        map_arrow(sample.select("text", "lang"), count, "kind bigint, lang bigint, bucket bigint, n bigint")
        .groupBy("kind", "lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    total = np.zeros((2, BUCKETS, len(languages)))
    total[tuple(found[c].to_numpy() for c in ("kind", "bucket", "lang"))] = found["n"].to_numpy()
    return Model(
        languages,
        np.log(total[0] + SMOOTHING).astype(np.float32),
        np.log(total[1] + SMOOTHING * ALPHABET).astype(np.float32),
    )


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's words; texts without words are not among them."""
    return np.add.reduceat(values, first, axis=0)


def _em(p: np.ndarray, share: np.ndarray, of: np.ndarray, first: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares after some rounds, and each text's log likelihood under them."""
    n = np.diff(np.append(first, len(p)))[:, None]
    for _ in range(rounds):
        part = p * share[of]
        part /= part.sum(axis=1, keepdims=True)
        share = _per_text(part, first) / n
    return share, _per_text(np.log(np.maximum((p * share[of]).sum(axis=1), 1e-300)), first)


def infer(texts: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Share of each language in each text: zero outside its language set, all zero
    where a text has no word."""
    shares = np.zeros((len(texts), len(model.languages)))
    g = grams(texts)
    if not len(g.first) or not model.languages:
        return shares, g.words.counts
    log_p = np.add.reduceat(model.table[g.triple] - model.pairs[g.pair], g.first, axis=0).astype(np.float64)
    top = log_p.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(log_p - top, -60.0))
    counts = g.words.counts
    texts_ = np.flatnonzero(counts)
    first = g.words.first[:-1][texts_]
    of = np.repeat(np.arange(len(texts_)), counts[texts_])
    n_lang = len(model.languages)
    full, _ = _em(p, np.full((len(texts_), n_lang), 1 / n_lang), of, first, EM_ROUNDS)
    single = _per_text(np.log(p), first)
    # a set begins with the likeliest single language and grows by falling shares
    order = np.argsort(-full, axis=1, kind="stable")
    head = single.argmax(axis=1)[:, None]
    order = np.concatenate([head, order[order != head].reshape(len(order), n_lang - 1)], axis=1)
    best = np.take_along_axis(single, head, axis=1)[:, 0]
    chosen = np.zeros((len(texts_), n_lang))
    np.put_along_axis(chosen, head, 1.0, axis=1)
    open_ = np.arange(len(texts_))
    for size in range(2, n_lang + 1):
        word = np.isin(of, open_) if len(open_) < len(texts_) else np.ones(len(of), bool)
        members = counts[texts_][open_]
        first_ = np.cumsum(members) - members
        of_ = np.repeat(np.arange(len(open_)), members)
        sets = order[open_, :size]
        part = np.take_along_axis(p[word], sets[of_], axis=1)
        share, likelihood = _em(part, np.full(sets.shape, 1 / size), of_, first_, EM_ROUNDS)
        penalty = 0.5 * (size - 1) * np.log(members)
        better = likelihood - penalty > best[open_]
        won = open_[better]
        best[won] = (likelihood - penalty)[better]
        chosen[won] = 0
        chosen[won[:, None], sets[better]] = share[better]
        open_ = won
        if not len(open_):
            break
    shares[texts_] = chosen
    return shares, counts


OUT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("languages", T.ArrayType(T.StringType())),
        T.StructField("shares", T.ArrayType(T.DoubleType())),
    ]
)


def _predict(texts: pa.Array, model: Model) -> list[pa.Array]:
    shares, counts = infer(texts, model)
    letter = pc.match_substring_regex(texts, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
    known = letter & (counts > 0) & (len(model.languages) > 0)
    names = np.array([*model.languages, UNKNOWN])
    best = np.where(known, shares.argmax(axis=1) if model.languages else 0, len(model.languages))
    score = np.where(known, shares.max(axis=1) if model.languages else 0.0, 0.0)
    sets = [np.flatnonzero(row) if ok else [] for row, ok in zip(shares, known, strict=True)]
    return [
        pa.array(names[best].tolist(), pa.string()),
        pa.array(np.minimum(score, 1.0)),
        pa.array([names[s].tolist() if len(s) else [] for s in sets], pa.list_(pa.string())),
        pa.array([row[s].tolist() if len(s) else [] for row, s in zip(shares, sets, strict=True)], pa.list_(pa.float64())),
    ]


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = tuple(OUT.names)) -> DataFrame:
    """`docs` with lang_pred, score, languages and shares under free names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField(n, f.dataType) for n, f in zip(fresh(docs.columns, *names), OUT.fields, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text, SLICE_BYTES):
            found = _predict(column(part, text), sent.value)
            yield pa.RecordBatch.from_arrays([*part.columns, *found], [*part.schema.names, *(f.name for f in added)])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, *added]))
