import random
import re
from collections import Counter

import pytest

import corpus_pipeline as pipeline

from .helpers import DOCS, alnum, documents
from .test_jaccard import brute as components

BENCH = "item_id bigint, text string"


def texts():
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7))) for _ in range(n))
    passage = say(30)
    base = say(120)
    docs = [(k, say(rng.randint(20, 80))) for k in range(20)]
    docs += [(30, base), (31, base), (32, base + " tail"), (30, base), (33, None), (34, ""), (35, "12 ... 34"), (None, say(40)), (None, say(41)), (None, base)]
    docs += [(40, f"{say(30)} {passage} {say(30)}"), (41, f"{say(30)} 4111111111111111 ann@mail.example.com {say(20)}")]
    return docs, passage


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, passage = texts()
    root = tmp_path_factory.mktemp("pipeline")
    documents(spark, docs, clash=True).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, passage)], BENCH).write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, folder):
    docs, passage = texts()
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]

    known = pipeline.written(stages["language ID"](spark, table, folder))
    assert known.columns == table.columns
    assert Counter(r["doc_id"] for r in known.collect()) == Counter(d for d, t in docs if re.search("[a-z]", t or ""))

    single = pipeline.written(stages["n-gram Jaccard join"](spark, known, folder))
    assert single.columns == table.columns
    # rows of one id differ in text here, so the brute force numbers the rows
    left = [d for d in docs if re.search("[a-z]", d[1] or "")]
    groups = {c for *_, c in components(list(enumerate(t for _, t in left)), percent=80, size=5)}
    got = [(r["doc_id"], r["text"]) for r in single.collect()]
    assert len(got) == len(groups) and set(got) <= set(left)
    assert sum(t.startswith(texts()[0][20][1]) for _, t in got) == 1

    clean = pipeline.written(stages["benchmark decontamination"](spark, single, folder))
    assert clean.columns == table.columns and clean.count() == single.count()
    assert not any(" ".join(alnum(passage)[:10]) in " ".join(alnum(r["text"])) for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    safe = pipeline.written(stages["PII"](spark, clean, folder))
    assert safe.columns == table.columns and safe.count() == clean.count()
    assert not any("4111111111111111" in r["text"] or "ann@" in r["text"] for r in safe.collect())
    before, after = ({r["doc_id"]: r["text"] for r in x.filter("doc_id < 30").collect()} for x in (single, safe))
    assert before == after, "clean documents stay as they are"

    packed = stages["best-fit packing"](spark, safe, folder)
    assert packed.filter("piece = 0").count() == safe.count()


def test_run_is_the_stages_in_turn(spark, folder):
    assert pipeline.run(spark, folder).select("doc_id").distinct().count() > 20


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
