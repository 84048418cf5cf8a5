import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tabshift.llm import decontaminate as D
from tabshift.llm.text import ALNUM, words

from .helpers import alnum, documents, rows_of

ITEMS = "item_id bigint, text string"


def brute(docs, items, size=10):
    out = []
    for id, text in docs:
        w, hit, found = alnum(text), set(), set()
        for item, t in items:
            v = alnum(t)
            n = min(size, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add("null" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((id, len(w), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def random_case(seed, vocabulary=6, size=4):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice("abcdefghij"[:vocabulary]) for _ in range(n))
    items = [(k, say(rng.randint(0, 9))) for k in range(6)]
    docs = [(k, say(rng.randint(0, 60))) for k in range(12)]
    docs += [(100 + k, f"x y {t} z") for k, t in items] + [(3, docs[3][1])]
    return docs, items, size


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    docs, items, size = random_case(seed)
    got = D.contamination(documents(spark, docs), spark.createDataFrame(items, ITEMS), size=size)
    assert rows_of(got, *COLUMNS) == brute(docs, items, size)


def test_blocks_give_the_same(spark):
    docs, items, size = random_case(9)
    got = D.contamination(documents(spark, docs), spark.createDataFrame(items, ITEMS), size=size, block_windows=1)
    assert rows_of(got, *COLUMNS) == brute(docs, items, size)


def test_awkward_rows(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [
        (1, None), (2, ""), (3, "..."), (4, passage.upper()), (4, passage.upper()), (None, passage),
        (5, "one-two_three four,five SIX seven\neight nine ten"), (6, "Ünï " + passage + " ß"), (7, passage + " word" * 30000),
        (8, "short item"), (9, "item short"),
    ]
    items = [(1, passage), (1, passage), (2, "Short Item"), (3, None), (4, ""), (None, "ünï one"), (10, passage)]
    got = D.contamination(documents(spark, docs, clash=True), spark.createDataFrame(items, ITEMS))
    assert rows_of(got, *COLUMNS) == brute(docs, items)


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "a b")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    assert D.contamination(documents(spark, []), items).collect() == []
    assert rows_of(D.contamination(documents(spark, [(1, "a b")]), none), "n_words", "n_hit") == [(2, 0)]


def test_cutting_leaves_no_window(spark):
    items = spark.createDataFrame([(1, "a b c d"), (2, "e f")], ITEMS)
    # cutting "e f" joins "a b" and "c d" into the first item
    docs = documents(spark, [(1, "x a b e f c d y"), (2, "clean text"), (3, None), (2, "clean text")], clash=True)
    got = D.decontaminate(docs, items, size=4)
    assert got.columns == docs.columns
    assert {r["doc_id"]: (r["text"] or "").split() for r in got.collect()} == {1: ["x", "y"], 2: ["clean", "text"], 3: []}
    assert got.filter("text is null").count() == 1 and got.count() == 4


def test_spans_are_merged(spark):
    got = D.contamination(documents(spark, [(1, "é a b c d e")]), spark.createDataFrame([(1, "a b c d")], ITEMS), size=3)
    assert [tuple(s) for s in got.first()["spans"]] == [(3, 10)]


@pytest.mark.parametrize("seed", range(6))
def test_index_counts_and_locates(seed):
    rng = np.random.default_rng(seed)
    runs = [rng.integers(1, 5, rng.integers(1, 40)) for _ in range(rng.integers(1, 8))]
    text = np.concatenate([np.append(r, 0) for r in runs])
    index = D.FmIndex(text, 4, sample=4)
    for n in (1, 2, 3):
        patterns = np.unique(rng.integers(1, 5, (20, n)), axis=0)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            want = [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_a_word_never_crosses_two_texts():
    w = words(pa.array(["ab", "cd", None, "", "e"]), ALNUM, lower=True)
    assert w.counts.tolist() == [1, 1, 0, 0, 1]


def test_large_benchmark_is_refused(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_QUERY_BYTES", 2)
    with pytest.raises(ValueError, match="bytes"):
        D.contamination(documents(spark, []), spark.createDataFrame([(1, "abc")], ITEMS))
