import random
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabshift.llm import jaccard as J
from tabshift.llm.graph import components

from .helpers import documents, least_reachable, rows_of, shingles


def brute(docs, percent=90, size=3):
    sets = [(id, shingles(text, size)) for id, text in docs]
    links = []
    for (i, a), (j, b) in combinations(list(enumerate(s for _, s in sets)), 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            links.append((i, j))
    label = least_reachable(range(len(sets)), links)
    least = {}
    for k, (id, _) in enumerate(sets):
        own = least.setdefault(label[k], id)
        least[label[k]] = id if own is None else own if id is None else min(own, id)
    return sorted(((id, len(s), least[label[k]]) for k, (id, s) in enumerate(sets)), key=repr)


def near_copies(rng, vocabulary, length, groups, copies):
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(*length))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(text) // 40))):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            docs.append(" ".join(text))
    return docs


@pytest.mark.parametrize(("seed", "length", "vocabulary"), [(1, (3, 30), 40), (2, (60, 200), 300), (3, (10, 90), 8), (4, (1, 14), 3)])
def test_equals_brute_force(spark, seed, length, vocabulary):
    rng = random.Random(seed)
    texts = near_copies(rng, [f"w{k}" for k in range(vocabulary)], length, 12, 8)
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    got = J.jaccard_components(documents(spark, docs).repartition(3))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(docs)


def test_other_thresholds(spark):
    rng = random.Random(6)
    docs = list(enumerate(near_copies(rng, [f"w{k}" for k in range(90)], (5, 120), 10, 7)))
    got = J.jaccard_components(documents(spark, docs), size=5, percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(docs, percent=80, size=5)


@pytest.mark.parametrize("most", [0, 12, 40])
def test_any_boundary_gives_the_same(spark, monkeypatch, most):
    rng = random.Random(5)
    docs = list(enumerate(near_copies(rng, [f"w{k}" for k in range(60)], (12, 45), 12, 8)))
    monkeypatch.setattr(J, "boundary", lambda histogram, percent: most)
    assert rows_of(J.jaccard_components(documents(spark, docs)), "doc_id", "n_shingles", "component_id") == brute(docs)


def test_chains_are_followed(spark):
    """Each text changes the last word of the one before and appends one: ends do not link."""
    words = [f"w{k}" for k in range(200)]
    docs = [(k, " ".join(words[k * 2 : k * 2 + 100])) for k in range(30)]
    got = J.jaccard_components(documents(spark, docs))
    want = brute(docs)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want and len({c for *_, c in want}) == 1


def test_awkward_rows(spark):
    long = " ".join(f"v{k}" for k in range(30_000))
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE  two"), (8, "two one"), (9, long),
            (10, long + " more"), (11, "a b c"), (11, "a b c"), (12, "a b c"), (None, "a b c"), (None, "x y z"), (13, "a b c d")]
    got = J.jaccard_components(documents(spark, docs, clash=True))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(docs)


@pytest.mark.parametrize("most", [0, 40])
def test_long_near_copies_with_null_and_repeated_ids(spark, monkeypatch, most):
    rng = random.Random(8)
    texts = near_copies(rng, [f"w{k}" for k in range(200)], (30, 160), 10, 8)
    docs = [((None, 7, k)[k % 3], text) for k, text in enumerate(texts)]
    docs += docs[:6]
    monkeypatch.setattr(J, "boundary", lambda histogram, percent: most)
    got = J.jaccard_components(documents(spark, docs).repartition(3))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(docs)


def test_texts_of_one_id_do_not_multiply(spark, monkeypatch):
    """Each row under a hot id is fetched for its own class alone."""
    rng = random.Random(9)
    docs = [(id, text) for id, text in zip([None] * 40 + [5] * 40, near_copies(rng, [f"w{k}" for k in range(300)], (90, 120), 10, 8), strict=True)]
    fetched, real = [], J.map_arrow

    def counted(df, function, schema):
        if "digest" in df.columns and "text" in df.columns:
            fetched.append(df.count())
        return real(df, function, schema)

    monkeypatch.setattr(J, "map_arrow", counted)
    J.jaccard_components(documents(spark, docs)).collect()
    assert len(fetched) == 2 and max(fetched) <= len(docs)


def test_empty_table(spark):
    assert J.jaccard_components(documents(spark, [])).collect() == []


def test_listed_prefixes_lose_no_link():
    """Sets with the worst possible order: what they do not share comes first."""
    for a in range(1, 200):
        for b in J.partners(a, 90):
            need = J.shared(a, b, 90)
            if need > min(a, b):
                continue
            common = min(J.listed(a, 90) - (a - need), J.listed(b, 90) - (b - need), need)
            assert common >= min(J.extra(a), J.extra(b))


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"))
    ids = {x for e in edges if e[0] != e[1] for x in e}
    want = least_reachable(ids, [e for e in edges if e[0] != e[1]])
    assert dict(map(tuple, got.collect())) == want and got.count() == len(want)


def test_hot_group_makes_no_pairs(spark, monkeypatch):
    """A large group of near copies is settled by pairs with two members of each list."""
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join([*base[:75], f"own{k}", *base[75:]])) for k in range(120)]
    sizes = {}
    real = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *rest: (sizes.update({len(sizes): pairs.count()}), real(pairs, *rest))[1])
    got = J.jaccard_components(documents(spark, docs))
    assert got.select(F.countDistinct("component_id")).first()[0] == 1
    assert sizes[0] <= 2 * 120 and sizes[1] == 0


def test_a_small_set_joins_two_larger_ones_in_any_order(spark):
    # ten shingles, and twice one more: the larger sets share too little for a link of their own
    base = " ".join(f"w{k}" for k in range(12))
    texts = [f"{base} y", f"{base} z", base]
    for order in permutations(texts):
        docs = list(enumerate(order))
        got = J.jaccard_components(documents(spark, docs).coalesce(1))
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute(docs)
        assert {r["component_id"] for r in got.collect()} == {0}


def test_clashing_keys_lose_no_link(spark, monkeypatch):
    texts = [" ".join(f"{g}{k}" for k in range(12 + n)) + end for g in "abcd" for n, end in ((0, " y"), (0, " z"), (0, ""), (1, ""))]
    docs = list(enumerate(texts))
    monkeypatch.setattr(J, "boundary", lambda histogram, percent: 40)
    monkeypatch.setattr(J, "mix", lambda h: h & np.uint64(0))
    assert rows_of(J.jaccard_components(documents(spark, docs)), "doc_id", "n_shingles", "component_id") == brute(docs)
