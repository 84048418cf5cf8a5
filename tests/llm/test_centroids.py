import hashlib
from itertools import count

import numpy as np
import pytest

from tabshift.llm import centroids as C

from .helpers import rows_of

COLUMNS = ["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
KIND = "id bigint, vector array<double>, label string, cluster string, distance string"


def brute(rows, dims, k, rounds):
    kept = []
    for id, v in rows:
        if v is not None and len(v) == dims and all(x is not None and abs(x) * 1024 < C.LARGEST for x in v):
            kept.append((id, [int(np.floor(1024 * x)) for x in v]))
    seeds = sorted((hashlib.sha256(f"3:{id}".encode()).hexdigest(), v) for id, v in kept if id is not None)
    held = [v for _, v in seeds[:k]]
    if not held:
        return []
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in count():
        near = [min((far(v, c), n) for n, c in enumerate(held)) for _, v in kept]
        if step == rounds:
            break
        for n in range(len(held)):
            mine = [v for (_, v), (_, m) in zip(kept, near, strict=True) if m == n]
            if mine:
                held[n] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    total = sum(d for d, _ in near)
    return sorted(
        (
            (id, n, d, sum(e for e, m in near if m == n), total, hashlib.sha256(",".join(map(str, held[n])).encode()).hexdigest())
            for (id, _), (d, n) in zip(kept, near, strict=True)
        ),
        key=repr,
    )


def table(spark, rows):
    return spark.createDataFrame([(id, v, "x", "own", "own") for id, v in rows], KIND)


def run(spark, rows, dims, k=3, rounds=4, **more):
    found = C.cluster(table(spark, rows), "id", "vector", dims, k, rounds, **more)
    assert found.columns == COLUMNS
    return rows_of(found, *COLUMNS)


def some(n, dims, seed, coarse=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)) + rng.integers(0, 4, (n, 1))
    return [(k, (x[k] if coarse is None else np.round(x[k] * coarse) / coarse).tolist()) for k in range(n)]


@pytest.mark.parametrize(("dims", "coarse"), [(8, None), (8, 2), (6, 1), (1, None), (5, 4)])
def test_against_brute_force(spark, dims, coarse):
    rows = some(150, dims, dims, coarse)
    assert run(spark, rows, dims, chunk=40) == brute(rows, dims, 3, 4)


def test_awkward_rows(spark):
    rows = some(30, 4, 1) + [
        (100, None), (101, []), (102, [1.0, None, 0.0, 0.0]), (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]),
        (105, [1e300, 0.0, 0.0, 0.0]), (106, [131072.0, 0.0, 0.0, 0.0]), (107, [-131071.9999, 0.0, 0.0, -0.0]), (None, [0.5, 0.5, 0.5, 0.5]),
        (7, [9.0, 9.0, 9.0, 9.0]), (108, [1.0, 1.0, 1.0]), *[(200, [2.0, 2.0, 2.0, 2.0])] * 40,
    ]
    finite = [(i, v) for i, v in rows if not v or all(x is None or np.isfinite(x) for x in v)]
    got = run(spark, rows, 4, k=8, rounds=10)
    assert got == brute(finite, 4, 8, 10)
    assert {i for i, *_ in got}.isdisjoint({100, 101, 102, 103, 104, 105, 106, 108}) and (107 in {i for i, *_ in got})


def test_equal_vectors_and_few_rows(spark):
    """Ties go to the smaller number and an empty centroid stays."""
    rows = [(k, [1.0, 1.0]) for k in range(5)]
    assert run(spark, rows, 2) == brute(rows, 2, 3, 4)
    assert {n for _, n, *_ in run(spark, rows, 2)} == {0}
    assert run(spark, rows[:2], 2) == brute(rows[:2], 2, 3, 4)
    assert run(spark, [], 2) == [] and run(spark, [(None, [1.0, 2.0])], 2) == []


@pytest.mark.parametrize("coarse", [None, 1, "copies"])
def test_dictionaries_lose_nothing(coarse):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-500, 500, (200, 16))
    if coarse == 1:
        vectors //= 200
    if coarse == "copies":
        vectors = vectors[rng.integers(0, 3, 200)]
    codes, dictionary, starts, width = C.encode(vectors)
    assert np.array_equal(np.concatenate([dictionary[c] for c in codes], axis=1), vectors)
    assert len(codes) * width == 16 and (coarse != "copies" or width == 16)
    held = rng.integers(-500, 500, (5, 16))
    apart = C.distances(codes, dictionary, starts, held)
    assert np.array_equal(apart, ((vectors[:, None] - held[None]) ** 2).sum(axis=2))
    cluster = apart.argmin(axis=1)
    want = np.array([vectors[cluster == k].sum(axis=0) for k in range(5)])
    assert np.array_equal(C.sums(codes, dictionary, starts, cluster, 5), want)


def test_large_components_stay_exact(spark):
    rows = [(k, [(-1) ** k * (131071.0 - k)] * 64) for k in range(6)]
    assert run(spark, rows, 64, k=2) == brute(rows, 64, 2, 4)
