import random
import re
from collections import Counter

import numpy as np
import pytest

from tabshift.llm import quality as Q

from .helpers import documents

NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def brute(id, text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if counts[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return (id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again))


def failed(row):
    return row[1] < 50 or 100 * row[5] > 50 * row[1]


def test_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "a a a a a", "x\n\nx\ny\nx \n", "## |é😀| <b>", "a\x0bb\x0cc\rd", "w " * 30_000]
    texts += ["".join(rng.choice("ab \n#") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    docs = list(enumerate(texts)) + [(3, texts[3])]
    got = Q.quality(documents(spark, docs, clash=True))
    assert sorted(map(tuple, got.select(NAMES).collect())) == sorted(brute(*d) for d in docs)
    assert all(r["base_failed"] == failed(brute(r["doc_id"], texts[r["doc_id"]])) for r in got.collect())
    assert got.filter("base_failed and kept").count() == 0


def clean_and_odd(n):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    docs = []
    for k in range(n):
        words = [word() for _ in range(rng.randint(60, 300))]
        odd = k % 10 == 0
        docs.append((k, " ".join(w + "###" if odd else w for w in words), rng.choice(["en", "de", None]), "hot" if k % 3 else None))
    return docs


def test_outliers_go_and_clean_rows_stay(spark):
    docs = clean_and_odd(600)
    kept = {r["doc_id"]: r["kept"] for r in Q.quality(documents(spark, docs)).collect()}
    assert not any(kept[k] for k in range(0, 600, 10))
    assert np.mean([kept[k] for k in range(600) if k % 10]) > 0.99


FLOORS = np.array(Q.FLOORS)


def bucket(d):
    return np.minimum(np.floor(np.log1p(d) * Q.BUCKETS_PER_UNIT), Q.BUCKETS - 1)


def distance(x, centre, scatter):
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)


def numpy_mcd(x):
    """Centre and scatter of one group, with exact sorting, until the determinant stays."""
    grid = np.floor(x * Q.START_GRID)
    quantile = lambda q: np.sort(grid, axis=0)[int(np.ceil(q * len(x))) - 1] / Q.START_GRID
    centre = quantile(0.5)
    scatter = np.diag(((quantile(0.75) - quantile(0.25)) / 1.349) ** 2 + FLOORS**2)
    best = np.inf
    while True:
        b = bucket(distance(x, centre, scatter))
        half = x[b <= np.sort(b)[(len(x) + Q.DIM + 1) // 2 - 1 if len(x) > Q.DIM else len(x) - 1]]
        new = half.mean(axis=0), np.cov(half.T, bias=True) + np.diag(FLOORS**2) if len(half) > 1 else np.diag(FLOORS**2)
        det = np.linalg.slogdet(new[1])[1]
        if best < np.inf and det >= best - Q.LEAST_FALL:
            return centre, scatter
        (centre, scatter), best = new, det


def scale_of(d):
    median = np.sort(bucket(d))[-(-len(d) // 2) - 1] + 1
    return max(np.expm1(median / Q.BUCKETS_PER_UNIT) / Q.MEDIAN, 1.0)


def test_distances_of_every_group_equal_numpy(spark):
    """Groups of very different sizes, null languages and sources included."""
    docs = clean_and_odd(240)
    docs = [(k, t, lang, "rare" if k % 37 == 0 else "lone" if k == 5 else source) for k, t, lang, source in docs]
    rows = {r["doc_id"]: r for r in Q.quality(documents(spark, docs)).collect()}
    stats = np.array([brute(*d[:2]) for d in docs], float)
    lines = np.array([max(1, len([x for x in d[1].split("\n") if x.strip()])) for d in docs])
    n, chars, symbols, dups, again = stats[:, 1:].T
    x = np.column_stack([np.log1p(n), np.log(chars / n), np.sqrt(np.minimum(symbols / chars, 1)), np.sqrt(dups / lines), np.sqrt(again / n)])
    keys = [(d[2:4], d[2:3], ()) for d in docs]
    raw = {g: (numpy_mcd(x[m]), m.sum()) for level in range(3) for g in {k[level] for k in keys} for m in [np.array([k[level] == g for k in keys])]}

    def mixed(g, above):
        (m, s), rows_ = raw[g]
        w = rows_ / (rows_ + Q.SHRINK_ROWS)
        return w * m + (1 - w) * above[0], w * s + (1 - w) * above[1]

    final = {g: mixed(g, mixed(up, raw[()][0])) for g, up, _ in set(keys)}
    d = np.array([distance(x[k : k + 1], *final[keys[k][0]])[0] for k in range(len(docs))])
    overall = scale_of(d)
    for g in final:
        mine = np.array([k[0] == g for k in keys])
        w = mine.sum() / (mine.sum() + Q.SHRINK_ROWS)
        want = np.sqrt(d[mine] / (w * scale_of(d[mine]) + (1 - w) * overall))
        assert [rows[k]["distance"] for k in np.flatnonzero(mine).tolist()] == pytest.approx(want.tolist(), rel=1e-6)


def test_many_groups_meet_their_estimates_salted(spark, monkeypatch):
    docs = clean_and_odd(120)
    want = sorted((r["doc_id"], r["kept"], round(r["distance"], 6)) for r in Q.quality(documents(spark, docs)).collect())
    monkeypatch.setattr(Q, "BROADCAST_BYTES", 0)
    assert sorted((r["doc_id"], r["kept"], round(r["distance"], 6)) for r in Q.quality(documents(spark, docs)).collect()) == want


def test_empty_table_and_lone_rows(spark):
    assert Q.quality(documents(spark, [])).collect() == []
    row = Q.quality(documents(spark, [(1, "word other " * 5 + " ".join(f"w{k}" for k in range(60)))])).first()
    assert row["kept"] and not row["base_failed"]


def test_plan_has_no_python(spark):
    df = Q.statistics(documents(spark, [(1, "a")]).withColumnRenamed("text", "_text"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
