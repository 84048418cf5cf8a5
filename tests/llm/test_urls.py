import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tabshift.llm import urls as U

from .helpers import rows_of

RULES = [
    ("org/", "allow", 0), ("example.org/es/", "block", 0), ("EXAMPLE.org/en/1", "block", 0), ("com/fr/", "allow", 0), ("com/de/", "block", 0),
    ("bad.example.com", "block", 1), ("bad.example.com/ok", "allow", 1), ("both.net/x", "allow", 0), ("both.net/x", "block", 0),
    (None, "block", 0), ("ignored.net/", "maybe", 0), ("ignored.net/", None, 0), ("größe.de/ü", "block", 0), ("tie.net/ab", "block", 0), ("a.tie.net/", "allow", 0),
]
URLS = [
    "https://a.example.org/es/1", "http://example.org/en/12?x#y", "http://EXAMPLE.ORG/en/2", "https://notexample.org/es/", "ftp://x.com/fr/",
    "http://x.com/de/", "http://x.com/DE/", "http://bad.example.com", "http://bad.example.com?q=/x", "http://w.bad.example.com/ok/1", "http://bad.example.com/fr/",
    "http://both.net/xyz", "http://ignored.net/", "http://größe.de/über", "no scheme", None, "", "://", "http://com", "http://org", "http://org/",
    "x://y://org/", "http://u:p@example.org:80/es/", "http://a.tie.net/abc", "http://.org/", "http://a..org/x", "http://e.org/\nb", "http://" + "a." * 3000 + "org/" + "p" * 5000,
]


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    return host, path[:end]


def brute(url, rules):
    host, path = parse(url)
    fits = []
    for entry, verdict, tier in rules:
        if entry is None or verdict not in ("allow", "block"):
            continue
        own, slash, rest = entry.partition("/")
        own, prefix = own.lower(), slash + rest
        if (host == own or host.endswith("." + own)) and path.startswith(prefix):
            fits.append((tier, -len((own + prefix).encode()), -len(own.encode()), verdict == "allow", own + prefix))
    if not fits:
        return host, path, None, None
    best = min(fits)
    return host, path, best[4], "allow" if best[3] else "block"


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "entry string, verdict string, tier int")


@pytest.mark.parametrize("shard_rows", [U.SHARD_ROWS, 2])
def test_against_brute_force(spark, rules, shard_rows):
    pages = spark.createDataFrame([(k, u, "own", "own") for k, u in enumerate(URLS)], "page_id bigint, url string, host string, Tier string")
    built = U.build(rules, shard_rows)
    assert (built.bits > 0) == (shard_rows == 2)
    found = rows_of(U.judge(pages, built), "page_id", "host", "path", "entry", "verdict")
    assert found == sorted(((k, *brute(u, RULES)) for k, u in enumerate(URLS)), key=repr)


def test_empty_tables_and_repeated_rows(spark, rules):
    pages = spark.createDataFrame([(1, "http://x.org/"), (1, "http://x.org/"), (None, None)], "page_id bigint, url string")
    nothing = U.build(rules.limit(0))
    assert [r["verdict"] for r in U.judge(pages, nothing).collect()] == [None] * 3
    built = U.build(rules)
    assert rows_of(U.judge(pages, built), "page_id", "entry") == [(1, "org/"), (1, "org/"), (None, None)]
    assert U.judge(pages.limit(0), built).collect() == []


def test_keys_are_those_of_spark(spark):
    texts = ["", "a", "größe.de/ü", "x" * 100, "org/" * 9]
    made = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(F.xxhash64("s")).collect()]
    assert U.digests([t.encode() for t in texts]).view(np.int64).tolist() == made
    assert made[1] % (1 << 64) == xxhash.xxh64_intdigest(b"a", 42)


def test_collisions_decide_nothing():
    """Strings of one key are told apart by their bytes."""
    strings = pa.array([b"one", b"two", b"three"], pa.large_binary())
    parts = U.DigestArray.parts(np.array([7, 7, 9], np.uint64), np.array([1, 2, 3]), strings)
    n, keys, values, offsets, data = (np.frombuffer(p, k) for p, k in zip(parts, ("i8", "u8", "i8", "i8", "u1"), strict=True))
    array = U.DigestArray(keys, values, offsets, data)
    asked, at = np.frombuffer(b"twotenthreeone", np.uint8), np.array([0, 3, 6, 11, 14])
    query, value = array.find(np.array([7, 7, 7, 7], np.uint64), asked, at)
    assert sorted(zip(query.tolist(), value.tolist(), strict=True)) == [(0, 2), (3, 1)]
