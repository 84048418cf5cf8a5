"""URL filters by a sorted digest array.

A list holds entries `host/path`, each with a verdict and a tier. An entry fits a host and
all its subdomains where the url's path starts with the entry's; of the entries that fit, the
lowest tier decides, then the longest entry, then the longest host.

Spark reduces the list to distinct strings and deals them by the leading bits of their 64-bit
xxhash into shards of even size. A task writes a shard as one file: keys in ascending order,
values, offsets and the strings themselves. Tasks that judge urls memory-map those files,
find all keys of a batch by one vectorised binary search, and compare the stored string with
the wanted one, so a collision of keys decides nothing. Two kinds of strings are stored:
hosts, whose values are the path lengths that the list holds for them, and whole entries.
A url therefore probes its host's suffixes and then only prefixes that can be entries. Neither
the list nor the urls pass through the driver; it sees the names of the shards.

Defined cases: a null url or one without `://` has an empty host and path, fits nothing and is
allowed; so is every url that no entry fits. Entries without a path fit all paths. Null entries
and verdicts other than `allow` and `block` are not in the list; an entry given with both
verdicts in one tier blocks. Repeated rows are judged each; other columns are ignored. Lengths
are those of UTF-8. An empty list allows everything.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.llm import files
from tabshift.llm.common import batch, bytes_of, column, map_arrow, only, slices, written
from tabshift.llm.text import runs

#: Strings of a shard, on average.
SHARD_ROWS = 1 << 20
#: Spark's seed of xxhash64; keys of both sides are the same.
SEED = 42
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in small letters."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url))).otherwise("")


# ---------------------------------------------------------------- the array


def digests(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in strings), np.uint64, len(strings))


@dataclass
class DigestArray:
    """One shard: keys ascending; string k is data[offsets[k] : offsets[k + 1]]."""

    keys: np.ndarray
    values: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @staticmethod
    def parts(keys: np.ndarray, values: np.ndarray, strings: pa.Array) -> list:
        """The buffers of a file."""
        order = np.argsort(keys, kind="stable")
        data, offsets = bytes_of(strings.take(pa.array(order)))
        head = np.array([len(keys)], np.int64)
        return [x.tobytes() for x in (head, keys[order], values[order].astype(np.int64), offsets.astype(np.int64), data)]

    @classmethod
    def open(cls, path: str) -> DigestArray:
        raw = files.view(path)
        (n,) = np.frombuffer(raw, np.int64, 1)
        keys, values = np.frombuffer(raw, np.uint64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        offsets = np.frombuffer(raw, np.int64, n + 1, 8 + 16 * n)
        return cls(keys, values, offsets, np.frombuffer(raw, np.uint8, offset=16 + 24 * n))

    def find(self, keys: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) of each record whose stored string equals the query's."""
        first = np.searchsorted(self.keys, keys, side="left")
        size = np.searchsorted(self.keys, keys, side="right") - first
        query = np.repeat(np.arange(len(keys)), size)
        record = runs(first, size)
        length = np.diff(offsets)[query]
        same = np.flatnonzero(length == self.offsets[record + 1] - self.offsets[record])
        query, record, length = query[same], record[same], length[same]
        differs = self.data[runs(self.offsets[record], length)] != data[runs(offsets[query], length)]
        wrong = np.bincount(np.repeat(np.arange(len(query)), length)[differs], minlength=len(query)) > 0
        return query[~wrong], self.values[record[~wrong]]


@functools.lru_cache(maxsize=64)
def _shard(path: str) -> DigestArray:
    return DigestArray.open(path)


@dataclass
class UrlFilter:
    """Files by kind and shard; `bits` leading bits of a key name its shard."""

    shards: dict[tuple[str, int], str]
    bits: int
    labels: int  # most labels of a listed host

    def find(self, kind: str, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(query, value), in no order, of the strings that the list holds."""
        keys = digests(strings)
        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(keys), np.int64)
        data, offsets = bytes_of(pa.array(strings, pa.large_binary()))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for s in np.unique(shard).tolist():
            if (kind, s) in self.shards:
                mine = np.flatnonzero(shard == s)
                at = np.concatenate([[0], np.cumsum(np.diff(offsets)[mine])])
                part = data[runs(offsets[mine], np.diff(offsets)[mine])] if len(mine) < len(keys) else data
                query, value = _shard(self.shards[kind, s]).find(keys[mine], part, at)
                found.append((mine[query], value))
        return tuple(map(np.concatenate, zip(*found, strict=True)))


def build(rules: DataFrame, shard_rows: int = SHARD_ROWS) -> UrlFilter:
    """`rules`: entry, verdict, tier (0 or more)."""
    spark = rules.sparkSession
    known = rules.filter("entry is not null and verdict in ('allow', 'block')")
    host = F.translate(F.substring_index("entry", "/", 1), UPPER, LOWER)
    path = F.substring(F.col("entry"), F.char_length(F.substring_index("entry", "/", 1)) + 1, F.char_length("entry"))
    list_ = written(
        known.select(host.alias("host"), path.alias("path"), F.coalesce("tier", F.lit(0)).alias("tier"), "verdict")
        .groupBy("host", "path", "tier").agg(F.max(F.when(F.col("verdict") == "block", 1).otherwise(0)).alias("blocks"))
    )
    n, labels = list_.agg(F.count("*"), F.max(F.size(F.split("host", r"\.")))).first()
    bits = max(0, int(-(-n // shard_rows) - 1).bit_length())
    entries = list_.select(
        F.lit("entry").alias("kind"), F.concat("host", "path").alias("string"), (F.col("tier") * 2 + F.col("blocks")).cast("long").alias("value")
    )
    hosts = list_.select(F.lit("host").alias("kind"), F.col("host").alias("string"), F.octet_length("path").cast("long").alias("value")).distinct()
    key = F.xxhash64("string")
    shard = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    dealt = entries.union(hosts).withColumns({"key": key, "shard": shard})
    place = files.folder(spark, "urls")

    def write(table):
        keys = table.column("key").to_numpy().view(np.uint64)
        parts = DigestArray.parts(keys, table.column("value").to_numpy(), table.column("string").combine_chunks())
        names = {"kind": table.column("kind")[:1], "shard": table.column("shard")[:1]}
        return pa.table({**names, "path": [files.put(place, parts)]})

    made = written(dealt.groupBy("kind", "shard").applyInArrow(write, "kind string, shard bigint, path string"))
    return UrlFilter({(r["kind"], r["shard"]): r["path"] for r in made.collect()}, bits, labels or 0)


# ---------------------------------------------------------------- judging


def _suffixes(host: str, labels: int) -> list[str]:
    """The host's endings of at most `labels` labels, whole ones."""
    found, at = [], len(host)
    while len(found) < labels and at >= 0:
        at = host.rfind(".", 0, at)
        found.append(host[at + 1 :])
        if at < 0:
            break
    return found


def _best(judge: UrlFilter, hosts: pa.Array, paths: list[bytes]) -> tuple[list, list, list]:
    """Entry, verdict and tier of each url; None where nothing fits."""
    coded = hosts.dictionary_encode()
    ends = [(k, s.encode()) for k, host in enumerate(coded.dictionary.to_pylist()) for s in _suffixes(host, judge.labels)]
    strings = sorted({s for _, s in ends})
    place = {s: k for k, s in enumerate(strings)}
    lengths: dict[int, list[int]] = {}
    for query, value in zip(*(x.tolist() for x in judge.find("host", strings)), strict=True):
        lengths.setdefault(query, []).append(value)
    of_host: dict[int, list[tuple[bytes, int]]] = {}
    for k, s in ends:
        of_host.setdefault(k, []).extend((s, n) for n in lengths.get(place[s], ()))
    owner, wanted, sizes = [], [], []
    for k, (code, path) in enumerate(zip(coded.indices.to_pylist(), paths, strict=True)):
        for suffix, n in of_host.get(code, ()):
            if n <= len(path):
                owner.append(k)
                wanted.append(suffix + path[:n])
                sizes.append(len(suffix))
    entry, verdict, tier = ([None] * len(paths) for _ in range(3))
    best: list = [None] * len(paths)
    for query, value in zip(*(x.tolist() for x in judge.find("entry", wanted)), strict=True):
        k = owner[query]
        rank = (value // 2, -len(wanted[query]), -sizes[query], -(value % 2))
        if best[k] is None or rank < best[k]:
            best[k] = rank
            entry[k], verdict[k], tier[k] = wanted[query].decode(), "block" if value % 2 else "allow", value // 2
    return entry, verdict, tier


def judge(pages: DataFrame, judge: UrlFilter, id: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, entry, verdict (null where no entry fits) and tier."""
    rows = only(pages, id=id, url=url)
    rows = rows.select("id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))

    def run(batches):
        for part in slices(batches, "path"):
            host, path = column(part, "host"), column(part, "path")
            entry, verdict, tier = _best(judge, host, pc.cast(path, pa.binary()).to_pylist())
            yield batch(
                ["id", "host", "path", "entry", "verdict", "tier"],
                column(part, "id"), host, path, pa.array(entry, pa.string()), pa.array(verdict, pa.string()), pa.array(tier, pa.int32()),
            )

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, f"id {kind}, host string, path string, entry string, verdict string, tier int").withColumnRenamed("id", id)
