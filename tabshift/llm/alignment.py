"""Cross-tokenizer alignment with corpus-wide pair counts by external spill counting.

Two tokenizers cut the same bytes. Where tokens of both end, groups end; tokens whose byte
ranges overlap are linked, and as every segment between neighbouring ends belongs to one token
of each, the links are the segments. A pair's count is the number of documents that hold it.

1. A task aligns a slice of documents and sorts its pair-document records by (A id, B id),
   radix-partitioned by A id. A partition's records become a run of zstd blocks: pairs with
   their numbers of documents, and beside them, in the same order, the documents and how often
   each holds the link. A slice, with its documents' own results, is one row of a table.
2. Runs are merged in groups of at most about `FAN`: a heap of the runs' next blocks gives the
   key up to which all of them can be added up, so memory is a block a run. Merged runs are
   merged again until one a partition is left; as records of a pair are added up on the way,
   a hot pair is one record a run. The last merge goes by A id, then B id, so a token's
   highest count is known when the next token begins.
3. Each slice reads the counts of its partitions, memory-mapped, and adds them up by document.

Texts are cut into units before a space between two characters that are no white space, which
neither tokenizer joins across, so each distinct unit is tokenized and aligned once, and long
texts are handled in parts. A text is given back whole if each of its units is.

Defined cases: texts which are null, empty or which a tokenizer doesn't give back byte by byte
have no tokens: zeros and an empty `groups_sha256`, and they count for no pair. Repeated rows,
and null ids, are documents of their own. Other columns are ignored. A text without any cut is
one unit. An empty table gives no row.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm import files
from tabshift.llm.common import batch, bytes_of, column, map_arrow, only, slices, written
from tabshift.llm.text import runs

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes of a slice.
SLICE_BYTES = 4 << 20
#: Partitions by A id, runs of a merge, records of a block.
RADIX, FAN, BLOCK = 16, 64, 8192
#: Units whose alignment a task remembers.
KNOWN_UNITS = 300_000
#: Bits of a B id in a pair's key, and of a document's number beside a key.
B_BITS, DOC_BITS = 20, 22


# ---------------------------------------------------------------- tokenizers


class Tokens:
    """Ids of texts by both tokenizers, and the bytes of each id."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(first)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=second)
        byte = _byte_of_letter()
        pieces = [self.a.id_to_token(k) for k in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.bytes_a = pa.array([p.encode() if any(c not in byte for c in p) else bytes(byte[c] for c in p) for p in pieces], pa.large_binary())
        names = [(k, self.b.id_to_piece(k)) for k in range(self.b.get_piece_size())]
        self.bytes_b = pa.array(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in names], pa.large_binary()
        )

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


def _byte_of_letter() -> dict[str, int]:
    """Byte-level letters: printable bytes of Latin-1 stand for themselves, the others for
    the characters from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


# ---------------------------------------------------------------- units


def _lead(byte: np.ndarray) -> np.ndarray:
    """First bytes of characters of several bytes, none of them white space."""
    return ((byte >= 0xC3) & (byte <= 0xE0)) | (byte >= 0xE4)


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of units in texts that begin with a space each, ascending, texts' own included.
    A unit begins at a space after and before a character that is surely no white space."""
    padded = np.concatenate([np.zeros(4, np.uint8), data, np.zeros(1, np.uint8)])
    at = np.flatnonzero(data == 0x20)
    b4, b3, b2, b1, after = (padded[at + k] for k in (0, 1, 2, 3, 5))
    inner = lambda b: (b >= 0x80) & (b < 0xC0)
    seen = lambda b: (b > 0x20) & (b < 0x7F)
    before = seen(b1) | inner(b1) & (_lead(b2) & (b2 < 0xE0) | inner(b2) & (_lead(b3) & (b3 < 0xF0) | inner(b3) & (b4 >= 0xF0)))
    good = at[before & (seen(after) | _lead(after))]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    # a text's first and last byte have neighbours of other texts
    return np.union1d(np.setdiff1d(good, offsets[1:] - 1), starts)


def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for one in ids for x in one), np.int64, int(size.sum())), size


@dataclass
class Aligned:
    """Alignment of units: counts, the text of their groups, and linked pairs with how often."""

    good: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: list[bytes]
    pairs: np.ndarray
    times: np.ndarray
    ends: np.ndarray  # of each unit in pairs


@functools.cache
def _decimals() -> tuple[np.ndarray, np.ndarray]:
    return bytes_of(pa.array([str(k).encode() for k in range(1 << 17)], pa.large_binary()))


def _group_texts(a, b, ends_a, ends_b, common, unit_ends) -> list[bytes]:
    """`a1,a2|b1;...` of each unit, every group closed by a semicolon."""
    group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
    upto_a, upto_b = np.searchsorted(ends_a, common, side="right"), np.searchsorted(ends_b, common, side="right")
    before_b = np.concatenate([[0], upto_b])[group_a]
    place_a, place_b = np.arange(len(a)) + before_b, np.arange(len(b)) + upto_a[group_b]
    ids = np.empty(len(a) + len(b), np.int64)
    mark = np.full(len(ids), ord(","), np.uint8)
    ids[place_a], ids[place_b] = a, b
    mark[place_a[upto_a - 1]], mark[place_b[upto_b - 1]] = ord("|"), ord(";")
    digits, at = _decimals()
    size = at[ids + 1] - at[ids]
    ends = np.cumsum(size + 1)
    out = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    out[runs(ends - size - 1, size)] = digits[runs(at[ids], size)]
    out[ends - 1] = mark
    last = np.searchsorted(ends_a, unit_ends, side="right") + np.searchsorted(ends_b, unit_ends, side="right")
    stops = ends[last - 1].tolist()
    raw = out.tobytes()
    return [raw[x:y] for x, y in zip([0, *stops[:-1]], stops, strict=True)]


def align(tokens: Tokens, units: list[bytes]) -> Aligned:
    """`units`: not empty, each beginning with a space."""
    texts = [u.decode("utf-8", "replace") for u in units]
    parts: list[tuple] = []
    whole, bounds = bytes_of(pa.array(units, pa.large_binary()))
    length = np.diff(bounds)
    good = np.ones(len(units), bool)
    for ids, table in ((tokens.ids_a(texts), tokens.bytes_a), (tokens.ids_b([t[1:] for t in texts]), tokens.bytes_b)):
        flat, count = _flat(ids)
        data, at = bytes_of(table)
        size = at[flat + 1] - at[flat]
        owner = np.repeat(np.arange(len(units)), count)
        fits = np.bincount(owner, size, len(units)).astype(np.int64) == length
        keep = fits[owner]
        held = np.repeat(fits, length)
        differs = data[runs(at[flat[keep]], size[keep])] != whole[held]
        fits &= np.bincount(np.repeat(np.arange(len(units)), length)[held][differs], minlength=len(units)) == 0
        good &= fits
        parts.append((flat, size, owner, count))
    unit_ends = np.cumsum(length[good])
    (a, ends_a), (b, ends_b) = ((flat[good[owner]], np.cumsum(size[good[owner]])) for flat, size, owner, _ in parts)
    ends = np.union1d(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b, assume_unique=True)
    links = a[np.searchsorted(ends_a, ends)] << B_BITS | b[np.searchsorted(ends_b, ends)] if len(ends) else ends
    unit = np.searchsorted(unit_ends, ends)
    order = np.lexsort((links, unit))
    links, unit = links[order], unit[order]
    first = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1]) | (unit[1:] != unit[:-1])])[: len(links)])
    n = len(unit_ends)
    text = iter(_group_texts(a, b, ends_a, ends_b, common, unit_ends) if n else [])

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units), np.int64)
        out[good] = values
        return out

    return Aligned(
        good,
        *(np.where(good, count, 0) for *_, count in parts),
        spread(np.bincount(np.searchsorted(unit_ends, common), minlength=n)),
        spread(np.bincount(unit, minlength=n)),
        [next(text) if g else b"" for g in good.tolist()],
        links[first],
        np.diff(np.append(first, len(links))),
        np.cumsum(spread(np.bincount(unit[first], minlength=n))),
    )


class Units:
    """Aligned units by number; each distinct one is aligned once."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.stats = np.zeros((4, 0), np.int64)
        self.good = np.zeros(0, bool)
        self.pairs, self.times, self.first = (np.zeros(0, np.int64) for _ in range(3))
        self.size = np.zeros(0, np.int64)
        self.groups: list[bytes] = []

    def numbers(self, units: list[bytes]) -> np.ndarray:
        if len(self.known) > KNOWN_UNITS:
            self.clear()
        new = [u for u in units if u not in self.known]
        if new:
            found = align(self.tokens, new)
            self.known.update(zip(new, range(len(self.good), len(self.good) + len(new)), strict=True))
            size = np.diff(found.ends, prepend=0)
            self.first = np.concatenate([self.first, len(self.pairs) + found.ends - size])
            self.size = np.concatenate([self.size, size])
            self.pairs, self.times = np.concatenate([self.pairs, found.pairs]), np.concatenate([self.times, found.times])
            self.good = np.concatenate([self.good, found.good])
            self.stats = np.concatenate([self.stats, np.stack([found.n_a, found.n_b, found.n_groups, found.n_links])], axis=1)
            self.groups += found.groups
        return np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))


# ---------------------------------------------------------------- runs


def packed(*columns: np.ndarray) -> bytes:
    """Columns of one block as a zstd frame; integers as narrow as they can be."""
    parts = [np.array([len(columns[0]), *(np.min_scalar_type(int(c.max())).itemsize if len(c) else 1 for c in columns)], "<i8").tobytes()]
    for c in columns:
        parts.append(c.astype(np.min_scalar_type(int(c.max())) if len(c) else np.uint8).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(parts))


def unpacked(block: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, *width = np.frombuffer(raw, "<i8", columns + 1).tolist()
    at, out = 8 * (columns + 1), []
    for w in width:
        out.append(np.frombuffer(raw, f"<u{w}", n, at).astype(np.int64))
        at += n * w
    return out


def run_of(keys: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Blocks of a run: differences of ascending keys, and counts."""
    return [
        packed(np.diff(keys[k : k + BLOCK], prepend=0), counts[k : k + BLOCK]) for k in range(0, len(keys), BLOCK)
    ]


def read_run(blocks) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for block in blocks:
        steps, counts = unpacked(block, 2)
        yield np.cumsum(steps), counts


def merged(inputs: list[Iterator]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge of ascending runs; equal keys are added up. The heap holds the last key of
    each run's block in hand: up to the least of them nothing more can come."""
    heap, hand = [], {}

    def fill(k: int) -> None:
        for keys, counts in inputs[k]:
            hand[k] = keys, counts
            heapq.heappush(heap, (int(keys[-1]), k))
            return
        hand.pop(k, None)

    for k in range(len(inputs)):
        fill(k)
    while heap:
        bound = heap[0][0]
        taken = []
        for k, (keys, counts) in hand.items():
            upto = int(np.searchsorted(keys, bound, side="right"))
            if upto:
                taken.append((keys[:upto], counts[:upto]))
                hand[k] = keys[upto:], counts[upto:]
        keys, counts = map(np.concatenate, zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        yield keys[first], np.add.reduceat(counts[order], first)
        while heap and heap[0][0] == bound:
            fill(heapq.heappop(heap)[1])


# ---------------------------------------------------------------- steps


STATS = ["n_a", "n_b", "n_groups", "n_links"]


def spilled(docs: DataFrame, first: str, second: str, slice_bytes: int) -> DataFrame:
    """A row for each slice of documents (id, text): their results, and for each radix the
    run of pairs and, in its order, the documents and multiplicities of its records."""

    def run(batches):
        units = Units(Tokens(first, second))
        for part in slices(batches, "text", slice_bytes):
            for at in range(0, part.num_rows, 1 << DOC_BITS):
                yield _slice(units, part.slice(at, 1 << DOC_BITS))

    kind = docs.schema["id"].dataType.simpleString()
    arrays = ", ".join(f"{c} array<bigint>" for c in STATS)
    return map_arrow(docs, run, f"ids array<{kind}>, {arrays}, sha array<string>, pairs array<array<binary>>, links array<binary>")


def _slice(units: Units, part: pa.RecordBatch) -> pa.RecordBatch:
    raw, off = bytes_of(column(part, "text"))
    size = np.diff(off)
    size = size + (size > 0)
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.full(offsets[-1], 0x20, np.uint8)
    data[runs(offsets[:-1][size > 0] + 1, size[size > 0] - 1)] = raw
    starts = cuts(data, offsets)
    flat = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, offsets[-1]).astype(np.int64)), pa.py_buffer(data)]
    ).dictionary_encode()
    number = units.numbers(flat.dictionary.to_pylist())
    code = flat.indices.to_numpy(zero_copy_only=False)
    of_doc = np.searchsorted(starts, offsets)  # first unit of each document
    owner = np.repeat(np.arange(len(size)), np.diff(of_doc))
    unit = number[code]
    bad = np.bincount(owner[~units.good[unit]], minlength=len(size)) > 0
    kept = ~bad[owner]
    stats = np.zeros((4, len(size)), np.int64)
    for k in range(4):
        np.add.at(stats[k], owner[kept], units.stats[k][unit[kept]])
    sha, u = [], unit.tolist()
    for d, (x, y) in enumerate(zip(of_doc[:-1].tolist(), of_doc[1:].tolist(), strict=True)):
        text = b"" if bad[d] else b"".join([units.groups[k] for k in u[x:y]])[:-1]
        sha.append(hashlib.sha256(text).hexdigest() if text else "")
    pairs, links = _runs(units, unit[kept], owner[kept], len(size))
    one = lambda values, kind=pa.int64(): pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
    ids = column(part, "id")
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    return batch(
        ["ids", *STATS, "sha", "pairs", "links"],
        one(ids, ids.type), *(one(s) for s in stats), one(sha, pa.string()),
        pa.array([pairs], pa.list_(pa.list_(pa.binary()))), pa.array([links], pa.list_(pa.binary())),
    )


def _runs(units: Units, unit: np.ndarray, owner: np.ndarray, n_docs: int) -> tuple[list, list]:
    # distinct units of a document first, then their pairs
    keys, times = np.unique(unit * n_docs + owner, return_counts=True)
    unit, doc = keys // max(n_docs, 1), keys % max(n_docs, 1)
    at = runs(units.first[unit], units.size[unit])
    pair = units.pairs[at]
    doc, weight = np.repeat(doc, units.size[unit]), np.repeat(times, units.size[unit]) * units.times[at]
    radix = (pair >> B_BITS) % RADIX
    order = np.lexsort((doc, pair, radix))
    radix, pair, doc, weight = radix[order], pair[order], doc[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (doc[1:] != doc[:-1])])[: len(pair)])
    weight = np.add.reduceat(weight, first) if len(first) else weight
    radix, pair, doc = radix[first], pair[first], doc[first]
    pairs, links = [], []
    edges = np.searchsorted(radix, np.arange(RADIX + 1))
    for x, y in zip(edges[:-1], edges[1:], strict=True):
        head = np.flatnonzero(np.diff(pair[x:y], prepend=-1))
        pairs.append(run_of(pair[x:y][head], np.diff(np.append(head, y - x))))
        links.append(packed(doc[x:y], weight[x:y]))
    return pairs, links


def counted(stored: DataFrame) -> dict[int, str]:
    """Merges all runs; for each radix the file of its pairs, counts and marks of the highest."""
    spark = stored.sparkSession
    level = stored.select(F.posexplode("pairs").alias("radix", "run")).filter(F.size("run") > 0)
    n = stored.count()
    place = files.folder(spark, "pairs")

    def merge(table):
        run = merged([read_run(b.as_buffer() for b in r) for r in table.column("run")])
        blocks = [b for keys, counts in run for b in run_of(keys, counts)]
        return pa.table({"radix": table.column("radix")[:1], "run": pa.array([blocks], pa.list_(pa.binary()))})

    def finish(table):
        pieces = list(merged([read_run(b.as_buffer() for b in r) for r in table.column("run")]))
        keys, counts = map(np.concatenate, zip(*pieces, strict=True))
        first = np.flatnonzero(np.diff(keys >> B_BITS, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(keys))))
        head = np.array([len(keys)], np.int64)
        path = files.put(place, [x.tobytes() for x in (head, keys, counts, (counts == highest).astype(np.uint8))])
        return pa.table({"radix": table.column("radix")[:1], "path": [path]})

    while n > FAN:
        groups = -(-n // FAN)
        # by row, as runs of copied texts are equal: a group has about FAN runs of a radix
        dealt = level.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
        level = written(dealt.groupBy("radix", "part").applyInArrow(merge, "radix int, run array<binary>"))
        n = groups
    done = written(level.groupBy("radix").applyInArrow(finish, "radix int, path string"))
    return {r["radix"]: r["path"] for r in done.collect()}


@functools.lru_cache(maxsize=RADIX)
def _counts(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = files.view(path)
    (n,) = np.frombuffer(raw, np.int64, 1).tolist()
    return np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), np.frombuffer(raw, np.uint8, n, 8 + 16 * n)


def aligned(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    first: str | None = None,
    second: str | None = None,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each document."""
    rows = only(docs, id=id, text=text)
    found = spilled(rows, first or public_tokenizers.path(FIRST), second or public_tokenizers.path(SECOND), slice_bytes)
    stored = written(found)
    paths = counted(stored)

    def run(batches):
        for part in batches:
            for row in range(part.num_rows):
                get = lambda name, r=row, p=part: column(p, name)[r]
                ids = get("ids").values
                best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for radix, (blocks, links) in enumerate(zip(get("pairs"), get("links"), strict=True)):
                    if radix not in paths or not len(blocks.values):
                        continue
                    all_keys, all_counts, all_best = _counts(paths[radix])
                    pieces = list(read_run(b.as_buffer() for b in blocks))
                    keys, n_docs = map(np.concatenate, zip(*pieces, strict=True))
                    at = np.repeat(np.searchsorted(all_keys, keys), n_docs)
                    doc, times = unpacked(links.as_buffer(), 2)
                    np.add.at(total, doc, all_counts[at] * times)
                    np.add.at(best, doc, all_best[at] * times)
                yield batch(
                    ["id", *STATS, "n_best", "count_sum", "groups_sha256"],
                    ids, *(get(s).values for s in STATS), pa.array(best), pa.array(total), get("sha").values,
                )

    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{c} bigint" for c in [*STATS, "n_best", "count_sum"]), "groups_sha256 string"])
    return map_arrow(stored, run, schema).withColumnRenamed("id", id)
