"""Benchmark decontamination with an FM-index for each shard of the documents.

A task cuts its rows into shards of bounded bytes. A shard's index text holds the runs of
consecutive words that occur in the benchmark at all and that are long enough for some
window; a window consists of benchmark words only, so nothing can be missed. Runs are
separated by a symbol that no window has. On that text stand a suffix array, its
Burrows-Wheeler transform as a wavelet matrix and sampled suffix positions. All windows are
searched backwards at once, occurrences are located by walking to a sampled position, and
overlapping occurrences merge into spans of hit words.

The benchmark is the stated query set: it is gathered once, in blocks of bounded size, and
refused above `MAX_QUERY_BYTES`. Documents are never shuffled.

Defined cases: null or empty texts have no words and no hits; an item without words has no
window; equal items under different ids are all reported; rows with the same item id are one
item; a null item id is reported as `null`; repeated documents each keep their row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.llm.common import column, fresh, map_arrow, slices
from tabshift.llm.text import ALNUM, Words, words

WINDOW = 10
SAMPLE = 16
SHARD_BYTES = 4 << 20
BLOCK_WINDOWS = 100_000
MAX_QUERY_BYTES = 256 << 20

RESULT = "n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"


# ---------------------------------------------------------------- the query set


@dataclass
class Block:
    """Windows over a vocabulary of word hashes; symbol k + 1 is vocab[k]."""

    vocab: np.ndarray
    lengths: list[int]
    windows: dict[int, np.ndarray]  # length -> rows of symbols
    items: dict[int, tuple[np.ndarray, np.ndarray]]  # length -> offsets, item numbers
    names: list[str]


def _block(items: list[tuple[str, np.ndarray]], size: int) -> Block:
    vocab = np.unique(np.concatenate([h for _, h in items]))
    names = sorted({n for n, _ in items})
    number = {n: k for k, n in enumerate(names)}
    found: dict[int, dict[tuple, set[int]]] = {}
    for name, h in items:
        symbols = np.searchsorted(vocab, h) + 1
        n = min(size, len(h))
        for at in range(len(h) - n + 1):
            found.setdefault(n, {}).setdefault(tuple(symbols[at : at + n].tolist()), set()).add(number[name])
    windows, owners = {}, {}
    for n, rows in found.items():
        windows[n] = np.array(list(rows), np.int64).reshape(len(rows), n)
        counts = [len(x) for x in rows.values()]
        owners[n] = (np.concatenate([[0], np.cumsum(counts)]), np.array([y for x in rows.values() for y in sorted(x)]))
    return Block(vocab, sorted(found), windows, owners, names)


def query_blocks(benchmark: DataFrame, item: str, text: str, size: int, block_windows: int) -> list[Block]:
    """The benchmark's windows in blocks; gathered on the driver behind a size check."""
    rows = benchmark.select(
        F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("null")).alias("item"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if total > MAX_QUERY_BYTES:
        raise ValueError(f"the benchmark has {total} bytes; at most {MAX_QUERY_BYTES} are searched for at once")
    blocks, part, n = [], [], 0
    for row in rows.toLocalIterator():
        w = words(pa.array([row["text"]]), ALNUM, lower=True)
        if len(w.starts):
            part.append((row["item"], w.hashes()))
            n += len(w.starts)
        if n >= block_windows:
            blocks.append(_block(part, size))
            part, n = [], 0
    return blocks + ([_block(part, size)] if part else [])


# ---------------------------------------------------------------- the index


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; `text` holds ranks."""
    n = len(text)
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while True:
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh_rank = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh_rank
        step *= 2
        if fresh_rank[-1] == n - 1 or step >= n:
            return order


class FmIndex:
    """Count and locate over a text of symbols in which 0 separates runs and ends the text."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        n = len(text)
        gaps = np.flatnonzero(text == 0)
        ranks = text.astype(np.int64) + len(gaps)
        ranks[gaps] = np.arange(len(gaps))  # separators differ from each other: no run compares beyond its end
        suffixes = suffix_array(ranks)
        bwt = text[suffixes - 1]
        # a walk back stops at a run's first word at the latest, never crossing a separator
        sampled = np.zeros(n, bool)
        sampled[::sample] = True
        sampled[0] = True
        sampled[gaps[:-1] + 1] = True
        self.position = np.where(sampled[suffixes], suffixes, -1)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.levels = max(1, int(n_symbols).bit_length())
        self.ones, self.zeros = [], []
        level = bwt
        for bit in reversed(range(self.levels)):
            high = (level >> bit & 1).astype(bool)
            self.ones.append(np.concatenate([[0], np.cumsum(high)]).astype(np.int32))
            self.zeros.append(int(n - high.sum()))
            level = np.concatenate([level[~high], level[high]])
        self.n = n
        symbols = np.arange(n_symbols + 1)
        self.base = self._down(symbols, np.zeros(n_symbols + 1, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(reversed(range(self.levels))):
            ones = self.ones[level][at]
            at = np.where(symbol >> bit & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before `at`."""
        return self._down(symbol, at) - self.base[symbol]

    def back(self, row: np.ndarray) -> np.ndarray:
        """Rows of the suffixes one word longer."""
        at, symbol = row, np.zeros(len(row), np.int64)
        for level in range(self.levels):
            ones = self.ones[level]
            bit = ones[at + 1] - ones[at]
            symbol = symbol * 2 + bit
            at = np.where(bit, self.zeros[level] + ones[at], at - ones[at])
        return self.below[symbol] + at - self.base[symbol]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of all patterns of one length, searched backwards."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        alive = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k]
            low[alive] = self.below[symbol] + self.rank(symbol, low[alive])
            high[alive] = self.below[symbol] + self.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
        high[low >= high] = 0
        low[high == 0] = 0
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back to a sampled suffix, plus the steps."""
        out, at = np.empty(len(rows), np.int64), rows.copy()
        open_, steps = np.arange(len(rows)), 0
        while len(open_):
            found = self.position[at[open_]]
            done = found >= 0
            out[open_[done]] = found[done] + steps
            open_ = open_[~done]
            at[open_] = self.back(at[open_])
            steps += 1
        return out


def occurrences(block: Block, w: Words, h: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each window length: first word of each occurrence, the length, window number."""
    if not len(h):
        return
    symbol = np.searchsorted(block.vocab, h)
    symbol[symbol == len(block.vocab)] = 0
    known = block.vocab[symbol] == h
    owner = w.owner()
    joined = known[1:] & known[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(known & ~np.concatenate([[False], joined]))
    last = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
    long_ = last - first >= block.lengths[0]
    first, last = first[long_], last[long_]
    if not len(first):
        return
    size = last - first
    start = np.concatenate([[0], np.cumsum(size + 1)])  # a separator after each run
    text, place = np.zeros(start[-1], np.int64), np.full(start[-1], -1)
    inner = np.arange(start[-1]) - np.repeat(start[:-1], size + 1)
    word = np.repeat(first, size + 1) + inner
    real = inner < np.repeat(size, size + 1)
    place[real] = word[real]
    text[real] = symbol[word[real]] + 1
    index = FmIndex(text, len(block.vocab))
    for n in block.lengths:
        low, high = index.search(block.windows[n])
        count = high - low
        window = np.repeat(np.arange(len(count)), count)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(len(window))
        yield place[index.locate(rows)], n, window


def scan(texts: pa.Array, blocks: list[Block]) -> tuple[Words, np.ndarray, list[set[str]]]:
    """Words of a shard, which of them are hit, and the items of each text."""
    w = words(texts, ALNUM, lower=True)
    h = w.hashes()
    edge = np.zeros(len(h) + 1, np.int64)
    items: list[set[str]] = [set() for _ in range(len(texts))]
    owner = w.owner()
    for block in blocks:
        for at, n, window in occurrences(block, w, h):
            edge += np.bincount(at, minlength=len(edge)) - np.bincount(at + n, minlength=len(edge))
            offsets, names = block.items[n]
            seen = np.unique(owner[at] * len(offsets) + window)
            for text, k in zip((seen // len(offsets)).tolist(), (seen % len(offsets)).tolist(), strict=True):
                items[text].update(block.names[x] for x in names[offsets[k] : offsets[k + 1]])
    return w, np.cumsum(edge)[:-1] > 0, items


def _spans(w: Words, hit: np.ndarray, text: int) -> list[tuple[int, int]]:
    """Byte spans of a text's merged runs of hit words."""
    at, end = w.first[text], w.first[text + 1]
    inner = np.concatenate([[False], hit[at:end], [False]])
    edges = np.flatnonzero(inner[1:] != inner[:-1])
    base = w.offsets[text]
    return [
        (int(w.starts[at + a] - base), int(w.ends[at + b - 1] - base))
        for a, b in zip(edges[::2], edges[1::2], strict=True)
    ]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


# ---------------------------------------------------------------- operators


def _broadcast(docs: DataFrame, benchmark: DataFrame, item: str, item_text: str, size: int, block_windows: int):
    context = docs.sparkSession.sparkContext
    return [context.broadcast(b) for b in query_blocks(benchmark, item, item_text, size, block_windows)]


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: id, word counts, hit words, items and spans of hit bytes."""
    sent = _broadcast(docs, benchmark, item, item_text, size, block_windows)

    def run(batches):
        blocks = [b.value for b in sent]
        for shard in slices(batches, "text", SHARD_BYTES):
            w, hit, items = scan(column(shard, "text"), blocks)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_hit = total[w.first[1:]] - total[w.first[:-1]]
            digest = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
            spans = [
                [{"start": a, "end": b} for a, b in _spans(w, hit, k)] if n else [] for k, n in enumerate(n_hit)
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    column(shard, "id"),
                    pa.array(w.counts, pa.int64()),
                    pa.array(n_hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(n_hit > 0),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                ["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
            )

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = map_arrow(rows, run, f"id {kind}, {RESULT}, spans array<struct<start:int,end:int>>")
    return out.withColumnRenamed("id", id)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The documents with every hit span cut out of `text`; all other columns as they were.
    Cutting may join words into a new occurrence, so changed texts are searched again until
    none is left; each round shortens a text."""
    sent = _broadcast(docs, benchmark, item, item_text, size, block_windows)
    (clean,) = fresh(docs.columns, "clean_text")

    def run(batches):
        blocks = [b.value for b in sent]
        for shard in slices(batches, text, SHARD_BYTES):
            texts = column(shard, text)
            values, open_ = None, np.arange(len(texts))
            part = texts
            while len(open_):
                w, hit, _ = scan(part, blocks)
                total = np.concatenate([[0], np.cumsum(hit)])
                hot = np.flatnonzero(total[w.first[1:]] > total[w.first[:-1]])
                if not len(hot):
                    break
                values = texts.to_pylist() if values is None else values
                for k in hot:
                    raw = values[open_[k]].encode()
                    values[open_[k]] = _cut(raw, _spans(w, hit, k)).decode()
                open_ = open_[hot]
                part = pa.array([values[k] for k in open_], pa.string())
            changed = texts if values is None else pa.array(values, texts.type)
            yield pa.RecordBatch.from_arrays([*shard.columns, changed], [*shard.schema.names, clean])

    kept = docs.columns
    out = map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(clean, T.StringType())]))
    return out.select(*(F.col(clean).alias(c) if c == text else F.col(f"`{c}`") for c in kept))
