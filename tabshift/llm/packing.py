"""Best-fit packing by minimum bin slack.

Texts are tokenized and cut into pieces of at most `capacity` tokens. What the packing
decides depends on the lengths alone, so it runs on their histogram: at most `capacity`
counts, however large the corpus. For each bin the longest open piece is fixed, and a subset
sum over the lengths still available, kept as bits of one integer, gives the fullest
feasible rest. A combination is used as often as its lengths allow, which is what repeating
the search would give. The plan then names, for each length, intervals of ranks; a piece
finds its bin, slot and offset from its rank among the pieces of its length. Ranks are a
prefix sum of counts per input chunk, so no length is ever gathered in one task.

Defined cases: a null text is empty; an empty text is the closing id alone; repeated rows
are pieces of their own; an empty table gives no row.
"""

from __future__ import annotations

import functools
import itertools
import os
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabshift.llm.common import bytes_of, column, map_arrow, slices, written

CAPACITY = 2048
CLOSING_ID = 0
TOKENIZER = "word_bpe_49k.json"
SLICE_BYTES = 4 << 20
#: Words whose ids a task remembers.
KNOWN_WORDS = 600_000
#: Words encoded at once: the tokenizer's result takes far more memory than the ids in it.
ENCODED_WORDS = 4096
#: Punctuation that never joins a letter or digit before it.
_TAIL = ".,!?;:%$*&#"


def tokenizer_path(name: str = TOKENIZER) -> str:
    return public_tokenizers.path(name)


# ---------------------------------------------------------------- tokens


@functools.cache
def _closed(last: str) -> bool:
    """Whether a word's last character is a letter or digit for the tokenizer, which
    composes and lower-cases: `İ` ends in a mark then, and marks join punctuation. Only
    characters that all versions of Unicode since 3.2 know count."""
    forms = {last, unicodedata.normalize("NFC", last).lower(), unicodedata.normalize("NFC", last.lower())}
    return all(f and unicodedata.ucd_3_2_0.category(f[-1])[0] in "LN" for f in forms)


class WordTokens:
    """Token ids of whole texts, word by word.

    The vocabulary drops white space and never joins across it, so a text's ids are its
    white-space separated words' ids one after the other. Nor does it join a letter or digit,
    once composed and lower-cased, with punctuation after it, and it has no capitals: a word's core in small letters and its
    tail are encoded apart, each distinct one once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encode = Tokenizer.from_file(path).encode_batch_fast
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _numbers(self, words: list[str], core: pa.Array, tail: pa.Array) -> tuple[np.ndarray, ...]:
        if len(self.known) > KNOWN_WORDS:
            self._clear()
        new = [w for w in words if w not in self.known]
        if new:
            sizes, flats = [], []
            for at in range(0, len(new), ENCODED_WORDS):
                ids = [e.ids for e in self.encode(new[at : at + ENCODED_WORDS], add_special_tokens=False)]
                sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flats.append(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(sizes[-1].sum())))
            size = np.concatenate(sizes)
            first = len(self.flat) + np.cumsum(size) - size
            self.known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
            self.first, self.size = np.concatenate([self.first, first]), np.concatenate([self.size, size])
            self.flat = np.concatenate([self.flat, *flats])
        number = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        place = pa.array(words, core.type)
        return tuple(number[pc.index_in(part, place).to_numpy()] for part in (core, tail))

    @staticmethod
    def _parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Core and tail of distinct words. Words with the mark of a special token stay
        as they are, and so do those whose core, normalised, would not end in a letter or digit."""
        special = pc.match_substring(words, "<|")
        small = pc.if_else(special, words, pc.ascii_lower(words))
        core = pc.utf8_rtrim(small, characters=_TAIL)
        last = pc.utf8_slice_codeunits(core, -1).dictionary_encode()
        closed = pa.array([_closed(c) for c in last.dictionary.to_pylist()], pa.bool_())
        apart = pc.and_(closed.take(last.indices), pc.invert(special))
        data, offsets = bytes_of(small)
        size = pc.binary_length(core).to_numpy()
        left = np.diff(offsets) - size
        bounds = np.concatenate([[0], np.cumsum(left)])
        tails = pa.LargeStringArray.from_buffers(
            len(small), pa.py_buffer(bounds), pa.py_buffer(_gather(data, offsets[:-1] + size, left))
        )
        return pc.if_else(apart, core, small), pc.if_else(apart, tails, pa.scalar("", small.type))

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and n + 1 offsets."""
        core, tail = self._parts(words)
        numbers = self._numbers(pa.concat_arrays([core, tail]).unique().to_pylist(), core, tail)
        # a word without a tail has the empty word there, which has no ids
        both = np.stack(numbers, axis=1).ravel()
        size = self.size[both]
        ends = np.concatenate([[0], np.cumsum(size)])
        return _gather(self.flat, self.first[both], size), ends[::2]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text closed by CLOSING_ID, and n + 1 offsets."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        flat = split.flatten().dictionary_encode()
        known, at = self._of_words(flat.dictionary)
        word = flat.indices.to_numpy()
        size = np.diff(at)[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        of_text = split.offsets.to_numpy() - split.offsets[0].as_py()
        counts = ends[of_text[1:]] - ends[of_text[:-1]]
        offsets = np.concatenate([[0], np.cumsum(counts + 1)])
        out = np.full(offsets[-1], CLOSING_ID, np.uint32)
        open_ = np.ones(len(out), bool)
        open_[offsets[1:] - 1] = False
        out[open_] = _gather(known, at[word], size)
        return out, offsets


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of `values` by their first places and sizes, one after the other."""
    ends = np.cumsum(size)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]


PIECES = "id {id}, piece int, start bigint, length bigint, ids_crc32 bigint, chunk int, nth bigint"


def pieces(docs: DataFrame, id: str, text: str, capacity: int, path: str, keep_ids: bool, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Pieces with the number of their chunk and their rank in it among equal lengths."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.spark_partition_id().alias("chunk"))

    def run(batches):
        tokens, seen = WordTokens(path), {}
        for part in slices(batches, "text", slice_bytes):
            ids, offsets = tokens.ids(column(part, "text"))
            total = np.diff(offsets)
            count = -(-total // capacity)
            text_of = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(text_of)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(total[text_of] - start, capacity)
            at = offsets[text_of] + start
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            chunk = column(part, "chunk")[0].as_py()
            have = seen.setdefault(chunk, np.zeros(capacity + 1, np.int64))
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            head = np.searchsorted(ordered, ordered, side="left")
            nth = np.empty(len(length), np.int64)
            nth[order] = np.arange(len(length)) - head + have[ordered]
            have += np.bincount(length, minlength=capacity + 1)
            arrays = [
                column(part, "id").take(pa.array(text_of)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array(np.full(len(length), chunk), pa.int32()),
                pa.array(nth, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32", "chunk", "nth"]
            if keep_ids:  # pieces follow each other without gaps, so the ids are already in place
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, run, PIECES.format(id=kind) + ", ids array<int>" * keep_ids)


# ---------------------------------------------------------------- the plan


@dataclass
class Plan:
    """Intervals of ranks by length. Entry k covers ranks from `rank[k]` of `length[k]`,
    `copies[k]` in each bin from `bin[k]` on, placed at `offset[k]` of the bin."""

    length: np.ndarray
    rank: np.ndarray
    bin: np.ndarray
    copies: np.ndarray
    offset: np.ndarray
    n_bins: int


def fullest(open_: dict[int, int], order: list[int], room: int) -> list[tuple[int, int]]:
    """(length, copies) of the fullest combination of at most `room`: a subset sum whose
    reachable totals are the bits of an integer. `order`: open lengths, longest first."""
    mask, reach = (2 << room) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, copies, totals reached before
    for length in order:
        if length > room:
            continue
        left, take = min(open_[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    total, found = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            found[length] = found.get(length, 0) + take
    return sorted(found.items(), reverse=True)


def minimum_slack(counts: dict[int, int], capacity: int) -> Plan:
    open_ = {n: c for n, c in counts.items() if c > 0}
    order = sorted(open_, reverse=True)
    used = dict.fromkeys(order, 0)
    rows, n_bins = [], 0
    while order:
        longest = order[0]
        open_[longest] -= 1
        combination = dict(fullest(open_, [n for n in order if open_[n]], capacity - longest))
        open_[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(open_[n] // c for n, c in combination.items())
        offset = 0
        for n in sorted(combination, reverse=True):
            c = combination[n]
            rows.append((n, used[n], n_bins, c, offset))
            used[n] += c * times
            open_[n] -= c * times
            offset += n * c
        n_bins += times
        order = [n for n in order if open_[n]]
    table = np.array(sorted(rows), np.int64).reshape(len(rows), 5)
    return Plan(*table.T, n_bins)


# ---------------------------------------------------------------- operators


def pack(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str | None = None,
    keep_ids: bool = False,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset and, on demand, the ids."""
    found = written(pieces(docs, id, text, capacity, tokenizer or tokenizer_path(), keep_ids, slice_bytes))
    by_chunk = found.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = minimum_slack(counts, capacity)
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_chunk.select("length", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = found.join(starts, ["length", "chunk"]).withColumn("rank", F.col("nth") + F.col("before")).drop("nth", "before", "chunk")
    key = plan.length << 48 | plan.rank

    def place(batches):
        for part in batches:
            if not part.num_rows:
                continue
            length = column(part, "length").to_numpy(zero_copy_only=False)
            rank = column(part, "rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length << 48 | rank, side="right") - 1
            inner = rank - plan.rank[k]
            sequence = plan.bin[k] + inner // plan.copies[k]
            offset = plan.offset[k] + inner % plan.copies[k] * length
            kept = [n for n in part.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(column(part, n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    kept = [f for f in ranked.schema.fields if f.name != "rank"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    placed = map_arrow(ranked, place, schema)
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids]
    return placed.select(names).withColumnRenamed("id", id)


def sequences(packed: DataFrame) -> DataFrame:
    """The training rows: sequence_id and its ids in place. A sequence is at most
    `capacity` tokens, so a group is bounded. Needs `pack(..., keep_ids=True)`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
