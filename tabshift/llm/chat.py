"""Chat formatting by columnar byte assembly.

Turns are sorted by conversation and turn over all tasks, so a conversation of any length is
spread over as many tasks as it needs. A task turns each slice of turns into one Arrow
buffer: segment lengths give offsets, offsets give scatter indices, and the constant marks,
roles and contents are copied straight to their places. A row of the output is a
conversation's share of a slice, with the byte spans of its loss mask; longer conversations
are several rows with ascending `segment`.

    <|im_start|>ROLE
    TEXT<|im_end|>

Inside texts, `<`, any number of backslashes, `|` gets one more backslash, so no control
string can start there; reading back takes one off. Inside roles, backslash, line feed and
`<` are written as backslash escapes.

Defined cases: null roles and texts are empty; a null conversation id is a conversation of
its own; equal turn numbers are ordered by role, then text, nulls first; repeated rows are
turns of their own; a conversation without assistant has an empty mask.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import bytes_of, column, map_arrow, slices, written

START, END = b"<|im_start|>", b"<|im_end|>\n"
LOSS_ROLE = "assistant"

_TURN = re.compile(re.escape(START) + rb"([^\n]*)\n(.*?)" + re.escape(END), re.S)
_PLAIN, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_OUT = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
_ROLE_IN = {v[1]: k for k, v in _ROLE_OUT.items()}


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return re.sub(r"[\\\n<]", lambda m: _ROLE_OUT[m[0]], role)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ROLE_IN[m[1]], role)


def _escaped(texts: pa.Array, pattern: str, change) -> pa.Array:
    """`change` only on the rows where `pattern` occurs."""
    hit = np.flatnonzero(pc.match_substring_regex(texts, pattern).fill_null(False).to_numpy(zero_copy_only=False))
    if not len(hit):
        return texts
    values = texts.to_pylist()
    for k in hit:
        values[k] = change(values[k])
    return pa.array(values, pa.large_string())


def assemble(parts: list[bytes | pa.Array]) -> tuple[pa.Buffer, np.ndarray, list[np.ndarray]]:
    """Rows of the parts side by side in one buffer; n + 1 row offsets; each part's start
    in every row. A part is a constant or a column."""
    columns = [p if isinstance(p, bytes) else bytes_of(p) for p in parts]
    n = next(len(c[1]) - 1 for c in columns if not isinstance(c, bytes))
    sizes = np.stack([np.full(n, len(c)) if isinstance(c, bytes) else np.diff(c[1]) for c in columns], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    starts = ends - sizes
    buffer = pa.allocate_buffer(int(ends[-1, -1]) if n else 0)
    out = np.frombuffer(buffer, np.uint8)
    for k, c in enumerate(columns):
        if isinstance(c, bytes):
            out[starts[:, k, None] + np.arange(len(c))] = np.frombuffer(c, np.uint8)
        else:
            out[np.arange(len(c[0])) + np.repeat(starts[:, k] - c[1][:-1], sizes[:, k])] = c[0]
    offsets = np.concatenate([[0], ends[:, -1]])
    return buffer, offsets, list(starts.T)


def format_chats(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """conversation, segment, text and loss spans (bytes of `text`)."""
    rows = turns.select(
        *(F.col(f"`{c}`").alias(n) for c, n in ((conversation, "conv"), (turn, "turn"), (role, "role"), (text, "text")))
    ).orderBy("conv", "turn", "role", "text")

    def run(batches):
        segment = TaskContext.get().partitionId() << 33
        for part in slices(batches, "text"):
            roles = column(part, "role").cast(pa.large_string()).fill_null("")
            texts = column(part, "text").cast(pa.large_string()).fill_null("")
            buffer, offsets, starts = assemble(
                [START, _escaped(roles, r"[\\\n<]", escape_role), b"\n", _escaped(texts, r"<\\*\|", escape), END]
            )
            conv = column(part, "conv")
            same = pc.fill_null(pc.equal(conv[1:], conv[:-1]), False)
            both_null = pc.and_(pc.is_null(conv[1:]), pc.is_null(conv[:-1]))
            same = pc.or_(same, both_null).to_numpy(zero_copy_only=False)
            first = np.concatenate([[0], np.flatnonzero(~same) + 1])
            edge = np.append(offsets[first], offsets[-1])
            loss = np.flatnonzero(pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False))
            base = np.repeat(edge[:-1], np.diff(np.append(first, part.num_rows)))
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(starts[3][loss] - base[loss], pa.int32()),
                    pa.array(starts[4][loss] - base[loss], pa.int32()),
                ],
                ["start", "end"],
            )
            per_row = np.searchsorted(loss, np.append(first, part.num_rows))
            yield pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(first)),
                    pa.array(segment + np.arange(len(first))),
                    pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(edge.astype(np.int64)), buffer).cast(pa.string()),
                    pa.ListArray.from_arrays(pa.array(per_row, pa.int32()), spans),
                ],
                ["conv", "segment", "text", "loss"],
            )
            segment += len(first)

    kind = rows.schema["conv"].dataType.simpleString()
    out = map_arrow(rows, run, f"conv {kind}, segment bigint, text string, loss array<struct<start:int,end:int>>")
    return out.withColumnRenamed("conv", conversation)


class _Reader:
    """Running digests of one conversation."""

    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: bytes, loss: list[dict]) -> None:
        self.chars += len(text.decode())
        for m in _TURN.finditer(text):
            self.n_turns += 1
            self.turns.update(f"{unescape_role(m[1].decode())}\n{unescape(m[2].decode())}\n".encode())
        for span in loss:
            said = unescape(text[span["start"] : span["end"]].decode())
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def chat_digests(chats: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Parses formatted chats back: one row per conversation. Digests run on, segment after
    segment, so a task holds one segment at a time, whatever a conversation's length."""
    kind = chats.schema[conversation].dataType.simpleString()
    rows = chats.withColumnRenamed(conversation, "conv").repartition("conv").sortWithinPartitions("conv", "segment")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        reader = None
        for part in slices(batches, "text"):
            done = []
            for conv, text, loss in zip(
                column(part, "conv").to_pylist(),
                column(part, "text").cast(pa.large_binary()).to_pylist(),
                column(part, "loss").to_pylist(),
                strict=True,
            ):
                if reader is None or reader.conv != conv:
                    done += [reader.row()] if reader else []
                    reader = _Reader(conv)
                reader.add(text, loss)
            if done:
                yield _rows(part.schema.field("conv").type, done, names)
            kept = part.schema.field("conv").type
        if reader:
            yield _rows(kept, [reader.row()], names)

    schema = f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return map_arrow(rows, run, schema).withColumnRenamed("conv", conversation)


def _rows(kind: pa.DataType, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(turns: DataFrame, **columns: str) -> DataFrame:
    """Formats, writes, reads back and digests."""
    return chat_digests(written(format_chats(turns, **columns)), columns.get("conversation", "conv_id"))
