"""Reading, lineage cuts and Arrow plumbing shared by the operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.session import cut_lineage

#: Text bytes handled at once inside a task; a longer single text is its own slice.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch on its way to a worker: Spark's own bound, 10,000 rows or 64 MB, is
#: held several times over, by the executor and by each of its workers.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame) -> DataFrame:
    """`df` as a table in the shared folder: later steps survive lost executors."""
    return cut_lineage(df)


def fresh(columns: list[str], *names: str) -> list[str]:
    """Names which clash with no column, whatever the case, for helper columns."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names: `only(df, id="doc_id")`."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


def training(column: F.Column, folds: int, held_out: int) -> F.Column:
    """Not in the held-out fold of crc32(id as text); a null id is held out, whatever the fold."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds != held_out, F.lit(False))


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a text or binary column, nulls as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    kind = array.type
    empty = b"" if pa.types.is_binary(kind) or pa.types.is_large_binary(kind) else ""
    if array.null_count:
        array = array.fill_null(empty)
    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(kind) else array
    _, offsets, data = array.buffers()
    off = np.frombuffer(offsets, np.int64, len(array) + 1, array.offset * 8) if offsets else np.zeros(1, np.int64)
    if data is None or len(off) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `most` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = bytes_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(off, off[at] + most, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _give_back() -> None:
    """Returns the memory that a task has freed: workers are kept for later tasks, and the
    allocators would hold on to it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, function, schema: str | T.StructType) -> DataFrame:
    """mapInArrow; every frame of an operator goes through here. Batches are bounded in the
    session, as the frame runs later; a session's own bound holds."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))

    def run(batches):
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)


def batch(names: list[str], *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names)


#: Bytes of a table that may be broadcast, by its counted rows.
BROADCAST_BYTES = 32 << 20


def checked_broadcast(table: DataFrame, row_bytes: int = 48) -> DataFrame:
    """A written, narrow table with a broadcast hint where its counted rows are few
    enough; beyond that the planner joins by shuffle."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table
