"""Row positions and order-dependent operators.

A table's order is carried by the unique long column `_pos`. Ranks over it are
computed by a radix prefix sum: rows are grouped by the high bits of `_pos`, so
no group can exceed 2**16 rows whatever the distribution of positions, and only
group counts are ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tabshift.functions.names import IDX, POS, col
from tabshift.session import cut_lineage

_ROW_BITS = 16
_GROUP_BITS = 20
# groups of positions (16 bytes each) that are sent to every task
_SENT_GROUPS = 1 << 20


def _before(window: WindowSpec) -> Column:
    """Running sum of `_n` without the current row."""
    return F.coalesce(
        F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )


def group_offsets(df: DataFrame) -> DataFrame:
    """(_g, _offset): for each 2**16 positions, how many rows come before them (WIN-1)."""
    group = F.shiftright(F.col(POS), _ROW_BITS)
    super_group = F.shiftright(F.col("_g"), _GROUP_BITS)
    # one row per 2**16 positions, written: the input is read once for it, by its
    # position column alone, and once for the rows
    counts = cut_lineage(df.groupBy(group.alias("_g")).agg(F.count(F.lit(1)).alias("_n")))
    super_counts = counts.groupBy(super_group.alias("_s")).agg(F.sum("_n").alias("_n"))
    # at most 2**27 rows, one per 2**36 positions: a handful for ranks and keys, one per
    # 8 splits for CSV scans, whose positions leave 2**33 numbers to each split
    super_offsets = super_counts.select(
        "_s", _before(Window.partitionBy(F.lit(0)).orderBy("_s")).alias("_super_offset")
    )
    within = _before(Window.partitionBy(super_group).orderBy("_g")).alias("_group_offset")
    joined = counts.select("_g", super_group.alias("_s"), within).join(super_offsets, "_s")
    return joined.select("_g", (F.col("_super_offset") + F.col("_group_offset")).alias("_offset"))


def with_index(df: DataFrame, name: str = IDX) -> DataFrame:
    """Add the 0-based rank of `_pos` (WIN-1)."""
    offsets = group_offsets(df)
    # `_g` is a column of its own, so that the join below finds the rows already
    # partitioned by it and does not shuffle them again
    grouped = df.select("*", F.shiftright(F.col(POS), _ROW_BITS).alias("_g"))
    rank = F.row_number().over(Window.partitionBy("_g").orderBy(POS))
    ranked = grouped.select("*", rank.alias("_rank"))
    index = F.col("_offset") + F.col("_rank") - 1
    return ranked.join(offsets, "_g").select(*[col(c) for c in df.columns], index.alias(name))


def placed_in_order(df: DataFrame, rows: int) -> DataFrame:
    """Partitions of about `rows` rows which are in order, one after the other and in
    themselves. A row's partition follows from the number of rows before its 2**16
    positions, so nothing is sampled and no range is cut; rows are shuffled once."""
    offsets = cut_lineage(group_offsets(df))
    n, last = offsets.agg(F.count("*"), F.max("_offset")).first()
    if not n:
        return df.limit(0)
    place = F.floor(F.col("_offset") / rows).cast("int")
    placed = df.select("*", F.shiftright(F.col(POS), _ROW_BITS).alias("_g")).join(
        F.broadcast(offsets) if n <= _SENT_GROUPS else offsets, "_g"
    )
    dealt = placed.withColumn("_place", place).repartitionById(last // rows + 1, F.col("_place"))
    return dealt.sortWithinPartitions(POS).drop("_g", "_offset", "_place")


def dense_positions(df: DataFrame) -> DataFrame:
    """Replace positions by ranks, which survive writing and reading back."""
    ranked = with_index(df)
    return ranked.select(*[F.col(IDX).alias(POS) if c == POS else col(c) for c in df.columns])


def with_position(df: DataFrame, *order_by: str | Column) -> DataFrame:
    """Give a table positions by sorting it on arbitrary columns. The order must
    be total. Sorted rows are materialised once, because the numbers come from
    the physical layout of the range-partitioned sort."""
    ordered = df.orderBy(*order_by).withColumn(POS, F.monotonically_increasing_id())
    return cut_lineage(ordered)


def first_per_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """First row per key in table order (WIN-2). The least position of each key is a hash
    aggregate over keys and positions alone, reduced on the map side, so a hot key is never
    gathered; whole rows are then fetched by position. Null is a key like any other."""
    least = df.groupBy(*[col(k) for k in keys]).agg(F.min(POS).alias(POS)).select(POS)
    return df.join(least, POS, "left_semi")


def first_seen(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels with their count and first position (WIN-4, AGG-6)."""
    return (
        df.filter(col(label).isNotNull())
        .groupBy(col(label).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(POS).alias("first_pos"))
    )
