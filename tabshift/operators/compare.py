"""Comparison of whole tables: row multisets, positions, value overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.functions.cells import fingerprint
from tabshift.functions.names import IDX, POS, col, data_columns
from tabshift.operators.order import with_index
from tabshift.session import cut_lineage

#: Ranks of a block of the hash tree, in bits.
BLOCK_BITS = 10
#: Rows of a few numbers that are sent to every task.
SENT_ROWS = 500_000


def row_multiset(df: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, null equal to null (AGG-7)."""
    names = data_columns(df)
    return df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("n"))


def multiset_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row (left_rows, right_rows, matched_rows) with matched_rows the size
    of the multiset intersection (SET-1). Both sides go through one shuffle of
    row fingerprints, and copies of a row are counted before it."""
    key_1, key_2 = fingerprint([col(c) for c in data_columns(left)])
    sides = [
        df.select(
            key_1.alias("_k1"),
            key_2.alias("_k2"),
            F.lit(in_left).cast("bigint").alias("_l"),
            F.lit(1 - in_left).cast("bigint").alias("_r"),
        )
        for df, in_left in ((left, 1), (right, 0))
    ]
    counts = (
        sides[0].unionAll(sides[1]).groupBy("_k1", "_k2").agg(F.sum("_l").alias("l"), F.sum("_r").alias("r"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return counts.agg(
        total(F.col("l")).alias("left_rows"),
        total(F.col("r")).alias("right_rows"),
        total(F.least("l", "r")).alias("matched_rows"),
    )


def _ranked_prints(df: DataFrame, names: list[str]) -> DataFrame:
    """(_idx, _pos, _k1, _k2): rank, position and fingerprint of each row. The table is read
    once, for 24 bytes a row; ranks are computed over these."""
    key_1, key_2 = fingerprint([col(c) for c in names])
    prints = cut_lineage(df.select(POS, key_1.alias("_k1"), key_2.alias("_k2")))
    return cut_lineage(with_index(prints))


def _sent(table: DataFrame) -> DataFrame:
    """A written table of numbers; few rows go to every task."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(_idx, _left, _right): ranks at which two tables differ, and both positions there,
    null where a side has no row. A written table.

    A hash tree of two levels: fingerprints are combined for each 2**10 ranks, and only the
    ranks of blocks that differ are compared; whole rows are never moved."""
    names = data_columns(left)
    sides = [_ranked_prints(df, names) for df in (left, right)]
    block = F.shiftright(IDX, BLOCK_BITS)

    def combined(df: DataFrame) -> DataFrame:
        one = lambda salt: F.bit_xor(F.xxhash64(F.lit(salt), F.col(IDX), F.col("_k1"), F.col("_k2")))
        return df.groupBy(block.alias("_b")).agg(F.struct(F.count("*"), one(2), one(3)).alias("_hash"))

    a, b = (combined(s).withColumnRenamed("_hash", n) for s, n in zip(sides, ("_ha", "_hb")))
    blocks = _sent(cut_lineage(a.join(b, "_b", "full_outer").filter(~F.col("_ha").eqNullSafe(F.col("_hb"))).select("_b")))
    a, b = (
        s.join(blocks, block == F.col("_b"), "left_semi").select(IDX, F.col(POS).alias(n), F.struct("_k1", "_k2").alias(f"{n}_print"))
        for s, n in zip(sides, ("_left", "_right"))
    )
    rows = a.join(b, IDX, "full_outer").filter(~F.col("_left_print").eqNullSafe(F.col("_right_print")))
    return cut_lineage(rows.select(IDX, "_left", "_right"))


def positional_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that differ when both tables are read in order (SET-3): the index,
    which side lacks the row, and the columns that differ. Null equals null. Only rows that
    differ are fetched."""
    names = data_columns(left)
    differing = _sent(differing_rows(left, right))

    def fetched(df: DataFrame, place: str) -> DataFrame:
        wanted = differing.select(IDX, place)
        row = F.struct(F.lit(1), *[col(c).alias(f"c{i}") for i, c in enumerate(names)])
        return df.select(F.col(POS).alias(place), row.alias(f"{place}_row")).join(wanted, place).drop(place)

    both = fetched(left, "_left").join(fetched(right, "_right"), IDX, "full_outer")
    cell = lambda side, i: F.col(f"{side}_row").getField(f"c{i}")
    differs = [F.when(~cell("_left", i).eqNullSafe(cell("_right", i)), F.lit(c)) for i, c in enumerate(names)]
    missing = F.col("_left_row").isNull() | F.col("_right_row").isNull()
    return both.select(
        F.col(IDX).alias("row_index"),
        F.when(F.col("_left_row").isNull(), "left").when(F.col("_right_row").isNull(), "right").alias("missing_side"),
        F.when(missing, F.array().cast("array<string>"))
        .otherwise(F.array_compact(F.array(*differs).cast("array<string>")))
        .alias("columns"),
    )


def value_leaks(source: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Per protected column, how many distinct synthetic values also occur in the
    source (SYN-9, JOI-5). All columns share one shuffle of distinct values."""

    def values(df: DataFrame) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns]
        )
        return df.select(F.inline(pairs)).filter(F.col("value").isNotNull()).distinct()

    leaked = values(synthetic).join(values(source), ["column", "value"], "left_semi")
    counts = leaked.groupBy("column").agg(F.count(F.lit(1)).alias("leaked_values"))
    names = source.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # one row per protected column on both sides
    return names.join(F.broadcast(counts), "column", "left").select(
        "column", F.coalesce("leaked_values", F.lit(0)).cast("bigint").alias("leaked_values")
    )
