"""Seeded corruption: typos, missing values, duplicate rows.

Steps are applied in the configured order and the step number is part of every
draw. After a duplicate step the copy number is part of the row identity, so
later steps treat the two copies independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.functions.draws import SLOTS, chance, digest, pick
from tabshift.functions.names import POS, ROW_ID, col, data_columns, has_position
from tabshift.specs import NoiseConfiguration, NoiseStep, SpecError

# (rows, step settings, seed, step number, columns that may change) -> rows
NoiseModel = Callable[[DataFrame, NoiseStep, int, int, list[str]], DataFrame]


def _digests(seed: int, number: str, count: int, prefix: str) -> dict[str, Column]:
    """One digest per four columns, as columns of their own: the projection that
    reads them stays small enough for the JVM to compile."""
    return {
        f"{prefix}{i}": digest(seed, f"{number}|{i}", F.col(ROW_ID))
        for i in range((count + SLOTS - 1) // SLOTS)
    }


def _hit(j: int, probability: float) -> Column:
    i, slot = divmod(j, SLOTS)
    return chance(F.col(f"_d{i}"), slot, probability)


def _rewrite(df: DataFrame, columns: list[str], cell: Callable[[int, Column], Column]) -> list[Column]:
    """All columns, with `cell(number, old)` in place of those that may change."""
    return [
        cell(columns.index(c), col(c)).alias(c) if c in columns else col(c) for c in df.columns
    ]


def _swap(cell: Column, at: Column) -> Column:
    """Exchange the characters at `at` and `at + 1` (0-based)."""
    return F.concat(
        F.substring(cell, F.lit(1), at),
        F.substring(cell, at + 2, F.lit(1)),
        F.substring(cell, at + 1, F.lit(1)),
        F.substring(cell, at + 3, F.length(cell)),
    )


def typo(df: DataFrame, step: NoiseStep, seed: int, number: int, columns: list[str]) -> DataFrame:
    """Swap two neighbouring characters of cells with at least two."""
    drawn = df.withColumns(
        {
            **_digests(seed, str(number), len(columns), "_d"),
            **_digests(seed, f"{number}p", len(columns), "_p"),
        }
    )
    places = {}
    for j, name in enumerate(columns):
        length = F.length(col(name))
        at = pick(F.col(f"_p{j // SLOTS}"), j % SLOTS, length - 1).cast("int")
        # only cells that are hit get a place
        places[f"_at{j}"] = F.when((length >= 2) & _hit(j, step.probability), at)
    changed = _rewrite(
        df,
        columns,
        lambda j, cell: F.when(F.col(f"_at{j}").isNotNull(), _swap(cell, F.col(f"_at{j}"))).otherwise(cell),
    )
    return drawn.withColumns(places).select(*changed)


def missing_value(
    df: DataFrame, step: NoiseStep, seed: int, number: int, columns: list[str]
) -> DataFrame:
    drawn = df.withColumns(_digests(seed, str(number), len(columns), "_d"))
    kept = lambda j, cell: F.when(~_hit(j, step.probability), cell)
    return drawn.select(*_rewrite(df, columns, kept))


def duplicate(
    df: DataFrame, step: NoiseStep, seed: int, number: int, columns: list[str]
) -> DataFrame:
    """A second whole copy directly after its original."""
    hit = chance(digest(seed, f"{number}|0", F.col(ROW_ID)), 0, step.probability)
    copies = F.when(hit, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = df.select("*", F.explode(copies).alias("_copy"))
    out = out.withColumn(ROW_ID, F.concat(F.col(ROW_ID), F.lit("."), F.col("_copy").cast("string")))
    if has_position(df):
        out = out.withColumn(POS, F.col(POS) * 2 + F.col("_copy"))
    return out.drop("_copy")


NOISE_MODELS: dict[str, NoiseModel] = {
    "typo": typo,
    "missing_value": missing_value,
    "duplicate": duplicate,
}


def row_identity(df: DataFrame, row_key: list[str] | None) -> Column:
    if row_key:
        # with the length before each part, different keys are different texts
        parts = []
        for k in row_key:
            text = col(k).cast("string")
            parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        return F.concat(*parts)
    if not has_position(df):
        raise SpecError("noise needs a row position or a row_key")
    return F.col(POS).cast("string")


def apply_noise(
    df: DataFrame,
    config: NoiseConfiguration,
    row_key: list[str] | None = None,
    models: dict[str, NoiseModel] | None = None,
) -> DataFrame:
    """Run the configured steps (NOI-4). A row is identified by its position, or
    by `row_key` for tables without one (streams, unordered tables); rows that repeat a
    whole key share their draws. No shuffle."""
    models = models or NOISE_MODELS
    columns = [c for c in data_columns(df) if c not in config.excluded_columns]
    out = df.withColumn(ROW_ID, row_identity(df, row_key))
    for number, step in enumerate(config.noise_types):
        model = models.get(step.type)
        if model is None:
            raise SpecError(f"no noise model named '{step.type}'")
        out = model(out, step, config.seed, number, columns)
    return out.drop(ROW_ID)
