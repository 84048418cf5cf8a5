"""Scores of a candidate table against the expected one.

Every metric is a function of a `Scoring` context and returns a one-row
DataFrame (name, score, details). The context holds the pieces several metrics
need, so the best-row match is computed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.functions.cells import is_populated
from tabshift.functions.names import IDX, POS, col, data_columns
from tabshift.operators.compare import multiset_overlap
from tabshift.operators.filters import apply_filtering
from tabshift.operators.match import best_match
from tabshift.operators.order import first_per_key, with_index
from tabshift.specs import NoiseConfiguration, Task

METRIC_SCHEMA = "name string, score double, details map<string,string>"
# a record counts as right from eight tenths of its cells on
NEAR_TENTHS = 8


@dataclass
class Scoring:
    """One candidate table and what it is scored against. `truth`, `output`,
    `clean` and `noisy` need positions where order matters."""

    output: DataFrame
    truth: DataFrame
    task: Task | None = None
    noise: NoiseConfiguration | None = None
    clean: DataFrame | None = None
    noisy: DataFrame | None = None

    @cached_property
    def columns(self) -> list[str]:
        return data_columns(self.truth)

    @cached_property
    def comparable(self) -> bool:
        return self.columns == data_columns(self.output)

    @cached_property
    def matches(self) -> DataFrame:
        """Best output row per truth row, read by three metrics."""
        return best_match(self.truth, self.output)

    def fixed(self, name: str, score: float, **details: str) -> DataFrame:
        """A score that does not depend on the rows."""
        row = (name, float(score), {k: str(v) for k, v in details.items()})
        return self.truth.sparkSession.createDataFrame([row], METRIC_SCHEMA)


Metric = Callable[[Scoring], DataFrame]


def _scored(df: DataFrame, metric: str, value: Column, /, **details: Column) -> DataFrame:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    return df.select(
        F.lit(metric).alias("name"), value.alias("score"), F.create_map(*pairs).alias("details")
    )


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole, 1.0 when there is nothing to get right."""
    return F.when(whole == 0, F.lit(1.0)).otherwise(
        part.cast("double") / F.nullif(whole, F.lit(0)).cast("double")
    )


def schema_accuracy(s: Scoring) -> DataFrame:
    """Share of expected columns found by name at their place. No job."""
    actual = data_columns(s.output)
    hits = sum(a == e for a, e in zip(actual, s.columns))
    score = hits / len(s.columns) if s.columns else 1.0
    return s.fixed("schema_accuracy", score, expected_columns=s.columns, actual_columns=actual)


def row_accuracy(s: Scoring) -> DataFrame:
    """Share of expected rows present as a whole, copies counted."""
    if not s.comparable:
        return s.fixed("row_accuracy", 0.0, reason="column mismatch")
    overlap = multiset_overlap(s.truth, s.output)
    return _scored(
        overlap, "row_accuracy", _ratio(F.col("matched_rows"), F.col("left_rows")),
        matched_rows=F.col("matched_rows"), expected_rows=F.col("left_rows"),
    )


def filtering_accuracy(s: Scoring) -> DataFrame:
    """Closeness of the row counts."""
    sides = s.truth.select(F.lit(1).alias("e")).unionAll(s.output.select(F.lit(0).alias("e")))
    counts = sides.agg(
        F.count_if(F.col("e") == 1).alias("expected"), F.count_if(F.col("e") == 0).alias("actual")
    )
    expected, actual = F.col("expected"), F.col("actual")
    off = F.abs(actual - expected).cast("double") / F.nullif(expected, F.lit(0)).cast("double")
    score = F.when(expected == 0, (actual == 0).cast("double")).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - off)
    )
    return _scored(counts, "filtering_accuracy", score, expected_rows=expected, actual_rows=actual)


def populated_fractions(output: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the populated share per expected column; 0 for a column the
    output lacks and for an output without rows (AGG-4). One pass for all."""
    present = set(data_columns(output))
    return output.agg(
        *[
            (
                F.coalesce(F.avg(is_populated(col(c)).cast("double")), F.lit(0.0))
                if c in present
                else F.lit(0.0)
            ).alias(c)
            for c in columns
        ]
    )


def field_mapping_accuracy(s: Scoring) -> DataFrame:
    """Mean populated share over the expected columns."""
    if not s.columns:
        return s.fixed("field_mapping_accuracy", 1.0)
    shares = populated_fractions(s.output, s.columns)
    total = sum((col(c) for c in s.columns), F.lit(0.0))
    return _scored(
        shares, "field_mapping_accuracy", total / len(s.columns), **{c: col(c) for c in s.columns}
    )


def _match_totals(s: Scoring) -> DataFrame:
    cells = len(s.columns)
    near = (F.col("matched") * 10 >= cells * NEAR_TENTHS) & F.lit(cells > 0)
    return s.matches.agg(
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched_cells"),
        (F.count(F.lit(1)) * cells).alias("total_cells"),
        F.count_if(near).alias("near_matches"),
        F.count(F.lit(1)).alias("total_records"),
    )


def transformation_accuracy(s: Scoring) -> DataFrame:
    """Share of cells that agree with the best output row."""
    if not s.comparable:
        return s.fixed("transformation_accuracy", 0.0, reason="column mismatch")
    return _scored(
        _match_totals(s), "transformation_accuracy",
        _ratio(F.col("matched_cells"), F.col("total_cells")),
        matched_cells=F.col("matched_cells"), total_cells=F.col("total_cells"),
    )


def record_accuracy(s: Scoring) -> DataFrame:
    """Share of records whose best output row agrees on 80 % of the cells."""
    if not s.comparable:
        return s.fixed("record_accuracy", 0.0, reason="column mismatch")
    return _scored(
        _match_totals(s), "record_accuracy",
        _ratio(F.col("near_matches"), F.col("total_records")),
        near_matches=F.col("near_matches"), total_records=F.col("total_records"),
        threshold=F.lit(NEAR_TENTHS / 10),
    )


def changed_columns(clean: DataFrame, noisy: DataFrame, key: str) -> DataFrame:
    """Per key, which columns the noise changed (JOI-1): clean rows joined with
    the first noisy row of the same key, as an array of column names."""
    first = first_per_key(noisy, [key])
    names = [c for c in data_columns(clean) if c != key]
    noisy_row = first.select(
        col(key), F.struct(*[col(c) for c in names if c in first.columns]).alias("_noisy")
    )
    flags = [
        F.when(~col(c).eqNullSafe(F.col("_noisy").getField(c)), F.lit(c))
        for c in names
        if c in first.columns
    ]
    return clean.join(noisy_row, key).withColumn("_changed", F.array_compact(F.array(*flags)))


def rule_targets(task: Task | None) -> list[tuple[str, str]]:
    """(source field, target field) pairs; one source may feed several targets."""
    rules = (task.business_rules.mappings if task else None) or []
    return [(source, rule.target_field) for rule in rules for source in rule.sources]


def rule_fanout(changed: DataFrame, task: Task) -> DataFrame:
    """Each changed cell once per target field it feeds (JOI-2)."""
    rules = changed.sparkSession.createDataFrame(
        rule_targets(task), "source_field string, target_field string"
    )
    cells = changed.withColumn("source_field", F.explode("_changed")).drop("_changed")
    # as large as the mapping rules of the task
    return cells.join(F.broadcast(rules), "source_field")


def error_correction_accuracy(s: Scoring) -> DataFrame:
    """Were values that the noise damaged right in the output? Damaged source
    cells are traced to the target fields they feed, in the truth row that the
    clean row became and in the best output row of that truth row."""
    name = "error_correction_accuracy"
    if s.noise is None:
        return s.fixed(name, 1.0, applicable=False, reason="no noise configuration")
    if not s.noise.excluded_columns:
        return s.fixed(name, 1.0, applicable=False, reason="no excluded columns to join on")
    key = s.noise.excluded_columns[0]
    if key not in s.clean.columns or key not in s.noisy.columns:
        return s.fixed(name, 1.0, applicable=False, reason=f"join key '{key}' not found")

    kept = apply_filtering(s.clean, s.task.business_rules.filtering)
    if not s.comparable:
        if kept.count() != s.truth.count():
            return s.fixed(name, 1.0, applicable=False, reason="filtered clean size differs")
        return s.fixed(name, 0.0, applicable=True, reason="column mismatch")

    pairs = [(a, b) for a, b in rule_targets(s.task) if b in s.columns]
    if not pairs:
        return s.fixed(name, 1.0, applicable=True, reason="no noisy field is mapped")
    targets = sorted({b for _, b in pairs})

    # truth row i is what the i-th kept clean row became
    damaged = changed_columns(with_index(kept), s.noisy, key).filter(F.size("_changed") > 0)
    truth = with_index(s.truth).select(
        IDX, F.col(POS).alias("_t"), F.struct(*[col(c) for c in targets]).alias("_want")
    )
    output = s.output.select(
        F.col(POS).alias("_o"), F.struct(*[col(c) for c in targets]).alias("_got")
    )
    best = s.matches.select(F.col("truth_pos").alias("_t"), F.col("output_pos").alias("_o"))
    traced = (
        damaged.select(IDX, "_changed")
        .join(truth, IDX)
        .join(best, "_t")
        .join(output, "_o", "left")
    )

    def is_damaged(source: str) -> Column:
        return F.array_contains("_changed", source)

    def is_right(target: str) -> Column:
        same = F.col("_want").getField(target).eqNullSafe(F.col("_got").getField(target))
        return F.col("_got").isNotNull() & same

    zero = F.lit(0)
    checked = sum((is_damaged(a).cast("int") for a, _ in pairs), zero)
    correct = sum(((is_damaged(a) & is_right(b)).cast("int") for a, b in pairs), zero)
    # row counts and cell counts go through one aggregate
    parts = [
        (traced, zero, zero, checked, correct),
        (kept, F.lit(1), zero, zero, zero),
        (s.truth, zero, F.lit(1), zero, zero),
    ]
    names = ("kept", "expected", "checked", "correct")
    rows = None
    for df, *counts in parts:
        part = df.select(*[c.cast("bigint").alias(n) for n, c in zip(names, counts)])
        rows = part if rows is None else rows.unionAll(part)
    totals = rows.agg(*[F.coalesce(F.sum(n), zero).alias(n) for n in names])
    applicable = F.col("kept") == F.col("expected")
    return _scored(
        totals, name,
        F.when(~applicable, F.lit(1.0)).otherwise(_ratio(F.col("correct"), F.col("checked"))),
        applicable=applicable, checked=F.col("checked"), correct=F.col("correct"),
    )


def reproduction_score(original: DataFrame, again: DataFrame) -> DataFrame:
    """Row agreement of a table with its re-derivation (MET-8)."""
    return row_accuracy(Scoring(output=again, truth=original)).withColumn(
        "name", F.lit("reproducibility")
    )


METRICS: dict[str, Metric] = {
    "schema_accuracy": schema_accuracy,
    "row_accuracy": row_accuracy,
    "filtering_accuracy": filtering_accuracy,
    "field_mapping_accuracy": field_mapping_accuracy,
    "transformation_accuracy": transformation_accuracy,
    "record_accuracy": record_accuracy,
    "error_correction_accuracy": error_correction_accuracy,
}
