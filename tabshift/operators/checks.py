"""Checks on tables; every check yields issue rows and none stops the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions.names import col, data_columns
from tabshift.specs import Metadata, NoiseConfiguration, Scenario, Schema, Task

ISSUE_SCHEMA = "severity string, code string, subject string, message string, rows bigint"
Issue = tuple[str, str, str, str, int]


def issue_frame(spark: SparkSession, issues: list[Issue]) -> DataFrame:
    return spark.createDataFrame(issues, ISSUE_SCHEMA)


def _error(code: str, subject: str, message: str) -> Issue:
    return ("error", code, subject, message, None)


def target_column_issues(df: DataFrame, schema: Schema, table: str) -> list[Issue]:
    """Column names and order against the target schema (VAL-2..4). No job."""
    issues = []
    present = data_columns(df)
    extra = [c for c in present if c not in schema.names]
    if extra:
        issues.append(_error("unexpected_column", table, f"columns not in target schema: {extra}"))
    for attribute in schema.attributes:
        if attribute.required and attribute.name not in present:
            issues.append(
                _error("missing_required_column", table, f"no required column '{attribute.name}'")
            )
    expected = [n for n in schema.names if n in present]
    if present != expected:
        issues.append(
            _error("column_order_mismatch", table, f"columns {present}, schema order {expected}")
        )
    return issues


def source_column_issues(df: DataFrame, schema: Schema, table: str) -> list[Issue]:
    """Column set against the source schema; only a warning (VAL-7). No job."""
    present = data_columns(df)
    missing = [n for n in schema.names if n not in present]
    extra = [c for c in present if c not in schema.names]
    if not missing and not extra:
        return []
    text = f"columns do not match source schema (missing={missing}, extra={extra})"
    return [("warning", "clean_dataset_schema_mismatch", table, text, None)]


def _issue_struct(severity: str, code: str, subject: Column, message: Column, rows: Column) -> Column:
    return F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"),
        message.alias("message"), rows.cast("bigint").alias("rows"),
    )


def duplicated_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of values that occur more than once; two nulls are
    duplicates as well (AGG-8). All columns share one shuffle, and copies are
    counted before it."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(pairs))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )


def value_issues(df: DataFrame, schema: Schema, table: str) -> DataFrame:
    """Missing and repeated values and a table without rows (VAL-5, VAL-6, VAL-8) in one pass:
    every row gives its values of unique columns, its missing required cells and itself to
    one aggregate, which counts them before its shuffle."""
    required = [a.name for a in schema.attributes if a.required and a.name in df.columns]
    unique = [a.name for a in schema.attributes if a.unique and a.name in df.columns]

    def entry(kind: str, column: str | None, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(column).cast("string").alias("column"), value.cast("string").alias("value"))

    nothing = F.lit(None).cast("string")
    values = [entry("value", c, col(c)) for c in unique]
    nulls = [F.when(col(c).isNull(), entry("null", c, nothing)) for c in required]
    entries = F.array_compact(F.array(entry("row", None, nothing), *values, *nulls))
    counts = df.select(F.inline(entries)).groupBy("kind", "column", "value").agg(F.count(F.lit(1)).alias("n"))
    kinds = counts.filter("kind <> 'value' or n > 1").groupBy("kind", "column").agg(F.sum("n").alias("n"))
    text = {"null": "required column '%s' has missing values", "value": "unique column '%s' has repeated values"}
    found = kinds.select(
        F.when(F.col("kind") == "null", _issue_struct("error", "required_value_missing", F.lit(table), F.format_string(text["null"], "column"), F.col("n")))
        .when(F.col("kind") == "value", _issue_struct("error", "uniqueness_violation", F.lit(table), F.format_string(text["value"], "column"), F.col("n")))
        .alias("issue"),
        "kind",
    )
    empty = _issue_struct("error", "empty_csv", F.lit(table), F.lit("table has no rows"), F.lit(None))
    no_rows = F.when(F.count_if(F.col("kind") == "row") == 0, empty)
    # a row for each column with an issue
    listed = found.agg(F.array_compact(F.concat(F.collect_list("issue"), F.array(no_rows))).alias("issues"))
    return listed.select(F.inline("issues"))


def null_counts(df: DataFrame) -> DataFrame:
    """Missing cells per column, one pass (AGG-9)."""
    return df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in data_columns(df)])


def structure_issues(df: DataFrame, table: str) -> list[Issue]:
    """A table needs columns and rows (VAL-8); reads at most one row."""
    issues = []
    if not data_columns(df):
        issues.append(_error("no_columns", table, "table has no columns"))
    if df.isEmpty():
        issues.append(_error("empty_csv", table, "table has no rows"))
    return issues


def metadata_issues(
    scenario: Scenario, task: Task, metadata: Metadata, noise: NoiseConfiguration | None
) -> list[Issue]:
    """Ids, seed and declared quality agree (VAL-9, VAL-10). No job."""
    issues = []
    for code, mine, other in (
        ("scenario_id_mismatch", metadata.scenario_id, scenario.scenario_id),
        ("task_id_mismatch", metadata.task_id, task.task_id),
    ):
        if mine != other:
            issues.append(_error(code, "metadata", f"metadata says '{mine}', not '{other}'"))
    if noise is not None and metadata.seed is not None and metadata.seed != noise.seed:
        text = f"metadata seed {metadata.seed}, noise seed {noise.seed}"
        issues.append(("warning", "seed_mismatch", "metadata", text, None))
    if (noise is not None) != (metadata.data_quality == "noisy"):
        state = "present" if noise is not None else "absent"
        text = f"data_quality is '{metadata.data_quality}', noise configuration is {state}"
        issues.append(_error("data_quality_mismatch", "metadata", text))
    return issues


def difference_issue(diff: DataFrame, code: str, table: str, message: str) -> DataFrame:
    """One issue with the number of differing rows, or none."""
    found = diff.agg(F.count(F.lit(1)).alias("rows")).filter("rows > 0")
    issue = _issue_struct("error", code, F.lit(table), F.lit(message), F.col("rows"))
    return found.select(F.inline(F.array(issue)))
