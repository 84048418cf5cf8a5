"""The log of scored runs: JSON documents in, JSON documents and reports out."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabshift.functions.names import IDX, POS
from tabshift.operators.order import dense_positions, placed_in_order, with_index, with_position
from tabshift.plans.evaluate import EvaluationResult

#: Lines of a part file, about.
FILE_ROWS = 1 << 20
RESULT_FILE = "evaluation_result.json"
_METRIC = "struct<name: string, score: double, details: variant>"
LOG_SCHEMA = (
    f"task_id string, agent_name string, metrics array<{_METRIC}>, passed boolean, "
    f"timestamp timestamp, error string, reproducibility {_METRIC}, "
    "duration_seconds double, metadata string"
)


def _read(spark: SparkSession, root: str, pattern: str, multi_line: bool) -> DataFrame:
    place = F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return (
        spark.read.schema(LOG_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .option("multiLine", multi_line)
        .json(root)
        .select("*", place.alias("_order"))
    )


def read_results(spark: SparkSession, root: str, pattern: str = RESULT_FILE) -> DataFrame:
    """Every result document below `root`, one document per file, loaded in path
    order. Details stay variants and metadata the text of its object, in the order of its
    keys, so texts and numbers are told apart."""
    return _read(spark, root, pattern, multi_line=True)


def read_result_log(spark: SparkSession, root: str) -> DataFrame:
    """Results written by `write_results`: one document per line."""
    return _read(spark, root, "part-*", multi_line=False)


def results_frame(spark: SparkSession, results: list[EvaluationResult]) -> DataFrame:
    """Scored runs as rows, metadata as JSON text."""
    from tabshift.plans.evaluate import RESULT_SCHEMA

    return spark.createDataFrame([r.row() for r in results], RESULT_SCHEMA)


def document(df: DataFrame) -> Column:
    """A row as one JSON document. A text column `metadata` is stored as the object it
    spells, its keys in their order; columns with a leading underscore are left out."""
    names = [c for c in df.columns if not c.startswith("_")]
    if dict(df.dtypes).get("metadata") != "string":
        return F.to_json(F.struct(*names))
    rest = F.to_json(F.struct(*[c for c in names if c != "metadata"]))
    valid = F.when(F.try_parse_json("metadata").isNull(), F.raise_error(F.concat(F.lit("metadata is no JSON: "), "metadata")).cast("string"))
    spelled = F.coalesce(valid, F.translate("metadata", "\n\r", "  "))
    mark = F.when(rest == "{}", "").otherwise(",")
    with_it = F.concat(F.regexp_replace(rest, r"\}$", ""), mark, F.lit('"metadata":'), spelled, F.lit("}"))
    return F.when(F.col("metadata").isNull(), rest).otherwise(with_it)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON document per run and line."""
    df.select(document(df).alias("value")).write.mode("append").option("compression", "none").text(f"{path}")


def report_lines(results: DataFrame, summary: DataFrame, generated_at: datetime) -> DataFrame:
    """(value, _pos): the lines of one JSON document with `generated_at`, `results` in their
    order and `summaries` as first seen."""
    spark = results.sparkSession
    placed = results if POS in results.columns else with_position(results, "_order")
    lines = with_index(placed.select(document(results).alias("value"), POS))
    n = lines.count()
    by_agent = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first")) - 1  # one row per agent
    agents = summary.select(F.to_json(F.struct(*[c for c in summary.columns if c != "first"])).alias("value"), by_agent.alias(IDX))
    listed = lambda df, at: df.select(F.concat(F.when(F.col(IDX) > 0, ",").otherwise(""), "value").alias("value"), (F.col(IDX) + at).cast("bigint").alias(POS))
    frame = spark.createDataFrame(
        [(f'{{"generated_at": "{generated_at.isoformat()}", "results": [', 0), ('], "summaries": [', n + 1), ("]}", 1 << 62)],
        f"value string, {POS} bigint",
    )
    return frame.unionAll(listed(lines, 1)).unionAll(listed(agents, n + 2))


def write_report_document(results: DataFrame, summary: DataFrame, folder: str, generated_at: datetime | None = None) -> None:
    """The report as one JSON document (SNK-3). It is written by many tasks: the part files
    of `folder`/report_document, put together in the order of their names, are the document."""
    lines = report_lines(results, summary, generated_at or datetime.now(timezone.utc))
    placed_in_order(dense_positions(lines), FILE_ROWS).select("value").write.mode("overwrite").text(f"{folder}/report_document")


def write_report(summary: DataFrame, markdown: str, folder: str) -> None:
    """Aggregate report as JSON rows and as text."""
    spark = summary.sparkSession
    summary.write.mode("overwrite").json(f"{folder}/report_json")
    text = spark.createDataFrame([(markdown,)], T.StructType([T.StructField("value", T.StringType())]))
    text.coalesce(1).write.mode("overwrite").text(f"{folder}/report_md")
