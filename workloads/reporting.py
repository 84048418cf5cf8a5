"""Run-log reports, and round trips through the sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabshift.functions.names import POS, col
from tabshift.operators.order import with_index
from tabshift.operators.summary import agent_sections, metadata_means, metric_means, summarize
from tabshift.plans.report import report
from tabshift.session import shared_folder
from tabshift.sources.csv import positioned, read_table, write_table
from tabshift.sources.results import RESULT_FILE, document, read_result_log, read_results, write_report_document, write_results
from workloads.tables import ORDERS, RUNS, orders, run_log


def report_summary(spark, sf_dir):
    s = summarize(run_log(spark, sf_dir))
    return s.select(
        "agent_name",
        "total_tasks",
        "passed_tasks",
        "failed_tasks",
        F.round("pass_rate", 6).alias("pass_rate"),
        F.round("success_rate", 6).alias("success_rate"),
        F.round("average_duration_seconds", 6).alias("average_duration_seconds"),
    )


def _means(df, name):
    return df.select("agent_name", name, "n", F.round("mean", 6).alias("mean"))


def report_metric_means(spark, sf_dir):
    return _means(metric_means(run_log(spark, sf_dir)), "metric")


def report_metadata_means(spark, sf_dir):
    return _means(metadata_means(run_log(spark, sf_dir)), "key")


METRIC_MEANS = f"""
WITH runs AS ({RUNS})
SELECT agent_name, metric, count(*) AS n, round(avg(score), 6) AS mean FROM (
  SELECT agent_name, 'row_accuracy' AS metric, least(1.0, value / 400.0::DOUBLE) AS score FROM runs WHERE ok
  UNION ALL SELECT agent_name, 'record_accuracy', least(1.0, value / 200.0::DOUBLE) FROM runs WHERE ok
  UNION ALL SELECT agent_name, 'reproducibility', least(1.0, value / 300.0::DOUBLE) FROM runs WHERE value >= 50)
GROUP BY ALL"""
METADATA_MEANS = f"""
SELECT agent_name, 'k' AS key, count(*) AS n, round(avg(k), 6) AS mean FROM ({RUNS}) GROUP BY ALL"""
SUMMARY = f"""
SELECT agent_name, count(*) AS total_tasks, count(*) FILTER (WHERE passed) AS passed_tasks,
  count(*) FILTER (WHERE NOT passed) AS failed_tasks,
  round(count(*) FILTER (WHERE passed) / CAST(count(*) AS DOUBLE), 6) AS pass_rate,
  round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 6) AS success_rate,
  round(avg(value), 6) AS average_duration_seconds
FROM ({RUNS}) GROUP BY 1"""


def report_markdown(spark, sf_dir):
    """The section of each agent, metrics in first-seen order."""
    return agent_sections(summarize(run_log(spark, sf_dir))).select("agent_name", "section")


MARKDOWN = f"""
WITH runs AS ({RUNS}),
s AS (SELECT agent_name, count(*) AS total, count(*) FILTER (WHERE passed) AS p,
      count(*) FILTER (WHERE ok) AS ok, avg(value) AS d, avg(k) AS k,
      avg(least(1.0, value / 400.0::DOUBLE)) FILTER (WHERE ok) AS m1,
      avg(least(1.0, value / 200.0::DOUBLE)) FILTER (WHERE ok) AS m2,
      avg(least(1.0, value / 300.0::DOUBLE)) FILTER (WHERE value >= 50) AS m3,
      min(event_id) FILTER (WHERE ok) AS f1, min(event_id) FILTER (WHERE value >= 50) AS f3
      FROM runs GROUP BY 1)
SELECT agent_name, format('## {{}}' || chr(10) || '- Tasks: {{}} ({{}} passed, {{}} failed) - pass rate: {{:.1f}}%, success rate: {{:.1f}}%'
  || chr(10) || '- Average duration: {{:.1f}}s', agent_name, total, p, total - p, p * 100.0::DOUBLE / total, ok * 100.0::DOUBLE / total, d)
  || chr(10) || '- Average scores:' || format(chr(10) || '  - row_accuracy: {{:.3f}}' || chr(10) || '  - record_accuracy: {{:.3f}}'
  || chr(10) || '  - reproducibility: {{:.3f}}', m1, m2, m3)
  || chr(10) || '- Average metadata:' || format(chr(10) || '  - k: {{:.2f}}', k) || chr(10) AS section
FROM s"""


def csv_roundtrip(spark, sf_dir):
    """Orders written as CSV and read back in the same sequence."""
    folder = shared_folder(spark, "csv")
    write_table(orders(spark, sf_dir), folder)
    back = with_index(read_table(spark, folder))
    return back.select(*[col(c) for c in back.columns if c not in (POS, "_idx")], F.col("_idx").alias("row_index"))


def csv_semicolon(spark, sf_dir):
    """A semicolon file with missing-value texts; the delimiter is found out."""
    folder = shared_folder(spark, "csv")
    status = F.when(F.col("status") == "F", F.lit("N/A")).otherwise(F.col("status"))
    df = orders(spark, sf_dir).select(
        col("order no."), status.alias("status"), F.concat(F.col("total"), F.lit('"; x')).alias("note")
    )
    df.write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)
    return read_table(spark, folder).drop(POS)


def json_results_scan(spark, sf_dir):
    """Run log written as result documents, read back, means recomputed."""
    folder = shared_folder(spark, "results")
    log = run_log(spark, sf_dir).withColumn("task_id", F.col(POS).cast("string"))
    write_results(log, folder)
    back = read_result_log(spark, folder)
    return _means(metadata_means(back), "key")


# --- keys in the order of the documents, the report as one document ------------


def _keyed_log(spark, sf_dir):
    """The run log with metadata whose keys are in no order of the alphabet."""
    part = lambda n: (F.col(POS) % n).cast("string")
    text = F.concat(F.lit('{"z": '), part(5), F.lit(', "note": "7", "a": '), part(3), F.lit(', "m": '), part(11), F.lit("}"))
    return run_log(spark, sf_dir).withColumns({"metadata": text, "task_id": F.concat(F.lit("T"), part(4))})


def report_key_order(spark, sf_dir):
    """Metadata lines of the report, after a round trip through the log."""
    folder = shared_folder(spark, "results")
    write_results(_keyed_log(spark, sf_dir), folder)
    sections = agent_sections(summarize(read_result_log(spark, folder)))
    lines = F.regexp_extract_all("section", F.lit(r"  - ([a-z]: [0-9.]+)"), F.lit(1))
    return sections.select("agent_name", F.array_join(lines, ", ").alias("metadata"))


KEY_ORDER = """
SELECT event_type AS agent_name, format('z: {:.2f}, a: {:.2f}, m: {:.2f}', avg(event_id % 5), avg(event_id % 3), avg(event_id % 11)) AS metadata
FROM events GROUP BY 1"""


def _read_lines(spark, folder):
    """Lines of a document in parts, in order."""
    raw = spark.read.text(folder)
    return with_index(positioned(spark, folder, raw, ["value"]))


def report_document(spark, sf_dir):
    """Which agent stands in which line of the document, and the keys of its metadata."""
    log, folder = _keyed_log(spark, sf_dir), shared_folder(spark, "report")
    write_report_document(log, summarize(log), folder)
    text = F.ltrim("value", F.lit(","))
    keys = lambda path: F.array_join(F.json_object_keys(F.get_json_object(text, path)), ",")
    return _read_lines(spark, f"{folder}/report_document").select(
        F.col("_idx").alias("line"), F.get_json_object(text, "$.agent_name").alias("agent_name"),
        F.coalesce(keys("$.metadata"), keys("$.average_metadata")).alias("keys"),
    )


REPORT_DOCUMENT = """
WITH n AS (SELECT count(*) AS n FROM events)
SELECT 0 AS line, CAST(NULL AS VARCHAR) AS agent_name, CAST(NULL AS VARCHAR) AS keys
UNION ALL SELECT row_number() OVER (ORDER BY event_id), event_type, 'z,note,a,m' FROM events
UNION ALL SELECT n + 1, NULL, NULL FROM n
UNION ALL SELECT n + 1 + row_number() OVER (ORDER BY first), event_type, 'z,a,m' FROM n, (SELECT event_type, min(event_id) AS first FROM events GROUP BY 1)
UNION ALL SELECT n + 2 + (SELECT count(DISTINCT event_type) FROM events), NULL, NULL FROM n"""


def results_tree_scan(spark, sf_dir):
    """One document per file in a tree of folders, loaded in the order of their paths."""
    folder = shared_folder(spark, "results")
    log = run_log(spark, sf_dir)
    week = F.format_string("%03d", (F.col(POS) % 40).cast("int"))
    runs = log.groupBy(week.alias("_week"), "agent_name").agg(F.avg("duration_seconds").alias("duration_seconds"), F.count("*").alias("n"))
    named = runs.select(
        F.concat_ws("-", "_week", "agent_name").alias("run"), "agent_name", "duration_seconds",
        F.concat(F.lit('{"n": '), F.col("n").cast("string"), F.lit("}")).alias("metadata"),
    )
    lines = named.select("run", document(named.drop("run")).alias("value"))
    lines.repartition("run").write.partitionBy("run").option("maxRecordsPerFile", 1).text(folder)
    found = read_results(spark, folder, pattern="part-*")
    by_path = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_order"))
    return found.select(
        by_path.cast("bigint").alias("place"), "agent_name", F.round("duration_seconds", 6).alias("duration_seconds"),
        F.get_json_object("metadata", "$.n").cast("bigint").alias("n"),
    )


RESULTS_TREE = f"""
SELECT row_number() OVER (ORDER BY week || '-' || agent_name) AS place, agent_name, round(d, 6) AS duration_seconds, n
FROM (SELECT lpad(CAST(event_id % 40 AS VARCHAR), 3, '0') AS week, agent_name, avg(value) AS d, count(*) AS n FROM ({RUNS}) GROUP BY 1, 2)"""


def report_files(spark, sf_dir):
    """The whole report step: documents in, both forms of the report out."""
    source, folder = shared_folder(spark, "results"), shared_folder(spark, "report")
    log = _keyed_log(spark, sf_dir)
    runs = log.groupBy("agent_name").agg(F.avg("duration_seconds").alias("duration_seconds"), F.bool_and("passed").alias("passed"))
    lines = runs.select(F.col("agent_name").alias("run"), F.to_json(F.struct("agent_name", "duration_seconds", "passed")).alias("value"))
    lines.repartition("run").write.partitionBy("run").text(f"{source}/{RESULT_FILE}s")
    report(spark, f"{source}/{RESULT_FILE}s", folder, pattern="part-*")
    rows = spark.read.schema("agent_name string, total_tasks bigint, passed_tasks bigint, average_duration_seconds double").json(f"{folder}/report_json")
    return rows.select("agent_name", "total_tasks", "passed_tasks", F.round("average_duration_seconds", 6).alias("duration"))


REPORT_FILES = f"""
SELECT agent_name, 1 AS total_tasks, CAST(bool_and(passed) AS BIGINT) AS passed_tasks, round(avg(value), 6) AS duration
FROM ({RUNS}) GROUP BY 1"""


QUERIES = {
    "report_summary": (report_summary, SUMMARY),
    "report_metric_means": (report_metric_means, METRIC_MEANS),
    "report_metadata_means": (report_metadata_means, METADATA_MEANS),
    "report_markdown": (report_markdown, MARKDOWN),
    "csv_roundtrip": (
        csv_roundtrip,
        f"SELECT * EXCLUDE (pos), row_number() OVER (ORDER BY pos) - 1 AS row_index FROM ({ORDERS})",
    ),
    "csv_sniff_semicolon": (
        csv_semicolon,
        f"""SELECT "order no.", nullif(status, 'F') AS status, total || '"; x' AS note FROM ({ORDERS})""",
    ),
    "json_results_scan": (json_results_scan, METADATA_MEANS),
    "report_key_order": (report_key_order, KEY_ORDER),
    "report_document": (report_document, REPORT_DOCUMENT),
    "results_tree_scan": (results_tree_scan, RESULTS_TREE),
    "report_files": (report_files, REPORT_FILES),
}
