"""Reports over scored runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.operators.summary import agent_sections, summarize
from tabshift.sources.results import RESULT_FILE, read_results, write_report, write_report_document


def render_markdown(summary: DataFrame, generated_at: datetime | None = None) -> str:
    """The whole report as text; brings one row per agent to the driver."""
    generated_at = generated_at or datetime.now(timezone.utc)
    total = summary.agg(F.coalesce(F.sum("total_tasks"), F.lit(0))).first()[0]
    lines = [
        "# Evaluation Report", "", f"Generated: {generated_at.isoformat()}",
        f"Total results: {total}", "",
    ]
    sections = agent_sections(summary).orderBy("first").collect()
    return "\n".join(lines + [r["section"] for r in sections])


def report(spark: SparkSession, root: str, folder: str | None = None, pattern: str = RESULT_FILE) -> str:
    """Read the log below `root`, aggregate it and write both forms (PIP-4)."""
    results = read_results(spark, root, pattern)
    if results.isEmpty():
        raise FileNotFoundError(f"no {RESULT_FILE} below {root}")
    summary = summarize(results).persist()
    try:
        text = render_markdown(summary)
        if folder is not None:
            write_report(summary.orderBy("first").drop("first"), text, folder)
            write_report_document(results, summary, folder)
    finally:
        summary.unpersist()
    return text
