"""Per-agent aggregates over a log of scored runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Places of an entry in its run, and a number below all of its run's.
_PLACES = "2147483648BD"
_NO_NUMBER = "-9223372036854775809BD"
_NUMERIC = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def _entry(kind: Column | str, key: Column, value: Column, passed: Column, ok: Column) -> Column:
    return F.struct(
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
        key.cast("string").alias("key"),
        value.cast("double").alias("value"),
        passed.cast("int").alias("passed"),
        ok.cast("int").alias("ok"),
    )


def run_entries(results: DataFrame) -> DataFrame:
    """One row per run, per metric score and per numeric metadata value:
    (agent_name, order, place, kind, key, value, passed, ok). Texts and booleans
    in the metadata are left out, also texts that look like numbers."""
    none = F.lit(None)
    metadata = F.col("metadata")
    keys = None
    if dict(results.dtypes)["metadata"] == "string":
        # a variant sorts its keys; the text has them in the order of the document
        keys, metadata = F.json_object_keys("metadata"), F.parse_json("metadata")
    values = metadata.cast("map<string,variant>")
    results = results.withColumns({"_values": values, "_keys": F.map_keys(values) if keys is None else keys})
    runs = F.array(
        _entry("run", none, F.col("duration_seconds"), F.col("passed"), F.col("error").isNull())
    )
    metrics = F.transform(
        "metrics", lambda m: _entry("metric", m["name"], m["score"], none, none)
    )
    again = F.when(
        F.col("reproducibility").isNotNull(),
        F.array(
            _entry(
                "metric", F.col("reproducibility.name"), F.col("reproducibility.score"), none, none
            )
        ),
    )
    numeric = F.filter(
        F.transform("_keys", lambda k: F.struct(k.alias("key"), F.try_element_at("_values", k).alias("value"))),
        lambda e: F.schema_of_variant(e["value"]).rlike(_NUMERIC),
    )
    values = F.transform(
        numeric,
        lambda e: _entry(
            "metadata", e["key"], F.try_variant_get(e["value"], "$", "double"), none, none
        ),
    )
    empty = F.array().cast(
        "array<struct<kind:string,key:string,value:double,passed:int,ok:int>>"
    )
    parts = [F.coalesce(a, empty) for a in (runs, metrics, again, values)]
    order = F.col("_order") if "_order" in results.columns else F.col("_pos")
    return results.select(
        "agent_name", order.alias("order"), F.posexplode(F.concat(*parts)).alias("place", "e")
    ).select("agent_name", "order", "place", "e.*")


def _grouped(results: DataFrame, *more: Column) -> DataFrame:
    """One shuffle for all aggregates; partial sums keep a busy agent cheap."""
    return (
        run_entries(results)
        .groupBy("agent_name", "kind", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), *more)
    )


def _with_firsts(results: DataFrame) -> DataFrame:
    """Aggregates per agent, kind and key, and `first`, their least order and place.

    A struct's minimum would sort all entries of a task. A number and a place are one decimal,
    which is kept in a hash table; what goes before the number, the file and its split, is
    grouped by at first."""
    entries = run_entries(results)
    kind = entries.schema["order"].dataType
    before = kind.names[:-1] if isinstance(kind, T.StructType) else []
    number = F.col("order")[kind.names[-1]] if before else F.col("order")
    part = F.struct(*[F.col("order")[c].alias(c) for c in before]) if before else F.lit(0)
    # null comes first, below all numbers
    whole = F.coalesce(number.cast("decimal(20,0)"), F.expr(_NO_NUMBER)) * F.expr(_PLACES) + F.col("place")
    keys = ["agent_name", "kind", "key"]
    parts = entries.groupBy(*keys, part.alias("_part")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.count("value").alias("values"),
        F.sum("passed").alias("passed"), F.sum("ok").alias("ok"), F.min(whole).alias("_whole"),
    )
    least = F.min(F.struct("_part", "_whole"))
    found = parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("total"), F.sum("values")).alias("mean"),
        F.sum("passed").alias("passed"), F.sum("ok").alias("ok"), least.alias("_least"),
    )
    place = F.pmod(F.col("_least._whole"), F.expr(_PLACES))
    full = F.col("_least._whole") - place
    number = F.when(full > F.expr(_NO_NUMBER) * F.expr(_PLACES), F.call_function("div", full, F.expr(_PLACES)))
    order = F.struct(*[F.col("_least._part")[c].alias(c) for c in before], number.alias(kind.names[-1])) if before else number.cast(kind)
    return found.withColumn("first", F.struct(order.alias("order"), place.cast("int").alias("place"))).drop("_least")


def metric_means(results: DataFrame) -> DataFrame:
    """Mean score per agent and metric, over the runs that have it (AGG-2)."""
    return (
        _grouped(results).filter("kind = 'metric'").select("agent_name", F.col("key").alias("metric"), "n", "mean")
    )


def metadata_means(results: DataFrame) -> DataFrame:
    """Mean per agent and metadata key, over the runs that report it (AGG-3)."""
    return _grouped(results).filter("kind = 'metadata'").select("agent_name", "key", "n", "mean")


def _means(kind: str) -> Column:
    """Map name -> mean in first-seen order; as long as there are names."""
    found = F.collect_list(
        F.when(F.col("kind") == kind, F.struct("first", "key", "mean"))
    )
    pairs = F.transform(F.sort_array(found), lambda e: F.struct(e["key"], e["mean"]))
    return F.map_from_entries(pairs)


def summarize(results: DataFrame) -> DataFrame:
    """One row per agent (AGG-1..3); `first` orders agents as first seen."""
    is_run = F.col("kind") == "run"
    only = lambda c: F.max(F.when(is_run, F.col(c)))
    share = lambda c: F.col(c).cast("double") / F.col("total_tasks").cast("double")
    entries = _with_firsts(results)
    return (
        entries.groupBy("agent_name")
        .agg(
            only("n").alias("total_tasks"),
            only("passed").alias("passed_tasks"),
            only("ok").alias("succeeded"),
            only("mean").alias("average_duration_seconds"),
            F.min(F.when(is_run, F.col("first"))).alias("first"),
            _means("metric").alias("average_metric_scores"),
            _means("metadata").alias("average_metadata"),
        )
        .select(
            "agent_name",
            "total_tasks",
            "passed_tasks",
            (F.col("total_tasks") - F.col("passed_tasks")).alias("failed_tasks"),
            share("passed_tasks").alias("pass_rate"),
            share("succeeded").alias("success_rate"),
            "average_duration_seconds",
            "average_metric_scores",
            "average_metadata",
            "first",
        )
    )


def agent_sections(summary: DataFrame) -> DataFrame:
    """Markdown section per agent (SNK-4); empty parts are left out."""

    def listed(title: str, means: str, form: str) -> Column:
        lines = F.transform(
            F.map_entries(means),
            lambda e: F.format_string(f"\n  - %s: {form}", e["key"], e["value"]),
        )
        return F.when(
            F.size(means) > 0, F.concat(F.lit(f"\n- {title}:"), F.array_join(lines, ""))
        ).otherwise("")

    head = F.format_string(
        "## %s\n- Tasks: %d (%d passed, %d failed) - pass rate: %.1f%%, success rate: %.1f%%"
        "\n- Average duration: %.1fs",
        "agent_name", "total_tasks", "passed_tasks", "failed_tasks",
        F.col("pass_rate") * 100, F.col("success_rate") * 100, "average_duration_seconds",
    )
    return summary.select(
        "agent_name",
        "first",
        F.concat(
            head,
            listed("Average scores", "average_metric_scores", "%.3f"),
            listed("Average metadata", "average_metadata", "%.2f"),
            F.lit("\n"),
        ).alias("section"),
    )
