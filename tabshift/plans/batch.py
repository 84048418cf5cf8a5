"""Scoring of many runs in one go (PIP-3, MET-9).

All candidate tables become one long table of rows, keyed by the run, and all expected tables
one keyed by the expectation, which several runs may share. Every metric is then an aggregate
or a search grouped by run, so the number of jobs depends on neither the runs nor their sizes;
tracing damaged cells prepares each distinct pair of clean and damaged tables once. The scores
are those of `evaluate`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.functions.cells import fingerprint, is_populated
from tabshift.functions.names import IDX, POS, col, data_columns
from tabshift.operators.filters import apply_filtering
from tabshift.operators.match import encoded, match_rows
from tabshift.operators.metrics import METRIC_SCHEMA, NEAR_TENTHS, Scoring, changed_columns, rule_targets
from tabshift.operators.order import with_index
from tabshift.session import cut_lineage

RUN = "_g int, _k int, agent_name string, task_id string, duration_seconds double, error string, metadata string, "
RUN += "names array<string>, schema_score double, comparable boolean, correction string"


@dataclass
class Run:
    """One candidate and who made it. A run that failed has an error and no candidate;
    `scoring` then only says what was expected."""

    agent_name: str
    scoring: Scoring
    duration_seconds: float = 0.0
    metadata: str = "{}"
    error: str | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _flags(s: Scoring) -> Column:
    """Whether each expected cell is populated; false for a column that is not there."""
    have = set(data_columns(s.output))
    cells = [is_populated(col(c)).cast("int") if c in have else F.lit(0) for c in s.columns]
    return F.array(*cells).cast("array<int>")


def _correction(s: Scoring) -> str:
    """Why error correction needs no rows, or `rows`."""
    if s.noise is None:
        return "no noise configuration"
    if not s.noise.excluded_columns:
        return "no excluded columns to join on"
    key = s.noise.excluded_columns[0]
    if key not in s.clean.columns or key not in s.noisy.columns:
        return f"join key '{key}' not found"
    if s.comparable and not any(b in s.columns for _, b in rule_targets(s.task)):
        return "no noisy field is mapped"
    return "rows"


def _damaged(s: Scoring) -> DataFrame:
    """(_t, _cols): places of the expected cells that each truth row owes to a damaged one,
    once for each source."""
    key = s.noise.excluded_columns[0]
    kept = with_index(apply_filtering(s.clean, s.task.business_rules.filtering))
    changed = changed_columns(kept, s.noisy, key).filter(F.size("_changed") > 0)
    place = {c: i for i, c in enumerate(s.columns)}
    cells = [F.when(F.array_contains("_changed", a), F.lit(place[b])) for a, b in rule_targets(s.task) if b in place]
    cols = F.array_compact(F.array(*cells)).cast("array<int>")
    truth = with_index(s.truth).select(IDX, F.col(POS).alias("_t"))
    return changed.select(IDX, cols.alias("_cols")).join(truth, IDX).select("_t", "_cols").filter(F.size("_cols") > 0)


def _overlap(truths: DataFrame, outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """(_g, matched_rows): size of the intersection of the row multisets."""
    key = [c.alias(n) for c, n in zip(fingerprint([F.col("_c")]), ("_k1", "_k2"))]
    zero = F.lit(0).cast("bigint")
    wanted = truths.select("_k", *key).groupBy("_k", "_k1", "_k2").agg(F.count("*").alias("l")).join(runs, "_k")
    found = outputs.select("_g", *key).groupBy("_g", "_k1", "_k2").agg(F.count("*").alias("r"))
    sides = wanted.select("_g", "_k1", "_k2", "l", zero.alias("r")).unionAll(found.select("_g", "_k1", "_k2", zero, "r"))
    both = sides.groupBy("_g", "_k1", "_k2").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return both.groupBy("_g").agg(F.sum(F.least("l", "r")).alias("matched_rows"))


def _populated(outputs: DataFrame) -> DataFrame:
    """(_g, shares): populated share of each expected column, in order."""
    flags = outputs.select("_g", F.posexplode("_f").alias("c", "flag"))
    share = flags.groupBy("_g", "c").agg(F.avg("flag").alias("share"))
    return share.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "share"))), lambda x: x["share"]).alias("shares"))


def _traced(damaged: DataFrame, matches: DataFrame, truths: DataFrame, outputs: DataFrame, runs: DataFrame) -> DataFrame:
    """(_g, checked, correct) over damaged cells."""
    first = outputs.groupBy("_g").agg(F.min("_o").alias("_first"))
    best = matches.join(first, "_g", "left").select("_g", "_t", F.coalesce("_o", "_first").alias("_o"))
    rows = (
        damaged.join(truths.select("_k", "_t", F.col("_c").alias("_want")), ["_k", "_t"]).join(runs, "_k").join(best, ["_g", "_t"])
        .join(outputs.select("_g", "_o", F.col("_c").alias("_got")), ["_g", "_o"], "left")
    )
    right = F.size(F.filter("_cols", lambda i: F.get("_want", i) == F.get("_got", i)))
    return rows.groupBy("_g").agg(F.sum(F.size("_cols")).alias("checked"), F.sum(F.when(F.col("_got").isNull(), 0).otherwise(right)).alias("correct"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(1.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)).cast("double"))


def _metric(name: str, score: Column, *details: tuple[str, Column]) -> Column:
    pairs = [x for k, v in details for x in (F.lit(k), v.cast("string"))]
    shown = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(name).alias("name"), score.alias("score"), shown.alias("details"))


def _metrics() -> Column:
    """All metrics of a row of statistics."""
    c, cells, same = F.col, F.size("names"), F.col("comparable")
    expected, actual = c("expected_rows"), c("actual_rows")
    off = F.abs(actual - expected).cast("double") / F.nullif(expected, F.lit(0)).cast("double")
    filtering = F.when(expected == 0, (actual == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - off))
    shares = F.coalesce("shares", F.transform("names", lambda _: F.lit(0.0)))
    mapping = F.when(cells == 0, F.lit(1.0)).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.nullif(cells, F.lit(0)))
    named = F.map_from_arrays(c("names"), F.transform(shares, lambda x: x.cast("string")))
    fits = c("kept_rows") == expected
    rows_matter = c("correction") == "rows"
    traced = _ratio(c("correct"), c("checked"))
    correction = F.when(~rows_matter | ~fits, F.lit(1.0)).when(~same, F.lit(0.0)).otherwise(traced)
    mine = lambda x: F.when(same, x).otherwise(F.lit(0.0))
    return F.array(
        _metric("schema_accuracy", c("schema_score"), ("expected_columns", F.array_join("names", ", "))),
        _metric("row_accuracy", mine(_ratio(c("matched_rows"), expected)), ("matched_rows", c("matched_rows")), ("expected_rows", expected)),
        _metric("filtering_accuracy", filtering, ("expected_rows", expected), ("actual_rows", actual)),
        F.struct(F.lit("field_mapping_accuracy").alias("name"), mapping.alias("score"), named.alias("details")),
        _metric("transformation_accuracy", mine(_ratio(c("matched_cells"), expected * cells)), ("matched_cells", c("matched_cells")), ("total_cells", expected * cells)),
        _metric("record_accuracy", mine(_ratio(c("near_matches"), expected)), ("near_matches", c("near_matches")), ("total_records", expected)),
        _metric("error_correction_accuracy", correction, ("applicable", rows_matter & fits), ("checked", c("checked")), ("correct", c("correct"))),
    )


def evaluate_many(runs: list[Run]) -> DataFrame:
    """One row per run in the form of the result log; what a run scores does not depend on
    the others. Failed runs have their error and no metrics."""
    if not runs:
        raise ValueError("no runs to score")
    spark = runs[0].scoring.truth.sparkSession
    scored = [(g, r.scoring) for g, r in enumerate(runs) if r.error is None]
    # runs that are scored against the same tables share an expectation
    keys: dict[tuple, int] = {}
    shared: dict[int, Scoring] = {}
    of_run = {}
    for g, s in scored:
        tables = tuple(map(id, (s.truth, s.clean, s.noisy, s.task, s.noise)))
        of_run[g] = keys.setdefault(tables, len(keys))
        shared.setdefault(of_run[g], s)
    listed = []
    for g, r in enumerate(runs):
        s, ok = r.scoring, r.error is None
        actual = data_columns(s.output) if ok else []
        hits = sum(a == e for a, e in zip(actual, s.columns)) / len(s.columns) if s.columns else 1.0
        listed.append(
            (g, of_run.get(g), r.agent_name, s.task.task_id if s.task else "", float(r.duration_seconds), r.error, r.metadata,
             s.columns, hits, ok and s.comparable, _correction(s) if ok else None)
        )
    table = spark.createDataFrame(listed, RUN)
    if not scored:
        return _results(table.withColumn("metrics", F.array().cast("array<struct<name:string,score:double,details:map<string,string>>>")))
    number = lambda n, name: F.lit(n).alias(name)
    truths = cut_lineage(_union([s.truth.select(number(k, "_k"), F.col(POS).alias("_t"), encoded(s.columns).alias("_c")) for k, s in shared.items()]))
    outputs = cut_lineage(
        _union([
            s.output.select(number(g, "_g"), F.col(POS).alias("_o"), encoded(s.columns if s.comparable else []).alias("_c"), _flags(s).alias("_f"))
            for g, s in scored
        ])
    )
    # as many rows as there are runs
    same = F.broadcast(table.filter("comparable").select("_g", "_k"))
    matching = outputs.join(same.select("_g"), "_g", "left_semi").drop("_f")
    wanted = truths.join(same, "_k")
    matches = cut_lineage(match_rows(wanted.select("_g", "_t", "_c"), matching))
    near = F.col("matched") * 10 >= F.size("names") * NEAR_TENTHS
    sized = matches.join(F.broadcast(table.select("_g", "names")), "_g")
    totals = sized.groupBy("_g").agg(F.sum("matched").alias("matched_cells"), F.count_if(near & (F.size("names") > 0)).alias("near_matches"))
    stats = (
        table.join(truths.groupBy("_k").agg(F.count("*").alias("expected_rows")), "_k", "left")
        .join(outputs.groupBy("_g").agg(F.count("*").alias("actual_rows")), "_g", "left")
        .join(_overlap(truths, matching, same), "_g", "left").join(_populated(outputs), "_g", "left").join(totals, "_g", "left")
    )
    counts = ["expected_rows", "actual_rows", "matched_rows", "matched_cells", "near_matches"]
    tracing = {k: s for k, s in shared.items() if _correction(s) == "rows"}
    if tracing:
        kept = _union([
            apply_filtering(s.clean, s.task.business_rules.filtering).select(number(k, "_k")) for k, s in tracing.items()
        ]).groupBy("_k").agg(F.count("*").alias("kept_rows"))
        damaged = _union([_damaged(s).select(number(k, "_k"), "_t", "_cols") for k, s in tracing.items()])
        stats = stats.join(kept, "_k", "left").join(_traced(damaged, matches, truths, matching, same), "_g", "left")
    else:
        zero = F.lit(0).cast("bigint")
        stats = stats.withColumns({"kept_rows": zero, "checked": zero, "correct": zero})
    stats = stats.na.fill(0, [*counts, "kept_rows", "checked", "correct"])
    metrics = F.when(F.col("error").isNull(), _metrics()).otherwise(F.array().cast(f"array<struct<{METRIC_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"))
    return _results(stats.withColumn("metrics", metrics))


def _results(stats: DataFrame) -> DataFrame:
    again = F.lit(None).cast("struct<name: string, score: double, details: map<string,string>>")
    return stats.select(
        "task_id", "agent_name", "metrics",
        (F.col("error").isNull() & F.forall("metrics", lambda m: m["score"] == 1.0)).alias("passed"),
        F.current_timestamp().alias("timestamp"), "error", again.alias("reproducibility"), "duration_seconds", "metadata",
        F.col("_g").cast("bigint").alias(POS),
    )
