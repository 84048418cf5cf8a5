"""Joins, aggregates, comparisons, scores and validation."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import functions as F

from tabshift.functions.names import POS, col
from tabshift.operators.checks import (
    duplicated_values,
    null_counts,
    value_issues,
)
from tabshift.operators.compare import multiset_overlap, positional_diff, row_multiset
from tabshift.operators.filters import apply_filtering
from tabshift.operators.match import best_match
from tabshift.operators.metrics import (
    Scoring,
    changed_columns,
    error_correction_accuracy,
    field_mapping_accuracy,
    filtering_accuracy,
    populated_fractions,
    record_accuracy,
    reproduction_score,
    row_accuracy,
    rule_fanout,
    transformation_accuracy,
)
from tabshift.operators.noise import apply_noise
from tabshift.operators.order import first_per_key, first_seen, with_index
from tabshift.operators.synth import STRATEGIES
from tabshift.plans.batch import Run, evaluate_many
from tabshift.plans.evaluate import evaluate
from tabshift.plans.migrate import migrate
from tabshift.plans.validate import compare_rederived, validate_package
from tabshift.sources.bundle import Package
from tabshift.specs import Metadata, Scenario, parse
from workloads.specs import (
    CUSTOMER_COLUMNS,
    CUSTOMER_NOISE,
    CUSTOMER_SCHEMA,
    CUSTOMER_TASK,
    ORDER_COLUMNS,
    ORDER_NOISE,
    ORDER_SCHEMA,
    ORDER_TASK,
    customer_truth_sql,
    noise,
    noise_sql,
    order_truth_sql,
    rule,
    schema,
    synthesis,
    task,
)
from workloads.tables import CUSTOMERS, LINEITEMS, ORDERS, customers, lineitems, orders

CUSTOMER_SOURCE_COLUMNS = ["cust no", "cust.name", "nation", "balance", "segment"]
ORDER_SOURCE_COLUMNS = [
    "order no.", "cust no", "status", "total", "iso date", "order date", "short date", "priority",
]


# --- a truth table and a candidate that maps the damaged rows as they are -----


def _customer_scoring(spark, sf_dir) -> Scoring:
    clean = customers(spark, sf_dir)
    noisy = apply_noise(clean, CUSTOMER_NOISE)
    return Scoring(
        output=migrate(noisy, CUSTOMER_TASK, CUSTOMER_SCHEMA),
        truth=migrate(clean, CUSTOMER_TASK, CUSTOMER_SCHEMA),
        task=CUSTOMER_TASK,
        noise=CUSTOMER_NOISE,
        clean=clean,
        noisy=noisy,
    )


_CUSTOMER_WITH = f"""
WITH clean AS MATERIALIZED ({CUSTOMERS}),
noisy AS MATERIALIZED ({noise_sql('clean', CUSTOMER_SOURCE_COLUMNS, CUSTOMER_NOISE)}),
truth AS MATERIALIZED ({customer_truth_sql('clean')}),
output AS MATERIALIZED ({customer_truth_sql('noisy')})"""


_ORDER_WITHOUT_NUMBERS = task(
    "ORDERS",
    {"field": "order date", "operator": ">=", "value": "1997-01-01", "field_format": "DD.MM.YYYY"},
    [
        rule("order no.", "old_no", "copy"),
        rule(["cust no", "status"], "partner", "concatenate", separator="-"),
        rule("total", "amount", "copy"),
        rule("short date", "doc_date", "date_format", input_format="DD.MM.YY", output_format="DDMMYYYY"),
    ],
)
_PLAIN_ORDER_SCHEMA = schema("DOC", "old_no", "partner", "amount", "doc_date", required=("old_no",))
_PLAIN_ORDER_COLUMNS = ["old_no", "partner", "amount", "doc_date"]


def _order_scoring(spark, sf_dir) -> Scoring:
    clean = orders(spark, sf_dir)
    noisy = apply_noise(clean, ORDER_NOISE)
    return Scoring(
        output=migrate(noisy, _ORDER_WITHOUT_NUMBERS, _PLAIN_ORDER_SCHEMA),
        truth=migrate(clean, _ORDER_WITHOUT_NUMBERS, _PLAIN_ORDER_SCHEMA),
        task=_ORDER_WITHOUT_NUMBERS,
        noise=ORDER_NOISE,
        clean=clean,
        noisy=noisy,
    )


def _plain_order_sql(source: str) -> str:
    return f"""
SELECT "order no." AS old_no, "cust no" || '-' || status AS partner, total AS amount,
       strftime(strptime("short date", '%d.%m.%y'), '%d%m%Y') AS doc_date, pos
FROM {source} WHERE strptime("order date", '%d.%m.%Y') >= DATE '1997-01-01'"""


_ORDER_WITH = f"""
WITH clean AS MATERIALIZED ({ORDERS}),
noisy AS MATERIALIZED ({noise_sql('clean', ORDER_SOURCE_COLUMNS, ORDER_NOISE)}),
truth AS MATERIALIZED ({_plain_order_sql('clean')}),
output AS MATERIALIZED ({_plain_order_sql('noisy')})"""


def _equal_cells(columns: list[str]) -> str:
    return " + ".join(f'CAST(t."{c}" IS NOT DISTINCT FROM o."{c}" AS INTEGER)' for c in columns)


def _matches_sql(columns: list[str]) -> str:
    """All pairs of rows; what the match operator avoids."""
    return f"""
matches AS MATERIALIZED (
  SELECT truth_pos, best // 1000000000 AS matched, 999999999 - best % 1000000000 AS output_pos
  FROM (SELECT t.pos AS truth_pos,
               max(CAST({_equal_cells(columns)} AS BIGINT) * 1000000000 + 999999999 - o.pos) AS best
        FROM truth t CROSS JOIN output o GROUP BY t.pos))"""


def _listed(columns: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in columns)


def _overlap_sql(columns: list[str]) -> str:
    same = " AND ".join(f'a."{c}" IS NOT DISTINCT FROM b."{c}"' for c in columns)
    return f"""
overlap AS (
  SELECT (SELECT count(*) FROM truth) AS left_rows, (SELECT count(*) FROM output) AS right_rows,
         CAST(coalesce(sum(least(a.n, b.n)), 0) AS BIGINT) AS matched_rows
  FROM (SELECT {_listed(columns)}, count(*) AS n FROM truth GROUP BY ALL) a
  JOIN (SELECT {_listed(columns)}, count(*) AS n FROM output GROUP BY ALL) b ON {same})"""


_MISSING_WORDS = "('nan','none','null','nat','<na>')"


def _populated_sql(column: str) -> str:
    return (
        f"avg(CAST(coalesce(len(list_filter(regexp_split_to_array(lower(\"{column}\"), '[\\s\\-_/,.]+'), "
        f"lambda x: x <> '' AND x NOT IN {_MISSING_WORDS})) > 0, FALSE) AS INTEGER))"
    )


def _correction_sql(pairs: list[tuple[str, str]]) -> str:
    """Changed cells traced into the output through the positional join."""
    checks = " UNION ALL ".join(
        f"""SELECT g."{target}" IS NOT DISTINCT FROM w."{target}" AS ok
            FROM kept c JOIN first_noisy n ON c.key = n.key
            JOIN wanted w ON w.i = c.i JOIN matches m ON m.truth_pos = w.pos
            JOIN output g ON g.pos = m.output_pos
            WHERE c."{source}" IS DISTINCT FROM n."{source}" """
        for source, target in pairs
    )
    return f"""
kept AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM (
  SELECT c.*, "KEY" AS key FROM clean c WHERE "FILTER")),
first_noisy AS (SELECT *, "KEY" AS key FROM noisy QUALIFY row_number() OVER (PARTITION BY "KEY" ORDER BY pos) = 1),
wanted AS (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM truth),
checks AS ({checks})"""


_CUSTOMER_CORRECTION = (
    _correction_sql([("cust no", "CustomerID"), ("cust.name", "Label"), ("nation", "Label"), ("segment", "Sector"), ("nation", "Nation"), ("balance", "Balance")])
    .replace('"KEY"', '"cust no"')
    .replace('"FILTER"', "CAST(balance AS DOUBLE) >= 0")
)
_ORDER_CORRECTION = (
    _correction_sql([("order no.", "old_no"), ("cust no", "partner"), ("status", "partner"), ("total", "amount"), ("short date", "doc_date")])
    .replace('"KEY"', '"order no."')
    .replace('"FILTER"', """strptime("order date", '%d.%m.%Y') >= DATE '1997-01-01'""")
)


def _metric(metric, scoring, *details):
    """Score of one metric, with the counts it rests on."""

    def run(spark, sf_dir):
        scored = metric(scoring(spark, sf_dir))
        return scored.select(
            "name",
            F.round("score", 6).alias("score"),
            *[F.col("details").getItem(d).cast("bigint").alias(d) for d in details],
        )

    return run


def evaluate_all(spark, sf_dir):
    """Every metric of one candidate, its pass flag and its reproduction score."""
    s = _customer_scoring(spark, sf_dir)
    again = migrate(
        apply_noise(customers(spark, sf_dir), CUSTOMER_NOISE), CUSTOMER_TASK, CUSTOMER_SCHEMA
    )
    result = evaluate(s, "naive", 1.0, reproduced=again)
    rows = [(m.name, round(m.score, 6), result.passed) for m in result.metrics]
    rows.append((result.reproducibility.name, round(result.reproducibility.score, 6), result.passed))
    return spark.createDataFrame(rows, "name string, score double, passed boolean")


_POPULATED_MEAN = " + ".join(_populated_sql(c) for c in CUSTOMER_COLUMNS)
_FILTERING = """greatest(0.0, 1.0 - abs((SELECT count(*) FROM output) - (SELECT count(*) FROM truth))
  / CAST((SELECT count(*) FROM truth) AS DOUBLE))"""


def _ratio(part: str, whole: str) -> str:
    return f"round(CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE), 6)"


def _near(n: int) -> str:
    return f"count(*) FILTER (WHERE matched * 10 >= {n * 8})"


EVALUATE_ALL = f"""{_CUSTOMER_WITH},
{_matches_sql(CUSTOMER_COLUMNS)}, {_overlap_sql(CUSTOMER_COLUMNS)}, {_CUSTOMER_CORRECTION}
SELECT 'schema_accuracy' AS name, CAST(1.0 AS DOUBLE) AS score, FALSE AS passed
UNION ALL SELECT 'row_accuracy', {_ratio('matched_rows', 'left_rows')}, FALSE FROM overlap
UNION ALL SELECT 'filtering_accuracy', round({_FILTERING}, 6), FALSE
UNION ALL SELECT 'field_mapping_accuracy', round(({_POPULATED_MEAN}) / 5, 6), FALSE FROM output
UNION ALL SELECT 'transformation_accuracy', {_ratio('sum(matched)', '(count(*) * 5)')}, FALSE FROM matches
UNION ALL SELECT 'record_accuracy', {_ratio(_near(5), 'count(*)')}, FALSE FROM matches
UNION ALL SELECT 'error_correction_accuracy', {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')}, FALSE FROM checks
UNION ALL SELECT 'reproducibility', CAST(1.0 AS DOUBLE), FALSE"""


_RUN_NOISE = {
    "light": noise(3, ["cust no", "segment", "balance"], ("typo", 0.01), ("missing_value", 0.01)),
    "twice": noise(4, ["cust no", "segment", "balance"], ("duplicate", 0.3)),
    "rough": CUSTOMER_NOISE,
    "clean": noise(5, ["cust no", "segment", "balance"], ("typo", 0.0)),
}


def evaluate_many_runs(spark, sf_dir):
    """Four agents on one task: each maps a copy with damage of its own; a fifth fails."""
    expected = _customer_scoring(spark, sf_dir)
    runs = [
        Run(agent, replace(expected, output=migrate(apply_noise(expected.clean, damage), CUSTOMER_TASK, CUSTOMER_SCHEMA)))
        for agent, damage in _RUN_NOISE.items()
    ]
    results = evaluate_many([*runs, Run("broken", expected, error="timeout")])
    metric = F.inline(F.transform("metrics", lambda m: F.struct(m["name"].alias("name"), F.round(m["score"], 6).alias("score"))))
    return results.select("agent_name", "passed", metric)


_WITHOUT_FLAG = re.compile(r", FALSE(?= AS passed| FROM|\n)( AS passed)?")


def _run_sql(agent: str, damage) -> str:
    return f"""
SELECT '{agent}' AS agent_name, min(score) OVER () = 1.0 AS passed, name, score FROM (
WITH clean AS MATERIALIZED ({CUSTOMERS}),
noisy AS MATERIALIZED ({noise_sql('clean', CUSTOMER_SOURCE_COLUMNS, CUSTOMER_NOISE)}),
truth AS MATERIALIZED ({customer_truth_sql('clean')}),
own AS MATERIALIZED ({noise_sql('clean', CUSTOMER_SOURCE_COLUMNS, damage)}),
output AS MATERIALIZED ({customer_truth_sql('own')}),
{_WITHOUT_FLAG.sub('', EVALUATE_ALL.removeprefix(_CUSTOMER_WITH + ',').rpartition('UNION ALL')[0])}
)"""


EVALUATE_MANY = " UNION ALL ".join(f"SELECT * FROM ({_run_sql(a, d)})" for a, d in _RUN_NOISE.items())


# --- joins ------------------------------------------------------------------


def join_first_occurrence(spark, sf_dir):
    """Clean customers with the columns that their first noisy row changed."""
    s = _customer_scoring(spark, sf_dir)
    return changed_columns(s.clean, s.noisy, "cust no").select(
        col("cust no"), F.array_join("_changed", ",").alias("changed")
    )


JOIN_FIRST = f"""{_CUSTOMER_WITH}
SELECT c."cust no", concat_ws(',',
  CASE WHEN c."cust.name" IS DISTINCT FROM n."cust.name" THEN 'cust.name' END,
  CASE WHEN c.nation IS DISTINCT FROM n.nation THEN 'nation' END,
  CASE WHEN c.balance IS DISTINCT FROM n.balance THEN 'balance' END,
  CASE WHEN c.segment IS DISTINCT FROM n.segment THEN 'segment' END) AS changed
FROM clean c JOIN (SELECT * FROM noisy
  QUALIFY row_number() OVER (PARTITION BY "cust no" ORDER BY pos) = 1) n ON c."cust no" = n."cust no" """


def join_rule_fanout(spark, sf_dir):
    s = _customer_scoring(spark, sf_dir)
    changed = changed_columns(s.clean, s.noisy, "cust no").select(col("cust no"), "_changed")
    return rule_fanout(changed, CUSTOMER_TASK).select(col("cust no"), "source_field", "target_field")


JOIN_FANOUT = f"""{_CUSTOMER_WITH},
n AS (SELECT * FROM noisy QUALIFY row_number() OVER (PARTITION BY "cust no" ORDER BY pos) = 1),
changed AS (
  SELECT c."cust no", 'cust.name' AS source_field FROM clean c JOIN n USING ("cust no") WHERE c."cust.name" IS DISTINCT FROM n."cust.name"
  UNION ALL SELECT c."cust no", 'nation' FROM clean c JOIN n USING ("cust no") WHERE c.nation IS DISTINCT FROM n.nation
  UNION ALL SELECT c."cust no", 'balance' FROM clean c JOIN n USING ("cust no") WHERE c.balance IS DISTINCT FROM n.balance
  UNION ALL SELECT c."cust no", 'segment' FROM clean c JOIN n USING ("cust no") WHERE c.segment IS DISTINCT FROM n.segment)
SELECT "cust no", source_field, target_field FROM changed JOIN (VALUES
  ('cust no', 'CustomerID'), ('cust.name', 'Label'), ('nation', 'Label'), ('segment', 'Sector'),
  ('nation', 'Nation'), ('balance', 'Balance')) r(source_field, target_field) USING (source_field)"""


def join_positional(spark, sf_dir):
    """The i-th kept clean order with the i-th row of the expected table."""
    clean = orders(spark, sf_dir)
    kept = with_index(apply_filtering(clean, ORDER_TASK.business_rules.filtering))
    truth = with_index(migrate(clean, ORDER_TASK, ORDER_SCHEMA))
    return kept.join(truth.drop(POS), "_idx").select(
        F.col("_idx").alias("row_index"), col("order no."), "doc_no", "old_no"
    )


JOIN_POSITIONAL = f"""
WITH clean AS ({ORDERS}), truth AS ({order_truth_sql('clean')})
SELECT a.i AS row_index, a."order no.", b.doc_no, b.old_no
FROM (SELECT "order no.", row_number() OVER (ORDER BY pos) - 1 AS i FROM clean
      WHERE strptime("order date", '%d.%m.%Y') >= DATE '1997-01-01') a
JOIN (SELECT doc_no, old_no, row_number() OVER (ORDER BY pos) - 1 AS i FROM truth) b ON a.i = b.i"""


def best_match_customers(spark, sf_dir):
    s = _customer_scoring(spark, sf_dir)
    return best_match(s.truth, s.output)


def best_match_orders(spark, sf_dir):
    s = _order_scoring(spark, sf_dir)
    return best_match(s.truth, s.output)


WIDE_COLUMNS = [
    "cust no", "cust.name", "nation", "balance", "segment", "area", "last digit", "hundred", "cents", "debt", "market", "tail", "month", "day",
]
# cells that are longer than one character seldom survive the second
WIDE_NOISE = noise(31, [], ("typo", 0.15), ("duplicate", 0.1), ("missing_value", 0.1))
BAD_NOISE = noise(32, [], ("typo", 0.97), ("typo", 0.9), ("duplicate", 0.1), ("missing_value", 0.15))


def wide_customers(spark, sf_dir):
    """Customers with columns of every kind: unique ones, and few values or many."""
    number = F.col(POS)
    # a table may be one row group, which one task reads; damage to many columns is dealt to all
    dealt = customers(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism)
    return dealt.select(
        *[col(c) for c in WIDE_COLUMNS[:5]],
        (col("nation").cast("int") % 5).cast("string").alias("area"),
        (number % 10).cast("string").alias("last digit"),
        F.floor(number / 100).cast("string").alias("hundred"),
        F.substring("balance", -2, 2).alias("cents"),
        F.when(col("balance").startswith("-"), "y").otherwise("n").alias("debt"),
        F.substring("segment", 1, 1).alias("market"),
        F.substring(col("cust.name"), -3, 3).alias("tail"),
        (number % 12).cast("string").alias("month"),
        (number % 7).cast("string").alias("day"),
        POS,
    )


WIDE_CUSTOMERS = f"""
SELECT "cust no", "cust.name", nation, balance, segment, CAST(CAST(nation AS INTEGER) % 5 AS VARCHAR) AS area,
       CAST(pos % 10 AS VARCHAR) AS "last digit", CAST(pos // 100 AS VARCHAR) AS hundred, right(balance, 2) AS cents,
       CASE WHEN balance LIKE '-%' THEN 'y' ELSE 'n' END AS debt, left(segment, 1) AS market,
       right("cust.name", 3) AS tail, CAST(pos % 12 AS VARCHAR) AS month, CAST(pos % 7 AS VARCHAR) AS day, pos
FROM ({CUSTOMERS})"""


def best_match_wide(spark, sf_dir):
    """Fourteen columns, about a fifth of the cells damaged."""
    truth = wide_customers(spark, sf_dir)
    return best_match(truth, apply_noise(truth, WIDE_NOISE))


def best_match_bad(spark, sf_dir):
    """Fourteen columns of which little more than the frequent values agree."""
    truth = wide_customers(spark, sf_dir)
    return best_match(truth, apply_noise(truth, BAD_NOISE))


def _wide_match_sql(damage) -> str:
    return f"""
WITH truth AS MATERIALIZED ({WIDE_CUSTOMERS}), output AS MATERIALIZED ({noise_sql('truth', WIDE_COLUMNS, damage)}),
{_matches_sql(WIDE_COLUMNS)} SELECT truth_pos, output_pos, matched FROM matches"""


# --- aggregates -------------------------------------------------------------


def fit_stats(spark, sf_dir):
    """What the numeric and the date strategy learn of a column, in one aggregation."""
    config = synthesis(
        1,
        **{
            "total": {"strategy": "numeric_distribution"},
            "order date": {"strategy": "date_distribution", "field_format": "DD.MM.YYYY"},
        },
    )
    number, day = (STRATEGIES[c.strategy].fit(c) for c in config.columns)
    return orders(spark, sf_dir).agg(
        *(number[k].cast("decimal(12,2)").cast("string").alias(k) for k in ("low", "high")),
        number["places"].cast("bigint").alias("places"),
        day["low"].cast("string").alias("first_day"),
        day["high"].cast("string").alias("last_day"),
    )


def value_counts(spark, sf_dir):
    df = lineitems(spark, sf_dir).withColumn(POS, col("order no.").cast("bigint") * 8 + F.col("line").cast("bigint"))
    return first_seen(df, "return flag").select("label", "n")


def first_seen_order(spark, sf_dir):
    from workloads.tables import load

    df = load(spark, sf_dir, "events").withColumn(POS, F.col("event_id"))
    return first_seen(df, "event_type")


def row_multiset_lines(spark, sf_dir):
    """Whole rows, each line item twice but for the first line of an order."""
    df = lineitems(spark, sf_dir)
    return row_multiset(df.unionAll(df.filter("line <> '1'")))


def multiset_overlap_orders(spark, sf_dir):
    """Whole orders against those of the damaged copy."""
    s = _order_scoring(spark, sf_dir)
    return multiset_overlap(s.clean, s.noisy)


MULTISET_OVERLAP = f"""{_ORDER_WITH}
SELECT (SELECT count(*) FROM clean) AS left_rows, (SELECT count(*) FROM noisy) AS right_rows,
  (SELECT count(*) FROM (SELECT * EXCLUDE (pos) FROM clean
   INTERSECT ALL SELECT * EXCLUDE (pos) FROM noisy)) AS matched_rows"""


def dup_keys(spark, sf_dir):
    df = lineitems(spark, sf_dir).withColumn("status", F.nullif(F.col("status"), F.lit("O")))
    return duplicated_values(df, ["order no.", "line", "status"])


def null_cells(spark, sf_dir):
    noisy = apply_noise(orders(spark, sf_dir), ORDER_NOISE)
    return null_counts(noisy)


def populated_columns(spark, sf_dir):
    s = _customer_scoring(spark, sf_dir)
    shares = populated_fractions(s.output, [*CUSTOMER_COLUMNS, "Email"])
    return shares.select(*[F.round(F.col(c), 6).alias(c) for c in shares.columns])


def first_per_customer(spark, sf_dir):
    """First order per customer in table order; no window over a hot key."""
    return first_per_key(orders(spark, sf_dir), ["cust no"]).drop(POS)


def frame_diff(spark, sf_dir):
    """Positions at which the truth and a candidate without duplicates differ."""
    clean = orders(spark, sf_dir)
    damaged = apply_noise(clean, FRAME_NOISE)
    diff = positional_diff(clean, damaged)
    return diff.select("row_index", "missing_side", F.array_join("columns", ",").alias("columns"))


FRAME_NOISE = noise(11, ["order no."], ("typo", 0.02), ("missing_value", 0.01))


def _frame_diff_sql():
    changed = ", ".join(
        f"""CASE WHEN a."{c}" IS DISTINCT FROM b."{c}" THEN '{c}' END""" for c in ORDER_SOURCE_COLUMNS
    )
    return f"""
WITH clean AS ({ORDERS}), damaged AS ({noise_sql('clean', ORDER_SOURCE_COLUMNS, FRAME_NOISE)}),
pairs AS (SELECT a.i, concat_ws(',', {changed}) AS columns
  FROM (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM clean) a
  JOIN (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS i FROM damaged) b ON a.i = b.i)
SELECT i AS row_index, CAST(NULL AS VARCHAR) AS missing_side, columns FROM pairs WHERE columns <> ''"""


# --- validation -------------------------------------------------------------

_LINE_SCHEMA = schema(
    "LINES", "order no.", "part no.", "line", "ship date",
    required=("order no.", "part no.", "ship date"), unique=("order no.", "part no."),
)
_LINE_NOISE = noise(13, ["order no."], ("missing_value", 0.01))
_LINE_NAMES = ["order no.", "part no.", "line", "ship date"]
_LINE_RID = """
    length("order no.") || ':' || "order no."
    || length("part no.") || ':' || "part no."
    || length(line) || ':' || line
    || length("ship date") || ':' || "ship date" """


def validate_values(spark, sf_dir):
    """Missing values in required columns, repeated values in unique ones."""
    lines = lineitems(spark, sf_dir).select(*[col(c) for c in _LINE_NAMES])
    damaged = apply_noise(lines, _LINE_NOISE, row_key=_LINE_NAMES)
    issues = value_issues(damaged, _LINE_SCHEMA, "lines")
    return issues.select("severity", "code", "message", "rows")


VALIDATE_VALUES = f"""
WITH src AS (SELECT {_listed(_LINE_NAMES)} FROM ({LINEITEMS})),
d AS MATERIALIZED ({noise_sql('src', _LINE_NAMES, _LINE_NOISE, rid=_LINE_RID, has_pos=False)})
SELECT * FROM (
SELECT 'error' AS severity, 'required_value_missing' AS code,
       'required column ''part no.'' has missing values' AS message, count(*) FILTER (WHERE "part no." IS NULL) AS rows FROM d
UNION ALL SELECT 'error', 'required_value_missing', 'required column ''ship date'' has missing values',
       count(*) FILTER (WHERE "ship date" IS NULL) FROM d
UNION ALL SELECT 'error', 'uniqueness_violation', 'unique column ''order no.'' has repeated values',
       (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY "order no." HAVING count(*) > 1))
UNION ALL SELECT 'error', 'uniqueness_violation', 'unique column ''part no.'' has repeated values',
       (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM d GROUP BY "part no." HAVING count(*) > 1))
) WHERE rows > 0"""


def validate_dataset_repro(spark, sf_dir):
    """A stored dataset that another seed produced."""
    clean = customers(spark, sf_dir)
    expected = apply_noise(clean, FIRST_SEED)
    stored = apply_noise(clean, OTHER_SEED)
    issues = compare_rederived(expected, stored, "dataset_not_reproducible", "dataset")
    return issues.select("severity", "code", "rows")


FIRST_SEED = noise(21, ["cust no"], ("typo", 0.05), ("duplicate", 0.10))
OTHER_SEED = noise(22, ["cust no"], ("typo", 0.05), ("duplicate", 0.10))


def _positional_rows(a: str, b: str, columns: list[str]) -> str:
    differs = " OR ".join(f'a."{c}" IS DISTINCT FROM b."{c}"' for c in columns)
    return f"""(SELECT count(*) FROM
  (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {a}) a FULL JOIN
  (SELECT *, row_number() OVER (ORDER BY pos) AS i FROM {b}) b ON a.i = b.i
  WHERE a.i IS NULL OR b.i IS NULL OR {differs})"""


VALIDATE_DATASET_REPRO = f"""
WITH clean AS ({CUSTOMERS}),
x AS ({noise_sql('clean', CUSTOMER_SOURCE_COLUMNS, FIRST_SEED)}),
y AS ({noise_sql('clean', CUSTOMER_SOURCE_COLUMNS, OTHER_SEED)})
SELECT 'error' AS severity, 'dataset_not_reproducible' AS code,
       {_positional_rows('x', 'y', CUSTOMER_SOURCE_COLUMNS)} AS rows"""


def validate_truth_repro(spark, sf_dir):
    """An expected table in which one status was edited by hand."""
    clean = orders(spark, sf_dir)
    expected = migrate(clean, ORDER_TASK, ORDER_SCHEMA)
    edited = F.when(F.col("urgency") == "low", F.lit("lower")).otherwise(F.col("urgency"))
    stored = expected.withColumn("urgency", edited)
    issues = compare_rederived(expected, stored, "ground_truth_not_reproducible", "ground_truth")
    return issues.select("severity", "code", "rows")


VALIDATE_TRUTH_REPRO = f"""
SELECT 'error' AS severity, 'ground_truth_not_reproducible' AS code, count(*) AS rows
FROM ({order_truth_sql(f'({ORDERS})')}) WHERE urgency = 'low'"""


def validate_all(spark, sf_dir):
    """Every check on one package with faults of each kind."""
    clean = customers(spark, sf_dir)
    truth = migrate(clean, CUSTOMER_TASK, CUSTOMER_SCHEMA)
    # one column out of place, one too many, one emptied in part
    sector = F.when(F.col("Nation") == "7", None).otherwise(F.col("Sector"))
    stored = truth.select(
        "Label", "CustomerID", sector.alias("Sector"), "Nation", "Balance", F.col("Nation").alias("Region"), POS
    )
    label = {"task_complexity": "basic", "specification_completeness": "explicit"}
    system = {"name": "s", "description": "s"}
    package = Package(
        root="",
        scenario=parse(Scenario, {"scenario_id": "S1", "name": "n", "domain": "d", "description": "d", "business_objects": [], "systems": {"source": system, "target": system}}),
        task=CUSTOMER_TASK,
        metadata=parse(Metadata, {"scenario_id": "S2", "task_id": "OTHER", "version": 1.0, "author": "a", "created": "c", "data_quality": "clean", "seed": 1, **label}),
        dataset=apply_noise(clean, CUSTOMER_NOISE),
        clean_dataset=clean,
        ground_truth=stored,
        source_schema=schema("SRC", "cust no", "cust.name", "nation", "balance", "zip"),
        target_schema=CUSTOMER_SCHEMA,
        noise=CUSTOMER_NOISE,
    )
    return validate_package(package).select("severity", "code", "subject", "rows")


VALIDATE_ALL = f"""
WITH clean AS ({CUSTOMERS}), truth AS ({customer_truth_sql('clean')})
SELECT * FROM (VALUES
  ('error', 'unexpected_column', 'ground_truth', CAST(NULL AS BIGINT)),
  ('error', 'column_order_mismatch', 'ground_truth', NULL),
  ('warning', 'clean_dataset_schema_mismatch', 'clean_dataset', NULL),
  ('error', 'scenario_id_mismatch', 'metadata', NULL),
  ('error', 'task_id_mismatch', 'metadata', NULL),
  ('warning', 'seed_mismatch', 'metadata', NULL),
  ('error', 'data_quality_mismatch', 'metadata', NULL),
  ('error', 'ground_truth_not_reproducible', 'ground_truth', NULL)
) v(severity, code, subject, rows)
UNION ALL
SELECT 'error', 'required_value_missing', 'ground_truth', count(*) FROM truth WHERE "Nation" = '7'"""


QUERIES = {
    "join_first_occurrence": (join_first_occurrence, JOIN_FIRST),
    "join_rule_fanout": (join_rule_fanout, JOIN_FANOUT),
    "join_positional": (join_positional, JOIN_POSITIONAL),
    "best_match": (
        best_match_customers,
        f"{_CUSTOMER_WITH}, {_matches_sql(CUSTOMER_COLUMNS)} SELECT truth_pos, output_pos, matched FROM matches",
    ),
    "best_match_orders": (
        best_match_orders,
        f"{_ORDER_WITH}, {_matches_sql(_PLAIN_ORDER_COLUMNS)} SELECT truth_pos, output_pos, matched FROM matches",
    ),
    "best_match_wide": (best_match_wide, _wide_match_sql(WIDE_NOISE)),
    "best_match_bad": (best_match_bad, _wide_match_sql(BAD_NOISE)),
    "evaluate_many": (evaluate_many_runs, EVALUATE_MANY),
    "fit_stats": (
        fit_stats,
        f"""SELECT CAST(min(CAST(total AS DECIMAL(12,2))) AS VARCHAR) AS low,
              CAST(max(CAST(total AS DECIMAL(12,2))) AS VARCHAR) AS high,
              max(length(regexp_extract(total, '^-?\\d+\\.(\\d+)$', 1))) AS places,
              CAST(CAST(min(strptime("order date", '%d.%m.%Y')) AS DATE) AS VARCHAR) AS first_day,
              CAST(CAST(max(strptime("order date", '%d.%m.%Y')) AS DATE) AS VARCHAR) AS last_day FROM ({ORDERS})""",
    ),
    "value_counts": (
        value_counts,
        f"""SELECT "return flag" AS label, count(*) AS n FROM ({LINEITEMS}) GROUP BY 1""",
    ),
    "first_seen_order": (
        first_seen_order,
        "SELECT event_type AS label, count(*) AS n, min(event_id) AS first_pos FROM events GROUP BY 1",
    ),
    "first_per_customer": (
        first_per_customer,
        f"""SELECT * EXCLUDE (pos) FROM ({ORDERS})
            QUALIFY row_number() OVER (PARTITION BY "cust no" ORDER BY pos) = 1""",
    ),
    "row_multiset": (
        row_multiset_lines,
        f"""SELECT *, count(*) AS n FROM (
            SELECT * FROM ({LINEITEMS}) UNION ALL SELECT * FROM ({LINEITEMS}) WHERE line <> '1') GROUP BY ALL""",
    ),
    "multiset_overlap": (multiset_overlap_orders, MULTISET_OVERLAP),
    "dup_keys": (
        dup_keys,
        f"""SELECT * FROM (
            SELECT 'order no.' AS "column", "order no." AS value, count(*) AS n FROM ({LINEITEMS}) GROUP BY ALL
            UNION ALL SELECT 'line', line, count(*) FROM ({LINEITEMS}) GROUP BY ALL
            UNION ALL SELECT 'status', nullif(status, 'O'), count(*) FROM ({LINEITEMS}) GROUP BY ALL) WHERE n > 1""",
    ),
    "null_counts": (
        null_cells,
        f"""SELECT {', '.join(f'count(*) FILTER (WHERE "{c}" IS NULL) AS "{c}"' for c in ORDER_SOURCE_COLUMNS)}
            FROM ({noise_sql(f'({ORDERS})', ORDER_SOURCE_COLUMNS, ORDER_NOISE)})""",
    ),
    "populated_columns": (
        populated_columns,
        f"""{_CUSTOMER_WITH} SELECT {', '.join(f'round({_populated_sql(c)}, 6) AS "{c}"' for c in CUSTOMER_COLUMNS)},
            CAST(0.0 AS DOUBLE) AS "Email" FROM output""",
    ),
    "frame_diff": (frame_diff, _frame_diff_sql()),
    "metric_row": (
        _metric(row_accuracy, _order_scoring, "matched_rows", "expected_rows"),
        f"""{_ORDER_WITH}, {_overlap_sql(_PLAIN_ORDER_COLUMNS)}
            SELECT 'row_accuracy' AS name, {_ratio('matched_rows', 'left_rows')} AS score, matched_rows,
                   left_rows AS expected_rows FROM overlap""",
    ),
    "metric_filtering": (
        _metric(filtering_accuracy, _order_scoring, "expected_rows", "actual_rows"),
        f"""{_ORDER_WITH} SELECT 'filtering_accuracy' AS name, round({_FILTERING}, 6) AS score,
            (SELECT count(*) FROM truth) AS expected_rows, (SELECT count(*) FROM output) AS actual_rows""",
    ),
    "metric_field_mapping": (
        _metric(field_mapping_accuracy, _order_scoring),
        f"""{_ORDER_WITH} SELECT 'field_mapping_accuracy' AS name,
            round(({' + '.join(_populated_sql(c) for c in _PLAIN_ORDER_COLUMNS)}) / 4, 6) AS score FROM output""",
    ),
    "metric_transformation": (
        _metric(transformation_accuracy, _order_scoring, "matched_cells", "total_cells"),
        f"""{_ORDER_WITH}, {_matches_sql(_PLAIN_ORDER_COLUMNS)}
            SELECT 'transformation_accuracy' AS name, {_ratio('sum(matched)', '(count(*) * 4)')} AS score,
                   CAST(sum(matched) AS BIGINT) AS matched_cells, count(*) * 4 AS total_cells FROM matches""",
    ),
    "metric_record": (
        _metric(record_accuracy, _order_scoring, "near_matches", "total_records"),
        f"""{_ORDER_WITH}, {_matches_sql(_PLAIN_ORDER_COLUMNS)}
            SELECT 'record_accuracy' AS name, {_ratio(_near(4), 'count(*)')} AS score,
                   {_near(4)} AS near_matches, count(*) AS total_records FROM matches""",
    ),
    "metric_error_correction": (
        _metric(error_correction_accuracy, _order_scoring, "checked", "correct"),
        f"""{_ORDER_WITH}, {_matches_sql(_PLAIN_ORDER_COLUMNS)}, {_ORDER_CORRECTION}
            SELECT 'error_correction_accuracy' AS name, {_ratio('count(*) FILTER (WHERE ok)', 'count(*)')} AS score,
                   count(*) AS checked, count(*) FILTER (WHERE ok) AS correct FROM checks""",
    ),
    "metric_reproduction": (
        _metric(
            lambda s: reproduction_score(s.truth, s.output), _customer_scoring, "matched_rows", "expected_rows"
        ),
        f"""{_CUSTOMER_WITH}, {_overlap_sql(CUSTOMER_COLUMNS)}
            SELECT 'reproducibility' AS name, {_ratio('matched_rows', 'left_rows')} AS score, matched_rows,
                   left_rows AS expected_rows FROM overlap""",
    ),
    "evaluate_all": (evaluate_all, EVALUATE_ALL),
    "validate_values": (validate_values, VALIDATE_VALUES),
    "validate_dataset_repro": (validate_dataset_repro, VALIDATE_DATASET_REPRO),
    "validate_truth_repro": (validate_truth_repro, VALIDATE_TRUTH_REPRO),
    "validate_all": (validate_all, VALIDATE_ALL),
}
