"""Awkward tables: line breaks, blank rows, wide codes, broken cells, missing parts of
packages. Each query builds its case from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabshift.functions.names import POS, col
from tabshift.operators.checks import issue_frame, target_column_issues, value_issues
from tabshift.operators.compare import value_leaks
from tabshift.operators.filters import apply_filtering
from tabshift.operators.mappings import HANDLERS, Mapped
from tabshift.operators.metrics import METRICS, Scoring
from tabshift.operators.noise import apply_noise
from tabshift.operators.order import with_index
from tabshift.plans.build import build_package
from tabshift.plans.migrate import migrate, migrate_with_quarantine
from tabshift.plans.validate import completeness_issues
from tabshift.session import shared_folder
from tabshift.sources.bundle import SOURCE_TABLE, required_table
from tabshift.sources.csv import read_table, write_table
from workloads.specs import ORDER_SCHEMA, ORDER_TASK, filtering, noise, noise_sql, order_truth_sql, schema, task
from workloads.specs import rule as mapping_rule
from workloads.tables import CUSTOMERS, ORDERS, SUPPLIERS, customers, orders, suppliers


def _back(spark, df, name, **how):
    folder = shared_folder(spark, name)
    write_table(df, folder)
    back = with_index(read_table(spark, folder, **how))
    return back.select(*[col(c) for c in back.columns if c not in (POS, "_idx")], F.col("_idx").alias("row_index"))


def csv_line_breaks(spark, sf_dir):
    """Names with line breaks, quotes and delimiters survive writing and reading."""
    df = customers(spark, sf_dir)
    name = F.concat(col("cust.name"), F.lit('\nc/o "x", '), F.col("nation"))
    return _back(spark, df.select("`cust no`", name.alias("name"), POS), "csv", split=True)


CSV_LINE_BREAKS = f"""
SELECT "cust no", "cust.name" || chr(10) || 'c/o "x", ' || nation AS name,
       row_number() OVER (ORDER BY pos) - 1 AS row_index FROM ({CUSTOMERS})"""


def csv_single_column(spark, sf_dir):
    """Missing cells of a table with one column stay rows."""
    status = F.nullif(F.col("status"), F.lit("F")).alias("status")
    return _back(spark, orders(spark, sf_dir).select(status, POS), "csv")


CSV_SINGLE_COLUMN = f"""
SELECT nullif(status, 'F') AS status, row_number() OVER (ORDER BY pos) - 1 AS row_index FROM ({ORDERS})"""


def csv_short_lines(spark, sf_dir):
    """The delimiter of short lines shows only beyond the first of them."""
    folder = shared_folder(spark, "csv")
    df = customers(spark, sf_dir).select(col("cust no").alias("k"), F.col("nation").alias("n"))
    df.write.option("header", True).option("sep", ";").csv(folder)
    return read_table(spark, folder).drop(POS)


_CODE = "9007199254740993"


def filter_wide_codes(spark, sf_dir):
    """Codes of 22 digits are compared exactly: neighbours differ."""
    code = F.concat(F.lit(_CODE), F.lpad(col("order no."), 6, "0"))
    df = orders(spark, sf_dir).select(code.alias("code"), POS)
    kept = apply_filtering(df, filtering({"field": "code", "operator": ">", "value": int(f"{_CODE}000700")}))
    return kept.drop(POS)


FILTER_WIDE_CODES = f"""
SELECT code FROM (SELECT '{_CODE}' || lpad("order no.", 6, '0') AS code FROM ({ORDERS}))
WHERE CAST(code AS HUGEINT) > CAST('{_CODE}000700' AS HUGEINT)"""


def migrate_quarantine_counts(spark, sf_dir):
    """Rows with a priority nobody maps are set aside; both results from one marked pass."""
    df = orders(spark, sf_dir).withColumn("priority", F.when(F.col("status") == "P", "new").otherwise(F.col("priority")))
    done = migrate_with_quarantine(df, ORDER_TASK, ORDER_SCHEMA)
    count = F.count(F.lit(1)).alias("rows")
    return done.table.agg(F.lit("table").alias("part"), count).unionAll(
        done.quarantine.agg(F.lit("quarantine").alias("part"), count)
    )


MIGRATE_QUARANTINE_COUNTS = f"""
WITH kept AS (SELECT status = 'P' AS bad FROM ({ORDERS}) WHERE strptime("order date", '%d.%m.%Y') >= DATE '1997-01-01')
SELECT 'table' AS part, count(*) FILTER (WHERE NOT bad) AS rows FROM kept
UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE bad) FROM kept"""


def registry_mapping(spark, sf_dir):
    """A handler of the caller's own under a new name, beside the built-in ones."""

    def shout(rule, context):
        return Mapped(F.upper(F.reverse(col(rule.source_field))))

    own = task("own", None, [mapping_rule("cust.name", "name", "shout"), mapping_rule("cust no", "id", "copy")])
    handlers = {**HANDLERS, "shout": shout}
    return migrate(customers(spark, sf_dir), own, schema("OWN", "id", "name"), handlers=handlers).drop(POS)


def registry_noise(spark, sf_dir):
    """A noise model of the caller's own: it blanks a column's texts whole."""

    def blank(df, step, seed, number, columns):
        return df.withColumns({c: F.lit("#") for c in columns})

    config = noise(1, ["cust no", "segment"], ("blank", 1.0))
    df = customers(spark, sf_dir).drop("cust.name", "balance")
    return apply_noise(df, config, models={"blank": blank}).drop(POS)


_SUPPLIER_SCHEMA = schema("SUPPLIERS", "supplier no", "name 1", "country code", "balance", required=("supplier no", "balance"), unique=("supplier no", "country code"))
_SUPPLIER_NOISE = noise(17, ["name 1"], ("missing_value", 0.02), ("duplicate", 0.03))
_SUPPLIER_COLUMNS = ["supplier no", "name 1", "country code", "balance"]


def validate_missing_files(spark, sf_dir):
    """A package folder that holds its source table alone: every absent file is named, and
    what is wrong with the rows that are there."""
    root = shared_folder(spark, "package")
    write_table(apply_noise(suppliers(spark, sf_dir), _SUPPLIER_NOISE), f"{root}/source_data/source_data.csv")
    absent = issue_frame(spark, completeness_issues(spark, root))
    found = value_issues(read_table(spark, f"{root}/source_data/source_data.csv"), _SUPPLIER_SCHEMA, "source")
    return absent.unionByName(found).select("severity", "code", "subject", "message", "rows")


VALIDATE_MISSING_FILES = f"""
WITH d AS MATERIALIZED ({noise_sql(f'({SUPPLIERS})', _SUPPLIER_COLUMNS, _SUPPLIER_NOISE)})
SELECT 'error' AS severity, 'missing_file' AS code, 'required file' AS subject, 'required file is missing: ' || f AS message, CAST(NULL AS BIGINT) AS rows
FROM (VALUES ('scenario.yaml'), ('task.yaml'), ('metadata.yaml')) v(f)
UNION ALL SELECT * FROM (
  SELECT 'error', 'required_value_missing', 'source', 'required column ''supplier no'' has missing values', count(*) AS n FROM d WHERE "supplier no" IS NULL
  UNION ALL SELECT 'error', 'required_value_missing', 'source', 'required column ''balance'' has missing values', count(*) FROM d WHERE balance IS NULL
  UNION ALL SELECT 'error', 'uniqueness_violation', 'source', 'unique column ''supplier no'' has repeated values', sum(n)::BIGINT
    FROM (SELECT count(*) AS n FROM d GROUP BY "supplier no") WHERE n > 1
  UNION ALL SELECT 'error', 'uniqueness_violation', 'source', 'unique column ''country code'' has repeated values', sum(n)::BIGINT
    FROM (SELECT count(*) AS n FROM d GROUP BY "country code") WHERE n > 1) WHERE n > 0"""


def validate_missing_column(spark, sf_dir):
    """A stored table without a required column, with one too many and out of order, and the
    rows that each fault concerns."""
    required = next(a.name for a in ORDER_SCHEMA.attributes if a.required)
    stored = migrate(orders(spark, sf_dir), ORDER_TASK, ORDER_SCHEMA).drop(required).withColumn("extra", F.lit("x"))
    names = [c for c in stored.columns if c != POS]
    stored = stored.select(*reversed(names), POS)
    found = issue_frame(spark, target_column_issues(stored, ORDER_SCHEMA, "ground_truth")).drop("rows")
    return found.crossJoin(stored.agg(F.count("*").alias("rows"))).select("severity", "code", "subject", "rows")  # one row


VALIDATE_MISSING_COLUMN = f"""
SELECT 'error' AS severity, code, 'ground_truth' AS subject, (SELECT count(*) FROM ({order_truth_sql(f'({ORDERS})')})) AS rows
FROM (VALUES ('unexpected_column'), ('missing_required_column'), ('column_order_mismatch')) v(code)"""


def validate_structure(spark, sf_dir):
    """Tables of each segment, one of which has no rows, and how often a nation repeats."""
    df = customers(spark, sf_dir)
    parts = schema("PART", "cust no", "nation", required=("cust no",), unique=("cust no", "nation"))
    found = None
    for segment in ("BUILDING", "MACHINERY", "NO SUCH SEGMENT"):
        one = value_issues(df.filter(F.col("segment") == segment), parts, segment)
        found = one if found is None else found.unionByName(one)
    return found.select("severity", "code", "subject", "rows")


VALIDATE_STRUCTURE = f"""
SELECT 'error' AS severity, 'uniqueness_violation' AS code, segment AS subject, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT segment, nation, count(*) AS n FROM ({CUSTOMERS}) WHERE segment IN ('BUILDING', 'MACHINERY') GROUP BY 1, 2) WHERE n > 1 GROUP BY 3
UNION ALL SELECT 'error', 'empty_csv', 'NO SUCH SEGMENT', NULL"""


def target_example_contract(spark, sf_dir):
    """Without schemas, an example table says which columns the result has, and in which order."""
    root = shared_folder(spark, "package")
    example = customers(spark, sf_dir).select("segment", col("cust no"), F.upper("nation").alias("nation"), POS).filter(F.col(POS) <= 3)
    write_table(example, f"{root}/example.csv")
    write_table(customers(spark, sf_dir), f"{root}/data.csv")
    contract = [c for c in required_table(spark, f"{root}/example.csv").columns if c != POS]
    return required_table(spark, f"{root}/data.csv").select(*[col(c) for c in contract])


def registry_metric(spark, sf_dir):
    """A metric of the caller's own beside a built-in one: the share of longer names."""
    truth = customers(spark, sf_dir).select(col("cust.name").alias("name"), POS)
    output = truth.withColumn("name", F.when(F.col(POS) % 3 == 0, F.lit("short")).otherwise(F.col("name")))

    def longer(s):
        share = F.avg((F.length("name") > 5).cast("double"))
        return s.output.agg(share.alias("score")).select(F.lit("longer").alias("name"), "score", F.create_map().cast("map<string,string>").alias("details"))

    s = Scoring(output=output, truth=truth)
    both = {"longer": longer, "row_accuracy": METRICS["row_accuracy"]}
    parts = [metric(s).select("name", F.round("score", 6).alias("score")) for metric in both.values()]
    return parts[0].unionAll(parts[1])


REGISTRY_METRIC = f"""
WITH o AS (SELECT "cust.name" AS name, CASE WHEN pos % 3 = 0 THEN 'short' ELSE "cust.name" END AS changed FROM ({CUSTOMERS}))
SELECT 'longer' AS name, round(avg(CAST(length(changed) > 5 AS INTEGER)), 6) AS score FROM o
UNION ALL SELECT 'row_accuracy', round(avg(CAST(name = changed AS INTEGER)), 6) FROM o"""


def privacy_gate(spark, sf_dir):
    """Without a synthesis spec a source folder is refused; what would have leaked, by
    column, had its table been published as it is."""
    root = shared_folder(spark, "package")
    table = suppliers(spark, sf_dir)
    write_table(table, f"{root}/{SOURCE_TABLE}")
    try:
        build_package(spark, root)
        refused = F.lit(False)
    except FileNotFoundError:
        refused = F.lit(True)
    written = read_table(spark, f"{root}/{SOURCE_TABLE}")
    return value_leaks(table, written, _SUPPLIER_COLUMNS).select("column", "leaked_values", refused.alias("refused"))


PRIVACY_GATE = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(DISTINCT "{c}") AS leaked_values, true AS refused FROM ({SUPPLIERS})""" for c in _SUPPLIER_COLUMNS
)


QUERIES = {
    "csv_line_breaks": (csv_line_breaks, CSV_LINE_BREAKS),
    "csv_single_column": (csv_single_column, CSV_SINGLE_COLUMN),
    "csv_short_lines": (csv_short_lines, f'SELECT "cust no" AS k, nation AS n FROM ({CUSTOMERS})'),
    "filter_wide_codes": (filter_wide_codes, FILTER_WIDE_CODES),
    "migrate_quarantine_counts": (migrate_quarantine_counts, MIGRATE_QUARANTINE_COUNTS),
    "registry_mapping": (
        registry_mapping,
        f'SELECT "cust no" AS id, upper(reverse("cust.name")) AS name FROM ({CUSTOMERS})',
    ),
    "registry_noise": (registry_noise, f"""SELECT "cust no", '#' AS nation, segment FROM ({CUSTOMERS})"""),
    "validate_missing_files": (validate_missing_files, VALIDATE_MISSING_FILES),
    "validate_missing_column": (validate_missing_column, VALIDATE_MISSING_COLUMN),
    "validate_structure": (validate_structure, VALIDATE_STRUCTURE),
    "target_example_contract": (target_example_contract, f'SELECT segment, "cust no", nation FROM ({CUSTOMERS})'),
    "registry_metric": (registry_metric, REGISTRY_METRIC),
    "privacy_gate": (privacy_gate, PRIVACY_GATE),
}
