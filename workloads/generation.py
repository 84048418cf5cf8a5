"""Synthesis, noise and whole bundles."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import functions as F

from tabshift.functions.names import POS, col
from tabshift.functions.words import (
    ADJECTIVES,
    CITIES,
    COMPANY_FORMS,
    FIRST_NAMES,
    FIRST_POSTCODE,
    NOUNS,
    POSTCODES,
    STREET_ENDINGS,
    STREET_WORDS,
    SURNAMES,
    VERBS,
)
from tabshift.operators.compare import value_leaks
from tabshift.operators.noise import apply_noise
from tabshift.operators.synth import STRATEGIES, Strategy, synthesize
from tabshift.plans.build import build_package, derive_bundle
from tabshift.session import shared_folder
from tabshift.sources.bundle import SOURCE_TABLE
from tabshift.sources.csv import write_table
from workloads.specs import (
    CUSTOMER_NOISE,
    SUPPLIER_SCHEMA,
    SUPPLIER_TASK,
    grid_sql,
    noise,
    noise_sql,
    pick_sql,
    schema,
    supplier_truth_sql,
    synthesis,
    u_sql,
    word_sql,
)
from workloads.tables import (
    CUSTOMERS,
    LINEITEM_KEY,
    LINEITEMS,
    ORDERS,
    PARTS,
    SUPPLIERS,
    customers,
    lineitems,
    orders,
    parts,
    suppliers,
)

SEED = 417
IDENTITY = {"strategy": "identity"}


def _synth(table, keys, columns):
    """Synthesize some columns next to the table's key."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir)
        df = df.select(*[col(c) for c in [*keys, *columns]], POS)
        config = synthesis(SEED, **{k: IDENTITY for k in keys}, **columns)
        return synthesize(df, config).drop(POS)

    return run


def category_sql(column: str, relation: str) -> str:
    """Label whose cumulated share, in first-seen order, exceeds the draw."""
    return f"""(SELECT label FROM (
        SELECT label, first_pos, CAST(sum(n) OVER (ORDER BY first_pos) AS DOUBLE)
               / CAST(sum(n) OVER () AS DOUBLE) AS upto
        FROM (SELECT {column} AS label, count(*) AS n, min(pos) AS first_pos
              FROM {relation} GROUP BY 1)) w
        WHERE w.upto > x.u ORDER BY first_pos LIMIT 1)"""


PROVIDED = {
    "name 1": {"strategy": "faker", "provider": "company"},
    "country code": {"strategy": "faker", "provider": "city"},
    "balance": {"strategy": "faker", "provider": "postcode"},
}


def synth_provider(spark, sf_dir):
    """One column per provider, named after it."""
    base = customers(spark, sf_dir)
    names = ("company", "postcode", "city", "street_name", "building_number", "bs", "user_name")
    df = base.select(col("cust no"), *[F.col("segment").alias(n) for n in names], POS)
    config = synthesis(
        SEED, **{"cust no": IDENTITY}, **{n: {"strategy": "faker", "provider": n} for n in names}
    )
    return synthesize(df, config).drop(POS)


def _w(column, k, words):
    return word_sql(SEED, column, k, words)


def _p(column, k, n):
    return pick_sql(SEED, column, k, n)


SYNTH_PROVIDER = f"""
SELECT "cust no",
  {_w('company', 0, SURNAMES)} || ' ' || {_w('company', 1, SURNAMES)} || ' ' || {_w('company', 2, COMPANY_FORMS)} AS company,
  lpad(CAST({_p('postcode', 0, POSTCODES)} + {FIRST_POSTCODE} AS VARCHAR), 5, '0') AS postcode,
  {_w('city', 0, CITIES)} AS city,
  {_w('street_name', 0, STREET_WORDS)} || {_w('street_name', 1, STREET_ENDINGS)} AS street_name,
  CAST({_p('building_number', 0, 250)} + 1 AS VARCHAR) AS building_number,
  {_w('bs', 0, VERBS)} || ' ' || {_w('bs', 1, ADJECTIVES)} || ' ' || {_w('bs', 2, NOUNS)} AS bs,
  {_w('user_name', 0, FIRST_NAMES)} || lpad(CAST({_p('user_name', 1, 100)} AS VARCHAR), 2, '0') AS user_name
FROM ({CUSTOMERS})"""

SUPPLIER_SYNTHESIS = {
    "supplier no": {"strategy": "unique_sequence", "format": "{:08d}", "start": 26000000},
    "name 1": {"strategy": "faker", "provider": "company"},
    "country code": {"strategy": "identity"},
    "balance": {"strategy": "numeric_distribution"},
}


def clean_supplier_sql() -> str:
    return f"""
SELECT CAST(26000000 + row_number() OVER (ORDER BY pos) - 1 AS VARCHAR) AS "supplier no",
  {_w('name 1', 0, SURNAMES)} || ' ' || {_w('name 1', 1, SURNAMES)} || ' ' || {_w('name 1', 2, COMPANY_FORMS)} AS "name 1",
  "country code",
  {grid_sql(SEED, 'balance', f'({SUPPLIERS})', 'CAST(balance AS DECIMAL(12,2))', 2)} AS balance,
  pos
FROM ({SUPPLIERS})"""


def synth_table(spark, sf_dir):
    return synthesize(suppliers(spark, sf_dir), synthesis(SEED, **SUPPLIER_SYNTHESIS)).drop(POS)


def leak_check(spark, sf_dir):
    """Protected columns share no value with the source, others do."""
    source = customers(spark, sf_dir)
    config = synthesis(
        SEED,
        **{
            "cust no": {"strategy": "unique_sequence", "format": "C{:06d}"},
            "cust.name": {"strategy": "faker", "provider": "company"},
            "nation": {"strategy": "numeric_distribution"},
            "balance": IDENTITY,
            "segment": {"strategy": "categorical_resample"},
        },
    )
    return value_leaks(source, synthesize(source, config), ["cust no", "cust.name", "nation", "balance", "segment"])


LEAK_CHECK = f"""
WITH src AS ({CUSTOMERS}),
synth AS (SELECT {grid_sql(SEED, 'nation', 'src', 'CAST(nation AS DECIMAL(12,0))', 0)} AS nation,
                 {category_sql('segment', 'src')} AS segment
          FROM (SELECT pos, {u_sql(SEED, 'segment')} AS u FROM src) x)
SELECT 'cust no' AS "column", CAST(0 AS BIGINT) AS leaked_values
UNION ALL SELECT 'cust.name', CAST(0 AS BIGINT)
UNION ALL SELECT 'nation', count(DISTINCT nation) FROM synth WHERE nation IN (SELECT nation FROM src)
UNION ALL SELECT 'balance', count(DISTINCT balance) FROM src
UNION ALL SELECT 'segment', count(DISTINCT segment) FROM synth WHERE segment IN (SELECT segment FROM src)"""

_CUSTOMER_COLUMNS = ["cust no", "cust.name", "nation", "balance", "segment"]
_LINE_COLUMNS = ["order no.", "part no.", "supplier no", "line", "price", "return flag", "status", "ship date"]
_LINE_RID = """
    length("order no.") || ':' || "order no."
    || length("part no.") || ':' || "part no."
    || length("supplier no") || ':' || "supplier no"
    || length(line) || ':' || line """

TYPO = noise(1, ["cust no"], ("typo", 0.5))
MISSING = noise(2, ["cust no"], ("missing_value", 0.25))
DUPLICATE = noise(3, [], ("duplicate", 0.3))
TYPO_THEN_COPY = noise(4, ["cust no"], ("typo", 0.4), ("duplicate", 0.4))
COPY_THEN_TYPO = noise(4, ["cust no"], ("duplicate", 0.4), ("typo", 0.4))
LINES = noise(
    5, LINEITEM_KEY, ("typo", 0.06), ("duplicate", 0.08), ("missing_value", 0.02), ("duplicate", 0.02)
)


def _noise(config):
    def run(spark, sf_dir):
        return apply_noise(customers(spark, sf_dir), config).drop(POS)

    return run


def _customer_noise_sql(config):
    listed = ", ".join(f'"{c}"' for c in _CUSTOMER_COLUMNS)
    return f"SELECT {listed} FROM ({noise_sql(f'({CUSTOMERS})', _CUSTOMER_COLUMNS, config)})"


def noise_lineitem(spark, sf_dir):
    """Rows identified by business keys; no shuffle at any size."""
    return apply_noise(lineitems(spark, sf_dir), LINES, row_key=LINEITEM_KEY)


BUNDLE_NOISE = noise(58, ["supplier no", "country code"], ("typo", 0.06), ("duplicate", 0.08), ("missing_value", 0.02))


def build_bundle(spark, sf_dir):
    """Source -> clean -> damaged dataset and expected table, as labelled rows."""
    bundle = derive_bundle(
        suppliers(spark, sf_dir), synthesis(SEED, **SUPPLIER_SYNTHESIS), BUNDLE_NOISE,
        SUPPLIER_TASK, SUPPLIER_SCHEMA,
    )
    return _labelled_rows(bundle.clean, bundle.dataset, bundle.truth)


def _labelled_rows(clean, dataset, truth):
    out = None
    for name, df in (("clean", clean), ("dataset", dataset), ("truth", truth)):
        cells = [F.coalesce(col(c), F.lit("~")) for c in df.columns if c != POS]
        rows = df.select(F.lit(name).alias("bundle_table"), F.concat_ws("|", *cells).alias("row_text"))
        out = rows if out is None else out.unionAll(rows)
    return out


def bundle_load(spark, sf_dir):
    """The same package built on disk: specs and source in a folder, three tables
    derived, written as CSV and loaded again."""
    root = shared_folder(spark, "package")
    write_table(suppliers(spark, sf_dir), f"{root}/{SOURCE_TABLE}")
    system = {"name": "s", "description": "s"}
    specs = {
        "task.yaml": asdict(SUPPLIER_TASK),
        "schemas/source_schema.yaml": asdict(schema("SRC", *_SUPPLIER_COLUMNS)),
        "schemas/target_schema.yaml": asdict(SUPPLIER_SCHEMA),
        "noise_configuration.yaml": asdict(BUNDLE_NOISE),
        "synthesis_configuration.yaml": asdict(synthesis(SEED, **SUPPLIER_SYNTHESIS)),
        "scenario.yaml": {
            "scenario_id": "S", "name": "n", "domain": "d", "description": "d",
            "business_objects": [], "systems": {"source": system, "target": system},
        },
        "metadata.yaml": {
            "scenario_id": "S", "task_id": SUPPLIER_TASK.task_id, "version": "1", "author": "a",
            "created": "c", "task_complexity": "basic", "specification_completeness": "explicit",
            "data_quality": "noisy", "seed": BUNDLE_NOISE.seed,
        },
    }
    for name, content in specs.items():
        document = spark.createDataFrame([(json.dumps(_open_params(content)),)], "value string")
        document.coalesce(1).write.text(f"{root}/{name}")
    package = build_package(spark, root)
    return _labelled_rows(package.clean_dataset, package.dataset, package.ground_truth)


def _open_params(value):
    """Spec dictionary as it is written in a file: extra keys next to the others."""
    if isinstance(value, dict):
        flat = {k: _open_params(v) for k, v in value.items() if k != "params"}
        return {**flat, **value.get("params", {})}
    if isinstance(value, list):
        return [_open_params(v) for v in value]
    return value


def _row_text(columns):
    return " || '|' || ".join(f"""coalesce("{c}", '~')""" for c in columns)


_SUPPLIER_COLUMNS = ["supplier no", "name 1", "country code", "balance"]
# rows are numbered again before drawing; supplier keys are dense already
BUILD_BUNDLE = f"""
WITH clean AS ({clean_supplier_sql()})
SELECT 'clean' AS bundle_table, {_row_text(_SUPPLIER_COLUMNS)} AS row_text FROM clean
UNION ALL
SELECT 'dataset', {_row_text(_SUPPLIER_COLUMNS)}
FROM ({noise_sql('clean', _SUPPLIER_COLUMNS, BUNDLE_NOISE)})
UNION ALL
SELECT 'truth', {_row_text(['partner_no', 'name', 'country', 'remark'])}
FROM ({supplier_truth_sql('clean')})"""

# --- wide numbers, many labels, strategies of the caller's own ------------------


def _wide_orders(spark, sf_dir):
    """Codes of 30 digits, and numbers with 24 decimal places of both signs."""
    number = F.lpad(col("order no."), 24, "0")
    sign = F.when(F.col(POS) % 2 == 0, "-").otherwise("")
    return orders(spark, sf_dir).select(
        col("order no."),
        F.concat(F.lit("123456"), F.reverse(number)).alias("code"),
        F.concat(sign, F.lit("3."), F.reverse(number)).alias("ratio"),
        POS,
    )


WIDE = {"strategy": "numeric_distribution"}
synth_wide = _synth(_wide_orders, ["order no."], {"code": WIDE, "ratio": WIDE})


def _wide_sql(column: str) -> str:
    """The high half of 128 random bits times the size of the grid, in limbs of 32 bits."""
    limb, text = 1 << 32, f"md5('{SEED}|{column}|0|' || CAST(pos AS VARCHAR))"
    u = ", ".join(f"CAST(CAST('0x' || substr({text}, {25 - 8 * k}, 8) AS BIGINT) AS HUGEINT) AS u{k}" for k in range(4))
    m = ", ".join(f"(high - low + 1) // CAST({limb**k} AS HUGEINT) % {limb} AS m{k}" for k in range(4))
    p = ", ".join(" + ".join(f"u{i} * m{k - i}" for i in range(4) if 0 <= k - i < 4) + f" AS p{k}" for k in range(7))
    carry = "0"
    for k in range(4):
        carry = f"(({carry} + p{k}) // {limb})"
    return f"""
SELECT pos, low + (p6 * {limb} + p5) * {limb} + p4 + {carry} AS n FROM (
  SELECT pos, low, {p} FROM (SELECT pos, low, {u}, {m} FROM wide, (SELECT min({column}) AS low, max({column}) AS high FROM wide)))"""


SYNTH_WIDE = f"""
WITH wide AS MATERIALIZED (
  SELECT "order no.", pos, CAST('123456' || r AS HUGEINT) AS code, CAST(CASE WHEN pos % 2 = 0 THEN '-' ELSE '' END || '3' || r AS HUGEINT) AS ratio
  FROM (SELECT *, reverse(lpad("order no.", 24, '0')) AS r FROM ({ORDERS}))
)
SELECT "order no.", CAST(c.n AS VARCHAR) AS code,
  CASE WHEN r.n < 0 THEN '-' ELSE '' END || regexp_replace(lpad(CAST(abs(r.n) AS VARCHAR), CAST(greatest(25, length(CAST(abs(r.n) AS VARCHAR))) AS INTEGER), '0'), '(.{{24}})$', '.\\1') AS ratio
FROM wide JOIN ({_wide_sql('code')}) c USING (pos) JOIN ({_wide_sql('ratio')}) r USING (pos)"""


def _labelled_orders(spark, sf_dir):
    """Some ten thousand labels, a few of them frequent."""
    n = F.col(POS) % 10_007
    label = F.concat(F.lit("L"), F.when(F.col(POS) % 5 == 0, n % 3).otherwise(n).cast("string"))
    return orders(spark, sf_dir).select(col("order no."), label.alias("label"), POS)


synth_category_large = _synth(
    _labelled_orders, ["order no."], {"label": {"strategy": "categorical_resample", "max_cardinality": 20_000}}
)
SYNTH_CATEGORY_LARGE = f"""
WITH src AS (SELECT "order no.", pos, 'L' || CASE WHEN pos % 5 = 0 THEN pos % 10007 % 3 ELSE pos % 10007 END AS label FROM ({ORDERS})),
counts AS (SELECT label, count(*) AS n, min(pos) AS first FROM src GROUP BY 1),
ranges AS (SELECT label, sum(n) OVER (ORDER BY first) - n AS low, sum(n) OVER (ORDER BY first) AS high FROM counts),
drawn AS (SELECT "order no.", least(CAST(floor({u_sql(SEED, 'label')} * CAST(total AS DOUBLE)) AS BIGINT), total - 1) AS d
  FROM src, (SELECT CAST(sum(n) AS BIGINT) AS total FROM counts))
SELECT "order no.", label FROM drawn JOIN ranges ON d >= low AND d < high"""


def registry_synthesis(spark, sf_dir):
    """A strategy of the caller's own: numbers are rounded to the fitted maximum's half."""

    class Half(Strategy):
        def fit(self, config):
            return {"high": F.max(col(config.column).cast("decimal(12,2)"))}

        def draw(self, config, fitted, context):
            above = col(config.column).cast("decimal(12,2)") * 2 > F.lit(fitted["high"])
            return F.when(above, F.lit("upper")).otherwise(F.lit("lower"))

    df = orders(spark, sf_dir).select(col("order no."), "total", POS)
    config = synthesis(SEED, **{"order no.": IDENTITY, "total": {"strategy": "half"}})
    return synthesize(df, config, {**STRATEGIES, "half": Half()}).drop(POS)


REGISTRY_SYNTHESIS = f"""
SELECT "order no.", CASE WHEN CAST(total AS DECIMAL(12,2)) * 2 > (SELECT max(CAST(total AS DECIMAL(12,2))) FROM ({ORDERS})) THEN 'upper' ELSE 'lower' END AS total
FROM ({ORDERS})"""

QUERIES = {
    "synth_wide": (synth_wide, SYNTH_WIDE),
    "synth_category_large": (synth_category_large, SYNTH_CATEGORY_LARGE),
    "registry_synthesis": (registry_synthesis, REGISTRY_SYNTHESIS),
    "synth_numeric": (
        _synth(
            customers,
            ["cust no"],
            {"balance": {"strategy": "numeric_distribution"}, "nation": {"strategy": "numeric_distribution"}},
        ),
        f"""SELECT "cust no",
              {grid_sql(SEED, 'balance', f'({CUSTOMERS})', 'CAST(balance AS DECIMAL(12,2))', 2)} AS balance,
              {grid_sql(SEED, 'nation', f'({CUSTOMERS})', 'CAST(nation AS DECIMAL(12,0))', 0)} AS nation
            FROM ({CUSTOMERS})""",
    ),
    "synth_date": (
        _synth(
            orders,
            ["order no."],
            {
                "order date": {"strategy": "date_distribution", "field_format": "DD.MM.YYYY"},
                "short date": {"strategy": "date_distribution", "field_format": "DD.MM.YY"},
            },
        ),
        f"""WITH src AS ({ORDERS}),
            span AS (SELECT min(strptime("order date", '%d.%m.%Y')::DATE) AS lo,
                            max(strptime("order date", '%d.%m.%Y')::DATE) AS hi FROM src)
            SELECT "order no.",
              strftime(lo + CAST(floor({u_sql(SEED, 'order date')} * CAST(hi - lo AS DOUBLE)) AS INTEGER), '%d.%m.%Y') AS "order date",
              strftime(lo + CAST(floor({u_sql(SEED, 'short date')} * CAST(hi - lo AS DOUBLE)) AS INTEGER), '%d.%m.%y') AS "short date"
            FROM src, span""",
    ),
    "synth_sequence": (
        _synth(
            parts,
            ["name"],
            {"part no.": {"strategy": "unique_sequence", "format": "{:04d}-77", "start": 8200}},
        ),
        f"""SELECT name, lpad(CAST(8200 + row_number() OVER (ORDER BY pos) - 1 AS VARCHAR),
                   CAST(greatest(4, length(CAST(8200 + row_number() OVER (ORDER BY pos) - 1 AS VARCHAR))) AS INTEGER), '0')
                   || '-77' AS "part no." FROM ({PARTS})""",
    ),
    "synth_category": (
        _synth(
            orders,
            ["order no."],
            {"priority": {"strategy": "categorical_resample"}, "status": {"strategy": "categorical_resample"}},
        ),
        f"""WITH src AS ({ORDERS}),
            a AS (SELECT "order no.", {category_sql('priority', 'src')} AS priority
                  FROM (SELECT *, {u_sql(SEED, 'priority')} AS u FROM src) x),
            b AS (SELECT "order no.", {category_sql('status', 'src')} AS status
                  FROM (SELECT *, {u_sql(SEED, 'status')} AS u FROM src) x)
            SELECT a."order no.", priority, status FROM a JOIN b ON a."order no." = b."order no." """,
    ),
    "synth_identity": (
        _synth(customers, ["cust no"], {"cust.name": IDENTITY, "segment": IDENTITY}),
        f"""SELECT "cust no", "cust.name", segment FROM ({CUSTOMERS})""",
    ),
    "synth_provider": (synth_provider, SYNTH_PROVIDER),
    "synth_table": (synth_table, f"SELECT * EXCLUDE (pos) FROM ({clean_supplier_sql()})"),
    "leak_check": (leak_check, LEAK_CHECK),
    "noise_typo": (_noise(TYPO), _customer_noise_sql(TYPO)),
    "noise_missing": (_noise(MISSING), _customer_noise_sql(MISSING)),
    "noise_duplicate": (_noise(DUPLICATE), _customer_noise_sql(DUPLICATE)),
    "noise_typo_then_copy": (_noise(TYPO_THEN_COPY), _customer_noise_sql(TYPO_THEN_COPY)),
    "noise_copy_then_typo": (_noise(COPY_THEN_TYPO), _customer_noise_sql(COPY_THEN_TYPO)),
    "noise_excluded": (_noise(CUSTOMER_NOISE), _customer_noise_sql(CUSTOMER_NOISE)),
    "noise_lineitem": (
        noise_lineitem,
        noise_sql(f"({LINEITEMS})", _LINE_COLUMNS, LINES, rid=_LINE_RID, has_pos=False),
    ),
    "build_bundle": (build_bundle, BUILD_BUNDLE),
    "bundle_load": (bundle_load, BUILD_BUNDLE),
}
