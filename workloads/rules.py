"""Filters, field transformations and migrations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabshift.functions.cells import is_populated
from tabshift.functions.names import POS, col
from tabshift.operators.filters import apply_filtering
from tabshift.operators.order import with_index
from tabshift.plans.migrate import migrate, migrate_with_quarantine
from workloads.specs import (
    CUSTOMER_SCHEMA,
    CUSTOMER_TASK,
    ORDER_COLUMNS,
    ORDER_SCHEMA,
    ORDER_TASK,
    PART_SCHEMA,
    PART_TASK,
    PRIORITIES,
    SECTORS,
    SUPPLIER_SCHEMA,
    SUPPLIER_TASK,
    case_sql,
    customer_truth_sql,
    filtering,
    order_truth_sql,
    part_truth_sql,
    rule,
    schema,
    supplier_truth_sql,
    task,
)
from workloads.tables import (
    CUSTOMERS,
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


def _filter(table, *rules):
    def run(spark, sf_dir):
        return apply_filtering(table(spark, sf_dir), filtering(*rules)).drop(POS)

    return run


def filter_ne_null(spark, sf_dir):
    """A missing value differs from the compared one."""
    df = orders(spark, sf_dir).withColumn("priority", F.nullif(F.col("priority"), F.lit("5-LOW")))
    kept = apply_filtering(
        df, filtering({"field": "priority", "operator": "!=", "value": "1-URGENT"})
    )
    return kept.select(col("order no."), "priority")


def filter_none(spark, sf_dir):
    return apply_filtering(suppliers(spark, sf_dir), None).drop(POS)


_MIXED = [("0", "NULL"), ("1", "'nan nan'"), ("2", "'None-NULL'"), ("3", "'<NA>, nat'"), ("4", "'  '"), ("5", "''")]


def populated_flag(spark, sf_dir):
    """Customer labels in which some nations stand for the ways a value can be
    missing."""
    label = F.col("`cust.name`")
    missing = {"0": None, "1": "nan nan", "2": "None-NULL", "3": "<NA>, nat", "4": "  ", "5": ""}
    for nation, text in missing.items():
        label = F.when(F.col("nation") == nation, F.lit(text)).otherwise(label)
    return customers(spark, sf_dir).select(
        col("cust no"), is_populated(label).alias("populated")
    )


POPULATED = f"""
SELECT "cust no",
       coalesce(len(list_filter(regexp_split_to_array(lower(label), '[\\s\\-_/,.]+'),
                lambda x: x <> '' AND x NOT IN ('nan','none','null','nat','<na>'))) > 0, FALSE) AS populated
FROM (SELECT "cust no", CASE nation {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _MIXED)}
      ELSE "cust.name" END AS label FROM ({CUSTOMERS}))"""


def _map(table, id_column, *rules):
    """Migration with the given rules only."""
    targets = [r["target_field"] for r in rules]
    one = task("MAP", None, [rule(id_column, "id", "copy"), *rules])
    layout = schema("MAP", "id", *targets)

    def run(spark, sf_dir):
        return migrate(table(spark, sf_dir), one, layout).drop(POS)

    return run


def map_concat_null(spark, sf_dir):
    """A missing part makes the whole text missing."""
    df = customers(spark, sf_dir).withColumn("segment", F.nullif(F.col("segment"), F.lit("BUILDING")))
    t = task("CONCAT", None, [rule("cust no", "id", "copy"), rule(["cust.name", "segment"], "label", "concatenate", separator=" ")])
    return migrate(df, t, schema("CONCAT", "id", "label")).drop(POS)


_WITHOUT_FURNITURE = {k: v for k, v in SECTORS.items() if k != "FURNITURE"}


def map_value_quarantine(spark, sf_dir):
    """Rows whose segment the dictionary lacks are set aside, not lost."""
    t = task("SEGMENTS", None, [rule("cust no", "id", "copy"), rule("segment", "sector", "value_mapping", mapping=_WITHOUT_FURNITURE)])
    result = migrate_with_quarantine(customers(spark, sf_dir), t, schema("SEG", "id", "sector"))
    good = result.table.select("id", "sector", F.lit(None).cast("string").alias("problem"))
    bad = result.quarantine.select(
        col("cust no").alias("id"),
        F.lit(None).cast("string").alias("sector"),
        F.array_join("_violations", "; ").alias("problem"),
    )
    return good.unionByName(bad)


MAP_VALUE_QUARANTINE = f"""
SELECT "cust no" AS id, {case_sql('segment', _WITHOUT_FURNITURE)} AS sector,
       CASE WHEN {case_sql('segment', _WITHOUT_FURNITURE)} IS NULL
            THEN 'no value_mapping entry for ''' || segment || ''' in field ''segment''' END AS problem
FROM ({CUSTOMERS})"""


def map_value_large(spark, sf_dir):
    """A dictionary above the inline limit becomes a hash join."""
    names = {f"{i // 10}.{i % 10}0": f"G{i % 7}" for i in range(8200, 10000)}
    t = task("PRICES", None, [rule("part no.", "id", "copy"), rule("price", "price group", "value_mapping", mapping=names)])
    return migrate(parts(spark, sf_dir), t, schema("PRICES", "id", "price group")).drop(POS)


MAP_VALUE_LARGE = f"""
SELECT "part no." AS id,
       'G' || CAST((CAST(round(CAST(price AS DOUBLE) * 10) AS BIGINT)) % 7 AS VARCHAR) AS "price group"
FROM ({PARTS})"""


def map_sequence(spark, sf_dir):
    t = task(
        "NUMBERS",
        {"field": "priority", "operator": "==", "value": "1-URGENT"},
        [
            rule("order no.", "id", "copy"),
            rule("order no.", "number", "sequential_number", start=70400000, digits=10),
            rule("order no.", "stepped", "sequential_number", start=7, increment=3),
        ],
    )
    return migrate(orders(spark, sf_dir), t, schema("NUMBERS", "number", "id", "stepped")).drop(POS)


MAP_SEQUENCE = f"""
SELECT "order no." AS id,
       format('{{:010d}}', 70400000 + row_number() OVER (ORDER BY pos) - 1) AS number,
       CAST(7 + 3 * (row_number() OVER (ORDER BY pos) - 1) AS VARCHAR) AS stepped
FROM ({ORDERS}) WHERE priority = '1-URGENT'"""


def row_index(spark, sf_dir):
    """Gap-free ranks of the filtered rows."""
    kept = apply_filtering(
        orders(spark, sf_dir), filtering({"field": "total", "operator": "<", "value": 250000})
    )
    return with_index(kept).select(col("order no."), F.col("_idx").alias("row_index"))


def _migrate(table, t, s, columns=None):
    def run(spark, sf_dir):
        return migrate(table(spark, sf_dir), t, s).drop(POS)

    return run


def _columns(names):
    return ", ".join(f'"{n}"' for n in names)


QUERIES = {
    "migrate_orders": (
        _migrate(orders, ORDER_TASK, ORDER_SCHEMA),
        f"SELECT {_columns(ORDER_COLUMNS)} FROM ({order_truth_sql(f'({ORDERS})')})",
    ),
    "migrate_customer": (
        _migrate(customers, CUSTOMER_TASK, CUSTOMER_SCHEMA),
        f"SELECT * EXCLUDE (pos) FROM ({customer_truth_sql(f'({CUSTOMERS})')})",
    ),
    "migrate_supplier": (
        _migrate(suppliers, SUPPLIER_TASK, SUPPLIER_SCHEMA),
        f"SELECT * EXCLUDE (pos) FROM ({supplier_truth_sql(f'({SUPPLIERS})')})",
    ),
    "migrate_part": (_migrate(parts, PART_TASK, PART_SCHEMA), part_truth_sql(f"({PARTS})")),
    "filter_numeric": (
        _filter(
            customers,
            {"field": "balance", "operator": ">=", "value": 0},
            {"field": "balance", "operator": "<", "value": 5000.5},
        ),
        f"""SELECT * EXCLUDE (pos) FROM ({CUSTOMERS})
            WHERE CAST(balance AS DOUBLE) >= 0 AND CAST(balance AS DOUBLE) < 5000.5""",
    ),
    "filter_numeric_whole": (
        _filter(
            orders,
            {"field": "order no.", "operator": ">", "value": 9},
            {"field": "cust no", "operator": "<=", "value": 100},
        ),
        f"""SELECT * EXCLUDE (pos) FROM ({ORDERS})
            WHERE CAST("order no." AS BIGINT) > 9 AND CAST("cust no" AS BIGINT) <= 100""",
    ),
    "filter_text_iso": (
        _filter(orders, {"field": "iso date", "operator": ">=", "value": "1997-01-01"}),
        f"""SELECT * EXCLUDE (pos) FROM ({ORDERS}) WHERE "iso date" >= '1997-01-01'""",
    ),
    "filter_formatted_date": (
        _filter(
            lineitems,
            {"field": "ship date", "operator": ">", "value": "1998-06-30", "field_format": "DD.MM.YYYY"},
            {"field": "return flag", "operator": "==", "value": "R"},
        ),
        f"""SELECT * FROM ({LINEITEMS})
            WHERE strptime("ship date", '%d.%m.%Y') > DATE '1998-06-30' AND "return flag" = 'R'""",
    ),
    "filter_ne_null": (
        filter_ne_null,
        f"""SELECT "order no.", nullif(priority, '5-LOW') AS priority FROM ({ORDERS})
            WHERE nullif(priority, '5-LOW') IS DISTINCT FROM '1-URGENT'""",
    ),
    "filter_none": (filter_none, f"SELECT * EXCLUDE (pos) FROM ({SUPPLIERS})"),
    "populated_flag": (populated_flag, POPULATED),
    "map_copy": (
        _map(customers, "cust no", rule("cust.name", "name", "copy"), rule("segment", "segment", "copy")),
        f"""SELECT "cust no" AS id, "cust.name" AS name, segment FROM ({CUSTOMERS})""",
    ),
    "map_concat": (
        _map(
            customers,
            "cust no",
            rule(["cust.name", "nation", "segment"], "label", "concatenate", separator=" - "),
            rule(["nation", "segment"], "code", "concatenate"),
        ),
        f"""SELECT "cust no" AS id, "cust.name" || ' - ' || nation || ' - ' || segment AS label,
                   nation || segment AS code FROM ({CUSTOMERS})""",
    ),
    "map_concat_null": (
        map_concat_null,
        f"""SELECT "cust no" AS id, "cust.name" || ' ' || nullif(segment, 'BUILDING') AS label
            FROM ({CUSTOMERS})""",
    ),
    "map_value": (
        _map(orders, "order no.", rule("priority", "urgency", "value_mapping", mapping=PRIORITIES)),
        f"""SELECT "order no." AS id, {case_sql('priority', PRIORITIES)} AS urgency FROM ({ORDERS})""",
    ),
    "map_value_large": (map_value_large, MAP_VALUE_LARGE),
    "map_value_quarantine": (map_value_quarantine, MAP_VALUE_QUARANTINE),
    "map_date": (
        _map(
            orders,
            "order no.",
            rule("iso date", "day", "date_format", input_format="YYYY-MM-DD", output_format="DD.MM.YYYY"),
            rule("order date", "packed", "date_format", input_format="DD.MM.YYYY", output_format="YYYYMMDD"),
        ),
        f"""SELECT "order no." AS id, strftime(strptime("iso date", '%Y-%m-%d'), '%d.%m.%Y') AS day,
                   strftime(strptime("order date", '%d.%m.%Y'), '%Y%m%d') AS packed FROM ({ORDERS})""",
    ),
    "map_date_yy": (
        _map(
            orders,
            "order no.",
            rule("short date", "day", "date_format", input_format="DD.MM.YY", output_format="DD.MM.YYYY"),
        ),
        f"""SELECT "order no." AS id, strftime(strptime("short date", '%d.%m.%y'), '%d.%m.%Y') AS day
            FROM ({ORDERS})""",
    ),
    "map_sequence": (map_sequence, MAP_SEQUENCE),
    "row_index": (
        row_index,
        f"""SELECT "order no.", row_number() OVER (ORDER BY pos) - 1 AS row_index
            FROM ({ORDERS}) WHERE CAST(total AS DOUBLE) < 250000""",
    ),
}
