"""Specs used by the queries, and the same rules as SQL."""

from __future__ import annotations

from tabshift.functions.draws import SLOTS, chance_threshold
from tabshift.specs import (
    FilteringRules,
    NoiseConfiguration,
    Schema,
    SynthesisConfiguration,
    Task,
    parse,
)


def task(task_id: str, filtering: dict | None, mappings: list[dict]) -> Task:
    return parse(
        Task,
        {
            "task_id": task_id,
            "objective": "migrate",
            "input": {
                "source_dataset": "data/dataset.csv",
                "source_schema": "schemas/source_schema.yaml",
                "target_schema": "schemas/target_schema.yaml",
            },
            "business_rules": {"filtering": filtering, "mappings": mappings},
            "output": {"format": "csv", "schema_reference": "schemas/target_schema.yaml"},
            "constraints": [],
        },
    )


def schema(table: str, *names: str, required: tuple = (), unique: tuple = ()) -> Schema:
    return parse(
        Schema,
        {
            "table": table,
            "description": table,
            "attributes": [
                {"name": n, "type": "string", "required": n in required, "unique": n in unique}
                for n in names
            ],
        },
    )


def filtering(*rules: dict) -> FilteringRules:
    return parse(FilteringRules, {"rules": list(rules)})


def rule(source: str | list[str], target: str, kind: str, **params) -> dict:
    where = "source_fields" if isinstance(source, list) else "source_field"
    return {where: source, "target_field": target, "transformation": {"type": kind, **params}}


SECTORS = {
    "AUTOMOBILE": "A1",
    "BUILDING": "B1",
    "FURNITURE": "F1",
    "HOUSEHOLD": "H1",
    "MACHINERY": "M1",
}
PRIORITIES = {
    "1-URGENT": "high",
    "2-HIGH": "high",
    "3-MEDIUM": "normal",
    "4-NOT SPECIFIED": "normal",
    "5-LOW": "low",
}
SIZES = {
    "ECONOMY": "S",
    "LARGE": "L",
    "MEDIUM": "M",
    "PROMO": "P",
    "SMALL": "S",
    "STANDARD": "M",
}
NATIONS = {f"N{i}": f"C{i:02d}" for i in range(25)}


def case_sql(column: str, mapping: dict[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


CUSTOMER_TASK = task(
    "CUSTOMERS",
    {"field": "balance", "operator": ">=", "value": 0},
    [
        rule("cust no", "CustomerID", "copy"),
        rule(["cust.name", "nation"], "Label", "concatenate", separator=" / "),
        rule("segment", "Sector", "value_mapping", mapping=SECTORS),
        rule("nation", "Nation", "copy"),
        rule("balance", "Balance", "copy"),
    ],
)
CUSTOMER_SCHEMA = schema(
    "CUST", "CustomerID", "Label", "Sector", "Nation", "Email", "Balance",
    required=("CustomerID", "Label", "Sector"), unique=("CustomerID",),
)


def customer_truth_sql(source: str) -> str:
    return f"""
SELECT "cust no" AS "CustomerID", "cust.name" || ' / ' || nation AS "Label",
       {case_sql('segment', SECTORS)} AS "Sector", nation AS "Nation", balance AS "Balance", pos
FROM {source} WHERE CAST(balance AS DOUBLE) >= 0"""


CUSTOMER_COLUMNS = ["CustomerID", "Label", "Sector", "Nation", "Balance"]

ORDER_TASK = task(
    "ORDERS",
    {"field": "order date", "operator": ">=", "value": "1997-01-01", "field_format": "DD.MM.YYYY"},
    [
        rule("order no.", "doc_no", "sequential_number", start=70400000, increment=1, digits=10),
        rule("order no.", "old_no", "copy"),
        rule(["cust no", "status"], "partner", "concatenate", separator="-"),
        rule("priority", "urgency", "value_mapping", mapping=PRIORITIES),
        rule("short date", "doc_date", "date_format", input_format="DD.MM.YY", output_format="DDMMYYYY"),
        rule("total", "amount", "copy"),
    ],
)
ORDER_SCHEMA = schema(
    "DOC", "doc_no", "old_no", "partner", "urgency", "doc_date", "amount", "note",
    required=("doc_no", "urgency"), unique=("doc_no",),
)
ORDER_COLUMNS = ["doc_no", "old_no", "partner", "urgency", "doc_date", "amount"]


def order_truth_sql(source: str) -> str:
    return f"""
SELECT format('{{:010d}}', 70400000 + row_number() OVER (ORDER BY pos) - 1) AS doc_no,
       "order no." AS old_no, "cust no" || '-' || status AS partner,
       {case_sql('priority', PRIORITIES)} AS urgency,
       strftime(strptime("short date", '%d.%m.%y'), '%d%m%Y') AS doc_date, total AS amount, pos
FROM {source} WHERE strptime("order date", '%d.%m.%Y') >= DATE '1997-01-01'"""


SUPPLIER_TASK = task(
    "SUPPLIERS",
    {"rules": [{"field": "balance", "operator": ">", "value": 0.5}, {"field": "country code", "operator": "!=", "value": "N7"}]},
    [
        rule("supplier no", "partner_no", "sequential_number", start=70400000, digits=10),
        rule("name 1", "name", "copy"),
        rule("country code", "country", "value_mapping", mapping=NATIONS),
        rule("supplier no", "remark", "copy"),
    ],
)
SUPPLIER_SCHEMA = schema(
    "BP", "partner_no", "name", "country", "city", "remark",
    required=("partner_no", "name", "country"), unique=("partner_no",),
)


def supplier_truth_sql(source: str) -> str:
    return f"""
SELECT format('{{:010d}}', 70400000 + row_number() OVER (ORDER BY pos) - 1) AS partner_no,
       "name 1" AS name, {case_sql('"country code"', NATIONS)} AS country,
       "supplier no" AS remark, pos
FROM {source} WHERE CAST(balance AS DOUBLE) > 0.5 AND "country code" IS DISTINCT FROM 'N7'"""


PART_TASK = task(
    "PARTS",
    {"field": "size class", "operator": "<=", "value": 25},
    [
        rule("part no.", "item code", "sequential_number", start=51704000000, increment=10, digits=11),
        rule(["part no.", "name"], "description", "concatenate", separator=" "),
        rule("item type", "material type", "value_mapping", mapping=SIZES),
        rule("brand", "maker", "copy"),
    ],
)
PART_SCHEMA = schema(
    "MAT", "item code", "description", "material type", "maker",
    required=("item code", "description"), unique=("item code",),
)


def part_truth_sql(source: str) -> str:
    return f"""
SELECT format('{{:011d}}', 51704000000 + 10 * (row_number() OVER (ORDER BY pos) - 1)) AS "item code",
       "part no." || ' ' || name AS description, {case_sql('"item type"', SIZES)} AS "material type",
       brand AS maker
FROM {source} WHERE CAST("size class" AS BIGINT) <= 25"""


def noise(seed: int, excluded: list[str], *steps: tuple[str, float]) -> NoiseConfiguration:
    return parse(
        NoiseConfiguration,
        {
            "seed": seed,
            "excluded_columns": excluded,
            "noise_types": [{"type": t, "probability": p} for t, p in steps],
        },
    )


CUSTOMER_NOISE = noise(
    42, ["cust no", "segment", "balance"], ("typo", 0.06), ("duplicate", 0.08), ("missing_value", 0.02)
)
ORDER_NOISE = noise(
    7,
    ["order no.", "iso date", "order date", "short date", "priority"],
    ("typo", 0.05), ("missing_value", 0.02), ("duplicate", 0.05),
)


def _ident(name: str) -> str:
    return '"' + name + '"'


def _hit(text: str, slot: int, probability: float) -> str:
    threshold = chance_threshold(probability)
    if threshold is None:
        return "TRUE"
    return f"substr(md5({text}), {1 + 8 * slot}, 8) < '{threshold}'"


def noise_sql(source: str, columns: list[str], config: NoiseConfiguration, rid: str = "CAST(pos AS VARCHAR)", has_pos: bool = True) -> str:
    """Nested SELECT with the noise steps; keeps `pos` when there is one."""
    changing = [c for c in columns if c not in config.excluded_columns]
    pos = ", pos" if has_pos else ""
    plain = ", ".join(_ident(c) for c in columns)
    sql = f"SELECT {plain}{pos}, {rid} AS rid FROM {source}"
    for number, step in enumerate(config.noise_types):
        if step.type == "duplicate":
            hit = _hit(f"'{config.seed}|{number}|0|' || rid", 0, step.probability)
            first = ", pos * 2 AS pos" if has_pos else ""
            second = ", pos * 2 + 1 AS pos" if has_pos else ""
            sql = (
                f"SELECT {plain}{first}, rid || '.0' AS rid FROM ({sql}) "
                f"UNION ALL SELECT {plain}{second}, rid || '.1' AS rid FROM ({sql}) WHERE {hit}"
            )
            continue
        cells = []
        for c in columns:
            name = _ident(c)
            if c not in changing:
                cells.append(name)
                continue
            j = changing.index(c)
            hit = _hit(f"'{config.seed}|{number}|{j // SLOTS}|' || rid", j % SLOTS, step.probability)
            if step.type == "missing_value":
                changed = "NULL"
            else:
                at = (
                    f"(CAST('0x' || substr(md5('{config.seed}|{number}p|{j // SLOTS}|' || rid), {1 + 8 * (j % SLOTS)}, 8) AS BIGINT)"
                    f" % (length({name}) - 1))"
                )
                changed = (
                    f"CASE WHEN length({name}) >= 2 THEN substr({name}, 1, {at}) || substr({name}, {at} + 2, 1)"
                    f" || substr({name}, {at} + 1, 1) || substr({name}, {at} + 3) ELSE {name} END"
                )
            cells.append(f"CASE WHEN {hit} THEN {changed} ELSE {name} END AS {name}")
        sql = f"SELECT {', '.join(cells)}{pos}, rid FROM ({sql})"
    return f"SELECT {plain}{pos} FROM ({sql})"


def synthesis(seed: int, **columns: dict) -> SynthesisConfiguration:
    return parse(
        SynthesisConfiguration,
        {"seed": seed, "columns": [{"column": c, **v} for c, v in columns.items()]},
    )


def u_sql(seed: int, column: str) -> str:
    text = f"'{seed}|{column}|0|' || CAST(pos AS VARCHAR)"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def pick_sql(seed: int, column: str, k: int, n: int) -> str:
    text = f"'{seed}|{column}|{k // SLOTS}|' || CAST(pos AS VARCHAR)"
    return f"(CAST('0x' || substr(md5({text}), {1 + 8 * (k % SLOTS)}, 8) AS BIGINT) % {n})"


def word_sql(seed: int, column: str, k: int, words: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"list_extract([{listed}], CAST(1 + {pick_sql(seed, column, k, len(words))} AS INTEGER))"


def grid_sql(seed: int, column: str, relation: str, value: str, places: int) -> str:
    """Uniform draw from the integer grid between min and max of `value`."""
    unit = 10**places
    low = f"(SELECT CAST(min({value}) * {unit} AS BIGINT) FROM {relation})"
    high = f"(SELECT CAST(max({value}) * {unit} AS BIGINT) FROM {relation})"
    n = f"({low} + CAST(floor({u_sql(seed, column)} * CAST({high} - {low} + 1 AS DOUBLE)) AS BIGINT))"
    if places == 0:
        return f"CAST({n} AS VARCHAR)"
    return (
        f"CASE WHEN {n} < 0 THEN '-' ELSE '' END || CAST(abs({n}) // {unit} AS VARCHAR) || '.' || "
        f"lpad(CAST(abs({n}) % {unit} AS VARCHAR), {places}, '0')"
    )
