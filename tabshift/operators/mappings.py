"""Field transformations: registry name -> handler returning a Column.

A handler receives the rule and a `MappingContext` and returns a `Mapped`. Any
Column is allowed, including the result of a pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions.dates import parse_date, render_date
from tabshift.functions.names import IDX, col
from tabshift.specs import MappingRule, SpecError

# literal maps are searched linearly per row; larger ones become a hash join
INLINE_MAP_ENTRIES = 64


@dataclass
class Mapped:
    value: Column
    problem: Column | None = None


@dataclass
class MappingContext:
    """What handlers may ask for besides the row itself."""

    spark: SparkSession
    needs_index: bool = False
    lookups: list[tuple[str, DataFrame, Column]] = field(default_factory=list)

    def index(self) -> Column:
        """0-based rank of the row among the rows that passed the filter."""
        self.needs_index = True
        return F.col(IDX)

    def lookup(self, mapping: dict[str, str | None], key: Column) -> tuple[Column, Column]:
        """The entry of a key, and whether there is one: an entry may be missing text."""
        if not mapping:
            return F.lit(None).cast("string"), F.lit(False)
        if len(mapping) <= INLINE_MAP_ENTRIES:
            entries = [F.lit(x).cast("string") for pair in mapping.items() for x in pair]
            found = F.coalesce(key.isin(*mapping), F.lit(False))
            return F.try_element_at(F.create_map(*entries), key), found
        name = f"_lookup{len(self.lookups)}"
        table = self.spark.createDataFrame(
            [(k, (v,)) for k, v in mapping.items()], f"{name}_key string, {name} struct<value:string>"
        )
        self.lookups.append((name, table, key))
        return F.col(name)["value"], F.col(name).isNotNull()

    def attach(self, df: DataFrame) -> DataFrame:
        for name, table, key in self.lookups:
            # a dictionary written in a spec; the planner knows its size and sends it
            # whole or shuffles it accordingly
            df = df.join(table, key == F.col(f"{name}_key"), "left").drop(f"{name}_key")
        return df


Handler = Callable[[MappingRule, MappingContext], Mapped]


def _single(rule: MappingRule) -> Column:
    if rule.source_field is None:
        raise SpecError(
            f"'{rule.transformation.type}' to '{rule.target_field}' needs a source_field"
        )
    return col(rule.source_field)


def _param(rule: MappingRule, name: str):
    try:
        return rule.transformation.params[name]
    except KeyError:
        raise SpecError(
            f"'{rule.transformation.type}' to '{rule.target_field}' needs '{name}'"
        ) from None


def _shown(cell: Column) -> Column:
    return F.coalesce(F.concat(F.lit("'"), cell, F.lit("'")), F.lit("missing value"))


def copy(rule: MappingRule, context: MappingContext) -> Mapped:
    return Mapped(_single(rule))


def concatenate(rule: MappingRule, context: MappingContext) -> Mapped:
    """Missing if any part is missing."""
    separator = rule.transformation.params.get("separator", "")
    parts: list[Column] = []
    for name in rule.sources:
        if parts and separator:
            parts.append(F.lit(separator))
        parts.append(col(name))
    return Mapped(F.concat(*parts))


def value_mapping(rule: MappingRule, context: MappingContext) -> Mapped:
    mapping = _param(rule, "mapping")
    wrong = [k for k in mapping if not isinstance(k, str)]
    if wrong:
        raise SpecError(f"value_mapping to '{rule.target_field}': keys {wrong} are not text")
    cell = _single(rule)
    value, found = context.lookup({k: None if v is None else str(v) for k, v in mapping.items()}, cell)
    problem = F.when(
        ~found,
        F.concat(
            F.lit("no value_mapping entry for "), _shown(cell),
            F.lit(f" in field '{rule.source_field}'"),
        ),
    )
    return Mapped(value, problem)


def date_format(rule: MappingRule, context: MappingContext) -> Mapped:
    cell = _single(rule)
    date = parse_date(cell, _param(rule, "input_format"))
    problem = F.when(
        date.isNull(),
        F.concat(
            F.lit("no date "), F.lit(rule.transformation.params["input_format"]), F.lit(": "),
            _shown(cell), F.lit(f" in field '{rule.source_field}'"),
        ),
    )
    return Mapped(render_date(date, _param(rule, "output_format")), problem)


def numbered(index: Column, start: int, increment: int, digits: int | None) -> Column:
    """`start + index*increment` as text, zero-padded but never truncated."""
    number = F.lit(start).cast("bigint") + index * F.lit(increment).cast("bigint")
    if not digits:
        return number.cast("string")
    return F.format_string(f"%0{int(digits)}d", number)


def sequential_number(rule: MappingRule, context: MappingContext) -> Mapped:
    params = rule.transformation.params
    return Mapped(
        numbered(
            context.index(), _param(rule, "start"), params.get("increment", 1), params.get("digits")
        )
    )


HANDLERS: dict[str, Handler] = {
    "copy": copy,
    "concatenate": concatenate,
    "value_mapping": value_mapping,
    "date_format": date_format,
    "sequential_number": sequential_number,
}
