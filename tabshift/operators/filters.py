"""Filter rules as Column predicates."""

from __future__ import annotations

import datetime as dt
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabshift.functions.cells import all_of, any_of, is_number, is_whole, to_double, to_whole
from tabshift.functions.dates import parse_date
from tabshift.functions.names import col
from tabshift.specs import FilteringRules, FilterRule, SpecError


def _not_equal(column: Column, value: Column) -> Column:
    """Missing differs from every value."""
    return ~column.eqNullSafe(value)


OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    ">=": operator.ge,
    "<=": operator.le,
    ">": operator.gt,
    "<": operator.lt,
    "==": operator.eq,
    "!=": _not_equal,
}


@dataclass
class Predicate:
    """`keep` decides the row; `problem` is the text of a cell the rule cannot
    read, null when it can. Rules over plain text have no problem and are
    pushed into the scan."""

    keep: Column
    problem: Column | None = None


def _is_numeric(value: Any) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _unreadable(cell: Column, field: str, kind: str) -> Column:
    return F.concat(
        F.lit(f"{field}: "), F.coalesce(F.concat(F.lit("'"), cell, F.lit("'")), F.lit("missing value")),
        F.lit(f" is not {kind}"),
    )


def _iso_date(rule: FilterRule) -> dt.date:
    """YYYY-MM-DD alone: neither compact nor week dates."""
    if isinstance(rule.value, dt.date) and not isinstance(rule.value, dt.datetime):
        return rule.value
    text = str(rule.value)
    try:
        if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
            raise ValueError
        return dt.date.fromisoformat(text)
    except ValueError:
        raise SpecError(f"{rule.field}: {text!r} is no date YYYY-MM-DD") from None


def predicate(rule: FilterRule) -> Predicate:
    compare = OPERATORS.get(rule.operator)
    if compare is None:
        raise SpecError(f"unknown filter operator {rule.operator!r}")
    cell = col(rule.field).cast("string")

    if rule.field_format is not None:
        date = parse_date(cell, rule.field_format)
        bound = F.lit(_iso_date(rule))
        # a missing date cannot be parsed either
        problem = F.when(date.isNull(), _unreadable(cell, rule.field, f"a date {rule.field_format}"))
        return Predicate(compare(date, bound), problem)

    if _is_numeric(rule.value):
        number = to_double(cell)
        bad = cell.isNotNull() & ~is_number(cell)
        problem = F.when(bad, _unreadable(cell, rule.field, "a number"))
        if isinstance(rule.value, int):
            # whole numbers must not be compared as doubles, whatever their width; those
            # that no decimal holds are refused rather than rounded
            if abs(rule.value) >= 10**38:
                raise SpecError(f"{rule.field}: {rule.value} has more than 38 digits")
            whole = to_whole(cell)
            wide = is_whole(cell) & whole.isNull()
            problem = F.coalesce(problem, F.when(wide, _unreadable(cell, rule.field, "a number of at most 38 digits")))
            keep = F.when(is_whole(cell), compare(whole, F.lit(str(rule.value)).cast("decimal(38,0)")))
            return Predicate(keep.otherwise(compare(number, F.lit(float(rule.value)))), problem)
        return Predicate(compare(number, F.lit(float(rule.value))), problem)

    if isinstance(rule.value, str):
        return Predicate(compare(col(rule.field), F.lit(rule.value)))
    # any other kind of value, such as a flag, equals no text
    never = F.lit(rule.operator == "!=")
    return Predicate(never)


def predicates(filtering: FilteringRules | None) -> list[Predicate]:
    return [] if filtering is None else [predicate(rule) for rule in filtering.rules]


def filter_problems(filtering: FilteringRules | None) -> list[Column]:
    return [p.problem for p in predicates(filtering) if p.problem is not None]


def apply_filtering(
    df: DataFrame, filtering: FilteringRules | None, on_error: str = "fail"
) -> DataFrame:
    """Rows on which all rules hold (FLT-5); the input itself without rules.

    `on_error="fail"` stops on a cell a rule cannot read, on any row and for any
    rule. `"skip"` treats such rows as not matching; callers that keep them
    elsewhere use it.
    """
    if filtering is None:
        return df
    rules = predicates(filtering)
    keep = all_of([p.keep for p in rules])
    problems = [p.problem for p in rules if p.problem is not None]
    if not problems:
        return df.filter(keep)
    if on_error == "skip":
        return df.filter(~any_of([p.isNotNull() for p in problems]) & keep)
    first = F.coalesce(*problems)
    # one CASE, so that no rule is skipped because another one is false
    return df.filter(
        F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(keep)
    )
