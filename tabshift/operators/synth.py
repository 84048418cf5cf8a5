"""Column synthesis: a publishable table from a private one.

Strategies are fitted together in one aggregation over the source (plus one
grouped count for the categorical columns); only ranges and short label lists
reach the driver. Drawing is a single projection; long label lists are a relation
that it is joined with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Context, Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabshift.functions.cells import is_number
from tabshift.functions.dates import parse_date, render_date
from tabshift.functions.draws import uniform, wide_uniform
from tabshift.functions.names import IDX, POS, col, data_columns, has_position
from tabshift.functions.words import PROVIDERS, Draws
from tabshift.operators.mappings import numbered
from tabshift.operators.order import first_seen, with_index
from tabshift.session import cut_lineage
from tabshift.specs import SpecError, SynthesisConfiguration, SynthesizedColumn

# labels of one CASE expression at most
CASE_LABELS = 64
# labels of a guide table that is sent to every task
SENT_LABELS = 100_000
DEFAULT_MAX_CARDINALITY = 20


class SynthesisError(ValueError):
    """The source data does not suit the configured strategy."""


@dataclass
class DrawContext:
    draws: Draws
    locale: str


class Strategy:
    """Base: nothing to fit."""

    needs_labels = False
    needs_index = False

    def fit(self, config: SynthesizedColumn) -> dict[str, Column]:
        return {}

    def draw(self, config: SynthesizedColumn, fitted: dict[str, Any], context: DrawContext) -> Column:
        raise NotImplementedError


def _param(config: SynthesizedColumn, name: str) -> Any:
    if name not in config.params:
        raise SpecError(f"column '{config.column}': {config.strategy} needs '{name}'")
    return config.params[name]


def _reject_bad(config: SynthesizedColumn, fitted: dict[str, Any], kind: str) -> None:
    if fitted["bad"]:
        raise SynthesisError(f"column '{config.column}': {fitted['bad']} values are no {kind}")
    if fitted["low"] is None:
        raise SynthesisError(f"column '{config.column}' has no values to fit")


class Faker(Strategy):
    def draw(self, config, fitted, context):
        provider = PROVIDERS.get(context.locale, {}).get(_param(config, "provider"))
        if provider is None:
            raise SpecError(
                f"column '{config.column}': no provider '{config.params['provider']}' "
                f"for locale '{context.locale}'"
            )
        return provider(context.draws)


#: Decimal places at which wide numbers are fitted; together they hold every number whose
#: digits before the point and places of the column are 38 at most, but for a few between.
WIDE_PLACES = (0, 8, 28)
#: Points of a grid that 52 random bits draw evenly.
NARROW_GRID = 1 << 52


class NumericDistribution(Strategy):
    """Uniform over the grid low .. high with the source's precision."""

    def fit(self, config):
        cell = col(config.column)
        text = F.when(is_number(cell), F.trim(cell))
        at = lambda places: text.try_cast(f"decimal(38,{places})")
        found = {
            "low": F.min(at(18)),
            "high": F.max(at(18)),
            "places": F.max(F.length(F.regexp_extract(cell, r"^-?\d+\.(\d+)$", 1))),
            "bad": F.count_if(cell.isNotNull() & text.isNull()),
            "wide": F.count_if(text.isNotNull() & at(18).isNull()),
        }
        for p in WIDE_PLACES:
            found |= {f"low{p}": F.min(at(p)), f"high{p}": F.max(at(p)), f"wide{p}": F.count_if(text.isNotNull() & at(p).isNull())}
        return found

    def draw(self, config, fitted, context):
        places = fitted["places"] or 0
        fits = ["", *map(str, WIDE_PLACES)]
        fit = next((f for f in fits if places <= int(f or 18) and not fitted[f"wide{f}"]), None)
        if fit is None and not fitted["bad"]:
            raise SynthesisError(f"column '{config.column}': its numbers need more than 38 digits")
        _reject_bad(config, fitted | {"low": fitted[f"low{fit or ''}"]}, "numbers")
        low, high = (int(Decimal(fitted[f"{k}{fit}"]).scaleb(places, _WIDE)) for k in ("low", "high"))
        hexes = context.draws.hexes()
        if high - low < NARROW_GRID and max(abs(low), abs(high)) < 1 << 62:
            return grid_text(uniform(hexes), low, high, places)
        return wide_text(hexes, low, high, places)


_WIDE = Context(prec=80)


def wide_text(hexes: Column, low: int, high: int, places: int) -> Column:
    """Like `grid_text`, over a grid beyond 52 bits."""
    if high - low + 1 > 10**38:
        raise SynthesisError("a grid of more than 10**38 numbers cannot be drawn from")
    n = F.lit(Decimal(low)).cast("decimal(38,0)") + wide_uniform(hexes, high - low + 1)
    digits = F.abs(n).cast("string")
    if places:
        padded = F.when(F.length(digits) > places, digits).otherwise(F.lpad(digits, places + 1, "0"))
        digits = F.concat(F.substring(padded, F.lit(1), F.length(padded) - places), F.lit("."), F.right(padded, F.lit(places)))
    return F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), digits)


def grid_text(u: Column, low: int, high: int, places: int) -> Column:
    """Decimal text of a uniformly drawn multiple of 10**-places."""
    n = F.lit(low).cast("bigint") + F.floor(u * F.lit(float(high - low + 1))).cast("bigint")
    if places == 0:
        return n.cast("string")
    unit = F.lit(10**places).cast("bigint")
    size = F.abs(n)
    rest = F.pmod(size, unit)
    return F.concat(
        F.when(n < 0, F.lit("-")).otherwise(F.lit("")),
        F.call_function("div", size, unit).cast("string"),
        F.lit("."),
        F.lpad(rest.cast("string"), places, "0"),
    )


class DateDistribution(Strategy):
    """Uniform over the days of the source's span."""

    def fit(self, config):
        cell = col(config.column)
        date = parse_date(cell, _param(config, "field_format"))
        return {
            "low": F.min(date),
            "high": F.max(date),
            "bad": F.count_if(cell.isNotNull() & date.isNull()),
        }

    def draw(self, config, fitted, context):
        _reject_bad(config, fitted, "dates")
        span = (fitted["high"] - fitted["low"]).days
        offset = F.floor(uniform(context.draws.hexes()) * F.lit(float(span))).cast("int")
        return render_date(F.date_add(F.lit(fitted["low"]), offset), config.params["field_format"])


_FIELD = re.compile(r"\{(?::(?:0(\d+))?d)?\}")


class UniqueSequence(Strategy):
    """`format` is literal text around one `{}` or `{:0Nd}` field."""

    needs_index = True

    def draw(self, config, fitted, context):
        template = str(_param(config, "format"))
        fields = _FIELD.findall(template)
        if len(fields) != 1 or "{" in _FIELD.sub("", template) or "}" in _FIELD.sub("", template):
            raise SpecError(f"column '{config.column}': format {template!r} is not supported")
        before, after = re.split(r"\{[^}]*\}", template)
        digits = int(fields[0]) if fields[0] else None
        number = numbered(F.col(IDX), config.params.get("start", 0), 1, digits)
        return F.concat(F.lit(before), number, F.lit(after))


class CategoricalResample(Strategy):
    """Labels drawn by their frequency; refused for identifying columns."""

    needs_labels = True

    def draw(self, config, fitted, context):
        labels = fitted["labels"]
        if not labels:
            raise SynthesisError(f"column '{config.column}' has no values to fit")
        total = sum(n for _, n in labels)
        u = uniform(context.draws.hexes())
        chosen, below = None, 0
        for label, n in labels[:-1]:
            below += n
            hit = u < F.lit(below / total)
            chosen = F.when(hit, F.lit(label)) if chosen is None else chosen.when(hit, F.lit(label))
        last = F.lit(labels[-1][0])
        return last if chosen is None else chosen.otherwise(last)


def is_large(config: SynthesizedColumn) -> bool:
    """Whether a column's labels are a joined relation instead of branches of one CASE; said
    by the spec, so that draws do not change with the data."""
    return config.params.get("max_cardinality", DEFAULT_MAX_CARDINALITY) > CASE_LABELS


def guide_table(df: DataFrame, config: SynthesizedColumn) -> tuple[DataFrame, int, int]:
    """(_slot, _low, _high, _label) of the labels in first-seen order, laid end to end by
    their counts and cut at as many even slots as there are labels; with the number of
    labels and the total. A draw falls into one slot and there into one of few labels: two
    rows a slot on average, whatever the frequencies."""
    labels = cut_lineage(first_seen(df, config.column))
    n, total = labels.agg(F.count("*"), F.sum("n")).first()
    if n > config.params["max_cardinality"]:
        raise SynthesisError(f"column '{config.column}' has more than max_cardinality={config.params['max_cardinality']} labels")
    if not n:
        raise SynthesisError(f"column '{config.column}' has no values to fit")
    # at most max_cardinality rows
    upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("first_pos").rowsBetween(Window.unboundedPreceding, 0))
    ranges = labels.select("label", (upto - F.col("n")).alias("_low"), upto.alias("_high"))
    slot = lambda c: F.call_function("div", c * n, F.lit(total))
    slots = F.explode(F.sequence(slot(F.col("_low")), slot(F.col("_high") - 1)))
    return cut_lineage(ranges.select(slots.alias("_slot"), "_low", "_high", F.col("label").alias("_label"))), n, total


def _joined_labels(source: DataFrame, df: DataFrame, name: str, config: SynthesizedColumn, seed: int) -> DataFrame:
    """`source` with `name` replaced by labels of the guide table."""
    table, n, total = guide_table(df, config)
    draws = Draws(seed, name, F.col(POS).cast("string"))
    drawn = F.least(F.floor(uniform(draws.hexes()) * F.lit(float(total))).cast("bigint"), F.lit(total - 1))
    rows = source.withColumn("_drawn", drawn).withColumn("_slot", F.call_function("div", F.col("_drawn") * n, F.lit(total)))
    table = F.broadcast(table) if n <= SENT_LABELS else table
    found = rows.join(table, "_slot").filter((F.col("_low") <= F.col("_drawn")) & (F.col("_drawn") < F.col("_high")))
    return found.select(*[F.col("_label").alias(c) if c == name else col(c) for c in source.columns])


class Identity(Strategy):
    """Explicit opt-out: values pass through."""

    def draw(self, config, fitted, context):
        return col(config.column)


STRATEGIES: dict[str, Strategy] = {
    "faker": Faker(),
    "numeric_distribution": NumericDistribution(),
    "date_distribution": DateDistribution(),
    "unique_sequence": UniqueSequence(),
    "categorical_resample": CategoricalResample(),
    "identity": Identity(),
}


def _label_counts(df: DataFrame, configs: list[SynthesizedColumn]) -> dict[str, list]:
    """Labels per categorical column in first-seen order. Fetches at most one
    label more than allowed in total; more than that means a refusal."""
    if not configs:
        return {}
    limits = {c.column: c.params.get("max_cardinality", DEFAULT_MAX_CARDINALITY) for c in configs}
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), col(c).alias("label")) for c in limits]
    )
    counts = (
        df.select(POS, F.inline(pairs))
        .filter(F.col("label").isNotNull())
        .groupBy("column", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.min(POS).alias("first_pos"))
    )
    rows = counts.limit(sum(limits.values()) + 1).collect()
    found: dict[str, list] = {c: [] for c in limits}
    for r in sorted(rows, key=lambda r: r["first_pos"]):
        found[r["column"]].append((r["label"], r["n"]))
    for column, labels in found.items():
        if len(labels) > limits[column]:
            raise SynthesisError(
                f"column '{column}' has more than max_cardinality={limits[column]} labels; "
                "resampling is only for short code lists"
            )
    return found


def synthesize(
    df: DataFrame,
    config: SynthesisConfiguration,
    strategies: dict[str, Strategy] | None = None,
) -> DataFrame:
    """Synthetic table with the columns, order and row count of `df` (SYN-7)."""
    strategies = strategies or STRATEGIES
    if not has_position(df):
        raise SpecError("synthesis needs a row position; see sources or with_position")
    configs = {c.column: c for c in config.columns}  # the last one wins
    chosen: dict[str, tuple[SynthesizedColumn, Strategy]] = {}
    for name in data_columns(df):
        if name not in configs:
            raise SpecError(f"no synthesis configured for source column '{name}'")
        strategy = strategies.get(configs[name].strategy)
        if strategy is None:
            raise SpecError(f"no synthesis strategy named '{configs[name].strategy}'")
        chosen[name] = (configs[name], strategy)

    fits = {
        (name, key): expr
        for name, (c, strategy) in chosen.items()
        for key, expr in strategy.fit(c).items()
    }
    fitted: dict[str, dict[str, Any]] = {name: {} for name in chosen}
    if fits:
        row = df.agg(*[e.alias(f"f{i}") for i, e in enumerate(fits.values())]).first()
        for (name, key), value in zip(fits, row):
            fitted[name][key] = value
    large = {n: c for n, (c, s) in chosen.items() if isinstance(s, CategoricalResample) and is_large(c)}
    labels = _label_counts(df, [c for n, (c, s) in chosen.items() if s.needs_labels and n not in large])
    for name, found in labels.items():
        fitted[name]["labels"] = found

    kept = [n for n, (_, s) in chosen.items() if isinstance(s, Identity)]
    source = df
    if any(s.needs_index for _, s in chosen.values()):
        # values that are about to be replaced are not shuffled
        passed_on = data_columns(df) if strategies is not STRATEGIES else kept
        source = with_index(df.select(*[col(c) for c in passed_on], POS))
    columns = []
    for name, (c, strategy) in chosen.items():
        draws = Draws(config.seed, name, F.col(POS).cast("string"))
        value = F.lit(None).cast("string") if name in large else strategy.draw(c, fitted[name], DrawContext(draws, config.locale))
        columns.append(value.alias(name))
    made = source.select(*columns, POS)
    for name, c in large.items():
        made = _joined_labels(made, df, name, c, config.seed)
    return made
