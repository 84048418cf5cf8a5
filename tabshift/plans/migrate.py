"""Migration of a table into a target schema: filter, map, project."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.functions.names import POS, col, has_position
from tabshift.functions.cells import all_of
from tabshift.operators.filters import apply_filtering, filter_problems, predicates
from tabshift.operators.mappings import HANDLERS, Handler, Mapped, MappingContext
from tabshift.operators.order import with_index
from tabshift.specs import Schema, SpecError, Task


@dataclass
class Migration:
    """Rows that could be migrated, and the source rows that could not with the
    texts of what is wrong with them."""

    table: DataFrame
    quarantine: DataFrame


def _mapped_columns(
    task: Task, schema: Schema, handlers: dict[str, Handler], context: MappingContext
) -> dict[str, Mapped]:
    # the last rule for a target wins
    rules = {rule.target_field: rule for rule in task.business_rules.mappings or []}
    unknown = [target for target in rules if target not in schema.names]
    if unknown:
        raise SpecError(f"mapping to {unknown[0]!r}, which is not in schema '{schema.table}'")
    mapped: dict[str, Mapped] = {}
    for attribute in schema.attributes:
        rule = rules.get(attribute.name)
        if rule is None:
            if attribute.required:
                raise SpecError(f"no mapping for required target field '{attribute.name}'")
            continue
        handler = handlers.get(rule.transformation.type)
        if handler is None:
            raise SpecError(f"no transformation named '{rule.transformation.type}'")
        mapped[attribute.name] = handler(rule, context)
    return mapped


def _project(df: DataFrame, mapped: dict[str, Mapped]) -> DataFrame:
    columns = [m.value.alias(name) for name, m in mapped.items()]
    if has_position(df):
        columns.append(F.col(POS))
    return df.select(*columns)


def migrate(
    df: DataFrame, task: Task, schema: Schema, handlers: dict[str, Handler] | None = None
) -> DataFrame:
    """Expected table of a task (MAP-7); reading it fails on the first cell that
    a rule cannot handle, whichever columns are read: the check is a filter, which
    no reader can prune, even one that only counts. One filter and one projection; only
    sequential numbers add a shuffle. Columns nobody maps never leave the scan."""
    context = MappingContext(df.sparkSession)
    mapped = _mapped_columns(task, schema, handlers or HANDLERS, context)
    kept = context.attach(apply_filtering(df, task.business_rules.filtering))
    problems = [m.problem for m in mapped.values() if m.problem is not None]
    if problems:
        first = F.coalesce(*problems)
        kept = kept.filter(F.when(first.isNotNull(), F.raise_error(first).cast("boolean")).otherwise(True))
    if context.needs_index:
        kept = with_index(_needed(kept, task, context))
    return _project(kept, mapped)


def _needed(df: DataFrame, task: Task, context: MappingContext) -> DataFrame:
    """Only what the mappings read, so the numbering does not shuffle the rest."""
    if not has_position(df):
        raise SpecError("sequential numbers need a row position; see sources or with_position")
    sources = {s for rule in task.business_rules.mappings or [] for s in rule.sources}
    wanted = [c for c in df.columns if c in sources or c == POS]
    return df.select(*[col(c) for c in wanted], *[F.col(n) for n, _, _ in context.lookups])


def migrate_with_quarantine(
    df: DataFrame, task: Task, schema: Schema, handlers: dict[str, Handler] | None = None
) -> Migration:
    """As `migrate`, but rows with unreadable cells are set aside whole. Every row is
    marked in one pass: what is wrong with it and whether the rules keep it."""
    context = MappingContext(df.sparkSession)
    mapped = _mapped_columns(task, schema, handlers or HANDLERS, context)
    rules = task.business_rules.filtering

    def texts(problems):
        if not problems:
            return F.array().cast("array<string>")
        return F.filter(F.array(*problems), lambda p: p.isNotNull())

    unreadable = texts(filter_problems(rules))
    map_problems = texts([m.problem for m in mapped.values() if m.problem is not None])
    keep = F.coalesce(all_of([p.keep for p in predicates(rules)]), F.lit(False))
    readable = F.size(unreadable) == 0
    # a row that no rule keeps is not mapped, so its cells cannot be wrong
    found = F.when(~readable, unreadable).when(keep, map_problems).otherwise(texts([]))
    marked = context.attach(df).select("*", found.alias("_violations"), (readable & keep).alias("_keep"))
    quarantine = marked.filter(F.size("_violations") > 0).select(*[col(c) for c in df.columns], "_violations")
    good = marked.filter((F.size("_violations") == 0) & F.col("_keep"))
    if context.needs_index:
        good = with_index(_needed(good, task, context))
    return Migration(_project(good, mapped), quarantine)
