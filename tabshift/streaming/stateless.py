"""The stateless operators on streaming tables.

Filters, all mappings but sequential numbers, and all noise steps look at one
row at a time and therefore run unchanged on a stream. A stream has no row
position: draws are keyed on business columns instead. Scores, numbering and
comparisons need whole tables and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabshift.operators.mappings import Handler
from tabshift.operators.noise import apply_noise
from tabshift.plans.migrate import migrate
from tabshift.specs import NoiseConfiguration, Schema, SpecError, Task


def migrate_stream(
    stream: DataFrame, task: Task, schema: Schema, handlers: dict[str, Handler] | None = None
) -> DataFrame:
    numbered = [
        r.target_field
        for r in task.business_rules.mappings or []
        if r.transformation.type == "sequential_number"
    ]
    if numbered:
        raise SpecError(f"a stream cannot be numbered in order: {numbered}")
    return migrate(stream, task, schema, handlers)


def noise_stream(stream: DataFrame, config: NoiseConfiguration, row_key: list[str]) -> DataFrame:
    return apply_noise(stream, config, row_key=row_key)
