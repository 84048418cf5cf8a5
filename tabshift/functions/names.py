"""Column naming: every data column is addressed through a quoted name, since
headers may contain dots and blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unique, increasing row position; the only order a table has on Spark.
POS = "_pos"
# 0-based gap-free rank of POS
IDX = "_idx"
# text identity of a row for seeded draws
ROW_ID = "_rid"

_INTERNAL = {POS, IDX, ROW_ID}


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def data_columns(df: DataFrame) -> list[str]:
    """Columns of the table itself, in order, without the bookkeeping ones."""
    return [name for name in df.columns if name not in _INTERNAL]


def has_position(df: DataFrame) -> bool:
    return POS in df.columns
