import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabshift.functions.names import POS  # noqa: E402
from tabshift.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    """All-text table with positions from column names and rows."""

    def build(columns, rows):
        quoted = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
        placed = [tuple(r) + (i,) for i, r in enumerate(rows)]
        return spark.createDataFrame(placed, f"{quoted}, {POS} bigint")

    return build


@pytest.fixture(scope="session")
def rows():
    """Rows in table order, without the position."""

    def read(df):
        ordered = df.orderBy(POS).drop(POS) if POS in df.columns else df
        return [tuple(r) for r in ordered.collect()]

    return read
