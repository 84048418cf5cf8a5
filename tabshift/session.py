"""Session settings the library relies on, and fault-tolerant lineage cuts."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings only, so a session handed in by a cluster can be used as is.
SESSION_SETTINGS = {
    # `Part No` and `part no` are two columns
    "spark.sql.caseSensitive": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # lookups join a large side to a side with one row per key; a hot key on the
    # large side is then split over many tasks, also below an aggregation
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the library's runtime settings to an existing session."""
    for key, value in SESSION_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@functools.cache
def _local_base() -> str:
    base = tempfile.mkdtemp(prefix="tabshift-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base


def shared_base(spark: SparkSession) -> str:
    """The folder which the driver and all executors share: `spark.checkpoint.dir`, else the
    context's checkpoint folder. Only a local master, where there is one machine, may go
    without; a cluster without such a folder is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_base()
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark)}/tabshift/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there: later steps neither
    recompute it nor depend on the executors which produced it, and the planner
    knows its true size."""
    spark = df.sparkSession
    path = shared_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
