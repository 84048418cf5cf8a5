"""The driver tables as all-text migration sources, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabshift.functions.names import POS
from tabshift.session import configure

Query = tuple  # (callable, sql or None)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def money(name: str):
    """Two-decimal text; doubles render differently from engine to engine."""
    return F.col(name).cast("decimal(12,2)").cast("string")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("cust no"),
        F.col("c_name").alias("cust.name"),
        F.col("c_nationkey").cast("string").alias("nation"),
        money("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_custkey").alias(POS),
    )


CUSTOMERS = """
SELECT CAST(c_custkey AS VARCHAR) AS "cust no", c_name AS "cust.name",
       CAST(c_nationkey AS VARCHAR) AS nation,
       CAST(CAST(c_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance,
       c_mktsegment AS segment, c_custkey AS pos
FROM customer"""


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").cast("string").alias("supplier no"),
        F.col("s_name").alias("name 1"),
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("country code"),
        money("s_acctbal").alias("balance"),
        F.col("s_suppkey").alias(POS),
    )


SUPPLIERS = """
SELECT CAST(s_suppkey AS VARCHAR) AS "supplier no", s_name AS "name 1",
       'N' || CAST(s_nationkey AS VARCHAR) AS "country code",
       CAST(CAST(s_acctbal AS DECIMAL(12,2)) AS VARCHAR) AS balance, s_suppkey AS pos
FROM supplier"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("part no."),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("item type"),
        F.col("p_size").cast("string").alias("size class"),
        money("p_retailprice").alias("price"),
        F.col("p_partkey").alias(POS),
    )


PARTS = """
SELECT CAST(p_partkey AS VARCHAR) AS "part no.", p_name AS name, p_brand AS brand,
       p_type AS "item type", CAST(p_size AS VARCHAR) AS "size class",
       CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS price, p_partkey AS pos
FROM part"""


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("order no."),
        F.col("o_custkey").cast("string").alias("cust no"),
        F.col("o_orderstatus").alias("status"),
        money("o_totalprice").alias("total"),
        F.date_format(date, "yyyy-MM-dd").alias("iso date"),
        F.date_format(date, "dd.MM.yyyy").alias("order date"),
        F.date_format(date, "dd.MM.yy").alias("short date"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_orderkey").alias(POS),
    )


ORDERS = """
SELECT CAST(o_orderkey AS VARCHAR) AS "order no.", CAST(o_custkey AS VARCHAR) AS "cust no",
       o_orderstatus AS status,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS total,
       strftime(o_orderdate, '%Y-%m-%d') AS "iso date",
       strftime(o_orderdate, '%d.%m.%Y') AS "order date",
       strftime(o_orderdate, '%d.%m.%y') AS "short date",
       o_orderpriority AS priority, o_orderkey AS pos
FROM orders"""

LINEITEM_KEY = ["order no.", "part no.", "supplier no", "line"]


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No unique key and hence no position: rows are identified by their keys."""
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("order no."),
        F.col("l_partkey").cast("string").alias("part no."),
        F.col("l_suppkey").cast("string").alias("supplier no"),
        F.col("l_linenumber").cast("string").alias("line"),
        money("l_extendedprice").alias("price"),
        F.col("l_returnflag").alias("return flag"),
        F.col("l_linestatus").alias("status"),
        F.date_format("l_shipdate", "dd.MM.yyyy").alias("ship date"),
    )


LINEITEMS = """
SELECT CAST(l_orderkey AS VARCHAR) AS "order no.", CAST(l_partkey AS VARCHAR) AS "part no.",
       CAST(l_suppkey AS VARCHAR) AS "supplier no", CAST(l_linenumber AS VARCHAR) AS line,
       CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS price,
       l_returnflag AS "return flag", l_linestatus AS status,
       strftime(l_shipdate, '%d.%m.%Y') AS "ship date"
FROM lineitem"""


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`events` as a log of scored runs: an agent per event type, failed runs
    without metrics, and metadata that mixes numbers, texts and flags."""
    value = F.col("value")
    ok = value >= 5
    score = lambda name, by: F.struct(
        F.lit(name).alias("name"), F.least(F.lit(1.0), value / F.lit(by)).alias("score")
    )
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias(POS),
        F.col("event_type").alias("agent_name"),
        F.when(ok, F.array(score("row_accuracy", 400.0), score("record_accuracy", 200.0)))
        .otherwise(F.array().cast("array<struct<name:string,score:double>>"))
        .alias("metrics"),
        (value > 100).alias("passed"),
        F.when(~ok, F.lit("timeout")).alias("error"),
        F.when(value >= 50, score("reproducibility", 300.0)).alias("reproducibility"),
        value.alias("duration_seconds"),
        F.concat(
            F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "model": "7", "retry": true}')
        ).alias("metadata"),
    )


RUNS = """
SELECT event_id, event_type AS agent_name, value > 100 AS passed, value >= 5 AS ok,
       value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k
FROM events"""
