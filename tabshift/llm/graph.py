"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabshift.llm.common import written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours go to the least of a node and its neighbours. Small
    star: a node and its smaller neighbours go to the least of them. A node of any degree
    is one row of an aggregate and one side of a join that can be split."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    near = both.join(least, "a")
    if large:
        return near.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(near.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node with an edge; the label is the component's least node.
    `edges`: a, b; loops and repeated edges do no harm. Rounds grow with the logarithm of
    the longest path; each is written, so lost executors cost one round at most."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while (state := _state(now)) != before:
        before = state
        large = _stars(now, True).filter("a <> b").distinct()
        now = written(_stars(large, False).filter("a <> b").distinct())
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))
