"""Connected components of an edge table, by alternating large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifethread.runtime import forget, materialize


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root) of every node of (a, b), ``root`` the smallest node of its component. Ends when a step changes nothing."""
    now = materialize(_down(edges), tag)
    seen = None
    while True:
        now = _stepped(now, now.union(now.select("b", "a")), True, tag)
        now = _stepped(now, now, False, tag)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = state


def _stepped(before: DataFrame, edges: DataFrame, larger: bool, tag: str) -> DataFrame:
    step, least = _star(edges, larger)
    after = materialize(step, tag)
    forget(before)
    forget(least)
    return after


def _down(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, larger: bool) -> tuple[DataFrame, DataFrame]:
    """Link the neighbours of every node ``a`` (the larger ones, or all and itself) to the smallest of them and itself; also the table of the smallest."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("at"), F.least("at", "m").alias("m"))
    least = materialize(least, "components-least")  # a plain table, so that Spark can split the rows of a hub
    both = edges.join(least, F.col("a") == F.col("at"))
    if larger:
        return _down(both.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))), least
    return _down(both.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("at").alias("a"), F.col("m").alias("b")))), least
