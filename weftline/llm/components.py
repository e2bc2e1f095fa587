"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.shared import drop_between, mark, written

MAX_ROUNDS = 60


def _mins(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with m, the least of u and its neighbours: a combined aggregate joined back,
    so that a hub's edges meet in no single task (adaptive execution splits the join)."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
    return pairs.join(least, F.col("u") == F.col("k")).select("u", "v", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _mins(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    m = _mins(down)
    return m.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(m.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v longs) but the roots; root is its component's least node.

    Every round is written to the shared folder: its cost is a few passes over one
    row per node, and the rounds grow with the logarithm of the nodes.
    """
    now = written(spark, edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(now)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        last = mark()
        now = written(spark, _small_star(_large_star(now)), "edges")
        drop_between(spark, last - 1, last)  # the round before
        after = _state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
