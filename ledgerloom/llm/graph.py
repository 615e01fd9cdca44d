"""Connected components of a distributed edge list, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex that has an edge; root is the smallest vertex reachable, itself included.

    Each round points every vertex at the smallest neighbour it has, which shortens all paths; rounds
    end when the edges no longer change. Minima are pre-aggregated and joined back, so a vertex with very
    many neighbours never sits in one group. An edge list without rows gives no rows.
    """
    e = materialize(_proper(edges.select("u", "v")), "edges")
    mark = _mark(e)
    while mark[0]:
        e = materialize(_small_star(_large_star(e)), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("u").alias("v"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v"), F.col("v").alias("root")).distinct())


def _proper(e: DataFrame) -> DataFrame:
    return e.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _proper(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    joined = e.join(least, "u")
    return _proper(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))
