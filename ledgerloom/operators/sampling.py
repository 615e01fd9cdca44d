"""Samples of an exact size without replacement, uniform or weighted, that no partitioning changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smallest(rows: DataFrame, key: Column, tie: list[str], count: Column | int) -> DataFrame:
    """Exactly ``count`` rows (all, if fewer) with the smallest ``key``, a number from 0 to below 2 ** 32; ties by the columns ``tie``.

    No global sort: keys are counted by their upper 16 bits, buckets below the cut are taken whole, and only the bucket on
    the cut is ranked (a 65,536th of all rows, as keys are spread evenly).
    """
    keyed = rows.withColumn("__key", key.cast("bigint")).withColumn("__bucket", F.shiftright("__key", 16))
    held = keyed.groupBy("__bucket").agg(F.count("*").alias("__held"))  # 65,536 rows at most
    upto = F.sum("__held").over(Window.orderBy("__bucket"))
    whole = F.sum("__held").over(Window.partitionBy())
    size = F.lit(count) if isinstance(count, int) else count
    cuts = held.withColumns({"__upto": upto, "rows": whole}).select("__bucket", (F.col("__upto") - F.col("__held")).alias("__before"), "__upto", size.cast("bigint").alias("__count"))
    near = cuts.where("__before < __count")
    met = keyed.join(F.broadcast(near), "__bucket")
    inside = met.where("__upto <= __count")
    nth = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key", *tie))
    edge = met.where("__upto > __count").withColumn("__nth", nth).where("__nth <= __count - __before").drop("__nth")
    return inside.unionByName(edge).select(rows.columns)


def hash32(seed: int, salt: str, key: Column) -> Column:
    """32 bits of md5 of seed, salt and key: the same in any engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def exact_sample(rows: DataFrame, key: str, rate: float, seed: int = 42) -> DataFrame:
    """floor(rows * rate) rows without replacement, those with the smallest hashes of ``key``; ties by the key."""
    return smallest(rows, hash32(seed, "sample", F.col(key)), [key], F.floor(F.col("rows") * F.lit(rate)))


def weighted_sample(rows: DataFrame, key: str, weight: str, count: int, seed: int = 42) -> DataFrame:
    """``count`` rows (all with a weight, if fewer) drawn one after another without replacement, each time in proportion to ``weight``.

    Exponential keys: the rows with the smallest -ln(u) / weight are such a draw. Keys are counted by a monotone map of
    theirs that spreads them (one job finds their mean), and compared exactly on the cut. Rows whose weight is null,
    NaN, infinite, zero or negative are never drawn.
    """
    w = F.col(weight).cast("double")
    some = rows.where(F.coalesce((w > 0) & (w < float("inf")), F.lit(False)))
    u = (hash32(seed, "draw", F.col(key)) + 0.5) / float(1 << 32)
    drawn = some.withColumn("__draw", -F.log(u) / w)
    mean = drawn.agg(F.avg("__draw")).first()[0] or 1.0
    spread = F.col("__draw") / (F.col("__draw") + F.lit(mean)) * float((1 << 32) - 1)
    return smallest(drawn, spread, ["__draw", key], count).select(rows.columns)
