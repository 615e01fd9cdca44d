"""Reports over request logs: totals and latency percentiles by name and overall, and a series over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p50": 0.5, "p66": 0.66, "p75": 0.75, "p80": 0.8, "p90": 0.9, "p95": 0.95, "p98": 0.98, "p99": 0.99, "p99_9": 0.999, "p99_99": 0.9999, "p100": 1.0}


def request_log_report(log: DataFrame) -> DataFrame:
    """``log``: name, latency, size, failed, at. One row by name and one of all (name null).

    Percentiles are exact, infinite and NaN latencies included, which order as in Spark (NaN last). Rows are first
    counted by name and latency; the wanted ranks are then found by radix selection, see ``exact_quantiles``.
    """
    seconds = (F.unix_micros(F.max("at").cast("timestamp")) - F.unix_micros(F.min("at").cast("timestamp"))) / 1e6
    base = log.rollup("name").agg(
        F.grouping("name").cast("int").alias("every"),
        F.count("*").alias("requests"),
        F.count_if("failed").alias("failures"),
        F.avg("latency").alias("mean"),
        F.min("latency").alias("min"),
        F.max("latency").alias("max"),
        F.avg("size").alias("mean_size"),
        F.round(F.when(seconds > 0, F.count("*") / seconds), 6).alias("rps"),
    )
    at = exact_quantiles(log, {"median": 0.5} | PERCENTILES)
    joined = base.join(at, (base["every"] == at["__every"]) & base["name"].eqNullSafe(at["__name"]), "left")
    return joined.select("name", "requests", "failures", "median", "mean", "min", "max", "mean_size", "rps", *PERCENTILES)


def ordered_bits(v: Column) -> Column:
    """A double as a long that orders as Spark orders doubles: both zeros are equal, NaN is the largest."""
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), v + F.lit(0.0)).cast("bigint")
    return F.when(v.isNotNull(), bits)


def exact_quantiles(log: DataFrame, shares: dict[str, float]) -> DataFrame:
    """__every, __name and a column for each share: the latencies' interpolated quantiles by name (every 0) and of all (every 1).

    Radix selection: counts by the upper 16 bits of the ordered latencies tell which bucket holds a wanted rank; only
    the latencies of such buckets are counted by the next 16 bits, four times in all. A window holds the
    buckets below one parent, 65,536 at most, however many latencies there are and however close they lie.
    """
    v = F.col("latency").cast("double")
    counts = log.where(v.isNotNull()).groupBy(F.lit(0).alias("every"), "name", (v + F.lit(0.0)).alias("v")).agg(F.count("*").alias("c"))
    counts = counts.unionByName(counts.groupBy("v").agg(F.sum("c").alias("c")).select(F.lit(1).alias("every"), F.lit(None).cast("string").alias("name"), "v", "c"))
    who = F.concat(F.col("every").cast("string"), F.coalesce(F.concat(F.lit("+"), "name"), F.lit("-")))
    bits = counts.select(who.alias("who"), "every", "name", "v", "c", ordered_bits(F.col("v")).alias("bits"))
    low = F.col("bits").bitwiseAND(F.lit((1 << 63) - 1))
    # the bits of negative numbers grow downwards
    keyed = bits.withColumn("key", F.when(F.col("bits") < 0, F.lit(-1) - low).otherwise(F.col("bits")))
    totals = keyed.groupBy("who").agg(F.first("every").alias("every"), F.first("name").alias("name"), F.sum("c").alias("n"))
    places = [(F.col("n") - 1) * F.lit(share) for share in shares.values()]
    ranks = F.array_distinct(F.array(*(f(p).cast("bigint") for p in places for f in (F.floor, F.ceil))))
    wanted = totals.select("who", F.explode(ranks).alias("rank")).withColumns({"inside": F.col("rank"), "parent": F.lit(0).cast("bigint")})
    for shift in (48, 32, 16, 0):
        parent = F.lit(0).cast("bigint") if shift == 48 else F.shiftright("key", shift + 16)
        held = keyed.select("who", parent.alias("parent"), F.shiftright("key", shift).alias("bucket"), "c")
        if shift < 48:
            held = held.join(wanted.select("who", "parent").distinct(), ["who", "parent"], "left_semi")
        by = held.groupBy("who", "parent", "bucket").agg(F.sum("c").alias("held"))
        begin = F.sum("held").over(Window.partitionBy("who", "parent").orderBy("bucket")) - F.col("held")
        met = wanted.join(by.withColumn("begin", begin), ["who", "parent"]).where((F.col("begin") <= F.col("inside")) & (F.col("inside") < F.col("begin") + F.col("held")))
        wanted = met.select("who", "rank", (F.col("inside") - F.col("begin")).alias("inside"), F.col("bucket").alias("parent"))
    at = wanted.select("who", "rank", F.col("parent").alias("key")).join(keyed.select("who", "key", "v"), ["who", "key"])
    found = totals.join(at.groupBy("who").agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at")), "who")

    def between(name: str, share: float):
        place = (F.col("n") - 1) * F.lit(share)
        low, high = (F.element_at("at", f(place).cast("bigint")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return found.select(F.col("every").alias("__every"), F.col("name").alias("__name"), *(between(*s) for s in shares.items()))


#: Quantiles of the history, in ten-thousandths.
HISTORY = {"p50": 5000, "p66": 6600, "p75": 7500, "p80": 8000, "p90": 9000, "p95": 9500, "p98": 9800, "p99": 9900, "p99_9": 9990, "p99_99": 9999, "p100": 10_000}


def three_digits(v: Column) -> Column:
    """The latency to three digits or two decimals: few values, in the same order, at most half a per cent off from 1 on."""
    size = F.abs(v)
    steps = [F.when(size < 10, F.round(v, 2)), (size < 100, F.round(v, 1)), (size < 1000, F.round(v, 0)), (size < 10_000, F.round(v, -1)), (size < 100_000, F.round(v, -2))]
    chain = steps[0]
    for test, value in steps[1:]:
        chain = chain.when(test, value)
    return chain.otherwise(F.round(v, -3))


def request_log_history(log: DataFrame, step: str = "10 seconds", panes: int = 1) -> DataFrame:
    """A row for each sliding window of ``panes`` steps that holds requests, by name (every 0) and of all (every 1, name null).

    Of the window: requests, failures, both a second, and quantiles of latencies to three digits (``three_digits``; the smallest
    that so many reach). Of all requests until the window's end: count, failures, mean, min, max and mean size.
    The log is aggregated once, to a histogram for each pane (a step) and name; windows are sums of panes, quantiles come from
    cumulative counts, running totals from prefix sums over panes. A null latency counts as a request without one.
    """
    seconds = F.expr(f"interval {step}")
    v = F.col("latency").cast("double")
    rows = log.select("name", v.alias("v"), three_digits(v).alias("bucket"), F.col("size").cast("double").alias("size"), F.col("failed"), F.window("at", step).start.alias("pane"))
    sums = {"requests": F.count("*"), "failures": F.count_if("failed"), "timed": F.count("v"), "total": F.sum("v"), "least": F.min("v"), "most": F.max("v"), "sized": F.count("size"), "sizes": F.sum("size")}
    again = {k: (F.min if k == "least" else F.max if k == "most" else F.sum)(k) for k in sums}
    hist = rows.groupBy("name", "pane", "bucket").agg(*(f.alias(k) for k, f in sums.items()))
    every = hist.groupBy("pane", "bucket").agg(*(f.alias(k) for k, f in again.items()))
    hist = hist.withColumn("every", F.lit(0)).unionByName(every.withColumns({"every": F.lit(1), "name": F.lit(None).cast("string")}))
    who = F.concat(F.col("every").cast("string"), F.coalesce(F.concat(F.lit("+"), "name"), F.lit("-")))
    hist = hist.withColumn("who", who)
    # each pane lies in ``panes`` windows
    windows = F.transform(F.sequence(F.lit(0), F.lit(panes - 1)), lambda k: F.col("pane") - seconds * k)
    wide = hist.select("who", "every", "name", F.explode(windows).alias("desde"), "bucket", "requests", "failures", "timed").groupBy("who", "every", "name", "desde", "bucket").agg(*(F.sum(c).alias(c) for c in ("requests", "failures", "timed")))
    window = Window.partitionBy("who", "desde")
    ranked = wide.withColumns({"upto": F.sum("timed").over(window.orderBy(F.asc_nulls_last("bucket"))), "of": F.sum("timed").over(window)})
    reach = lambda p: F.min(F.when((F.col("timed") > 0) & (F.col("upto") * 10_000 >= F.col("of") * p), F.col("bucket")))
    told = ranked.groupBy("who", "every", "name", "desde").agg(F.sum("requests").alias("requests"), F.sum("failures").alias("failures"), *(reach(p).alias(n) for n, p in HISTORY.items()))
    told = told.withColumn("hasta", F.col("desde") + seconds * panes)
    # panes that end by a window's end stand before it
    done = hist.groupBy("who", "pane").agg(*(f.alias(k) for k, f in again.items())).select("who", (F.col("pane") + seconds).alias("at"), F.lit(0).alias("asks"), *sums)
    asked = told.select("who", F.col("hasta").alias("at"), F.lit(1).alias("asks"), *(F.lit(None).cast(done.schema[k].dataType).alias(k) for k in sums))
    sofar = Window.partitionBy("who").orderBy("at", "asks")
    grown = done.unionByName(asked).select("who", "at", "asks", *((F.min if k == "least" else F.max if k == "most" else F.sum)(k).over(sofar).alias(k) for k in sums)).where("asks = 1")
    totals = grown.select("who", F.col("at").alias("hasta"), F.col("requests").alias("total_requests"), F.col("failures").alias("total_failures"), (F.col("total") / F.when(F.col("timed") > 0, F.col("timed"))).alias("total_mean"), F.col("least").alias("total_min"), F.col("most").alias("total_max"), (F.col("sizes") / F.when(F.col("sized") > 0, F.col("sized"))).alias("total_mean_size"))
    length = (F.unix_micros(F.col("hasta").cast("timestamp")) - F.unix_micros(F.col("desde").cast("timestamp"))) / 1e6
    out = told.join(totals, ["who", "hasta"]).withColumns({"rps": F.col("requests") / length, "fps": F.col("failures") / length})
    return out.select("every", "name", "desde", "hasta", "requests", "failures", "rps", "fps", *HISTORY, "total_requests", "total_failures", "total_mean", "total_min", "total_max", "total_mean_size")


def request_log_series(log: DataFrame, width: str = "10 minutes", step: str = "5 minutes") -> DataFrame:
    """Requests, failures and the largest latency in sliding windows."""
    return (
        log.groupBy(F.window("at", width, step).alias("w"))
        .agg(F.count("*").alias("requests"), F.count_if("failed").alias("failures"), F.max("latency").alias("max_latency"))
        .select(F.col("w.start").alias("desde"), F.col("w.end").alias("hasta"), "requests", "failures", "max_latency")
    )
