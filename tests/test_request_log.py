"""Quantiles and the history of request logs against plain loops."""

import math
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import request_log as r

ODD = [0.5, 5.0, 50.0, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, -3.5, 1e-310, 1.7e308, -1e-310]


def same(a, b):
    return (a is None and b is None) or (math.isnan(a) and math.isnan(b)) or a == b or abs(a - b) <= 1e-9 * abs(b)


@pytest.mark.parametrize("values", [ODD, ODD[:4], ODD[:1], [0.5, 5.0, float("inf")], [float("nan")] * 3, ODD * 5])
def test_odd_latencies_against_percentile(spark, values):
    log = spark.createDataFrame([(None if i % 3 == 0 else "a", v) for i, v in enumerate(values)], "name string, latency double").selectExpr("*", "1 as size", "false as failed", "timestamp_seconds(1) as at")
    shares = {"median": 0.5} | r.PERCENTILES
    want = {(x["every"], x["name"]): x for x in log.rollup("name").agg(F.grouping("name").cast("int").alias("every"), *(F.percentile("latency", F.lit(p)).alias(n) for n, p in shares.items())).collect()}
    got = {(x["__every"], x["__name"]): x for x in r.exact_quantiles(log, shares).collect()}
    assert got.keys() == want.keys()
    assert all(same(got[k][n], want[k][n]) for k in got for n in shares)
    assert r.request_log_report(log).count() == len(want)


def test_a_million_close_latencies(spark):
    """All lie within one per cent of each other; no window holds more than the buckets below one parent."""
    log = spark.range(0, 1_000_000, 1, 8).selectExpr("'a' as name", "100 + (id * 7919 % 1000000) / 1000000D as latency")
    got = r.exact_quantiles(log, {"p50": 0.5, "p99": 0.99}).where("__every = 0").first()
    assert abs(got["p50"] - 100.4999995) < 1e-9 and abs(got["p99"] - (100 + 0.99 * 999999 / 1e6)) < 1e-9
    widest = log.selectExpr("latency as v").select(r.ordered_bits(F.col("v")).alias("b")).groupBy((F.shiftright("b", 48)).alias("p")).count().count()
    assert widest == 1  # the first 16 bits tell nothing apart here


def test_history_against_loops(spark):
    t0 = datetime(2025, 1, 1, tzinfo=timezone.utc)
    rows = [(None if i % 11 == 0 else "ab"[i % 2], None if i % 13 == 0 else (i * 37 % 1009) ** 1.7 / 50 - 3, i % 5, i % 7 == 0, t0 + timedelta(seconds=(i * i) % 400)) for i in range(700)]
    log = spark.createDataFrame(rows, "name string, latency double, size int, failed boolean, at timestamp")
    digits = {x["latency"]: x["b"] for x in log.select("latency", r.three_digits(F.col("latency")).alias("b")).collect()}
    assert all(b is None or abs(b - v) <= max(0.0051, 0.0051 * abs(v)) for v, b in digits.items())
    got = r.request_log_history(log, "10 seconds", 3).collect()
    seen = set()
    for x in got:
        mine = [q for q in rows if x["every"] or q[0] == x["name"]]
        inside = [q for q in mine if x["desde"].timestamp() <= q[4].timestamp() < x["hasta"].timestamp()]
        sofar = [q for q in mine if q[4].timestamp() < x["hasta"].timestamp()]
        assert (x["requests"], x["failures"], x["total_requests"], x["total_failures"]) == (len(inside), sum(q[3] for q in inside), len(sofar), sum(q[3] for q in sofar))
        assert same(x["rps"], len(inside) / 30)
        ordered = sorted(digits[q[1]] for q in inside if q[1] is not None)
        for n, p in r.HISTORY.items():
            assert x[n] == (ordered[-(-p * len(ordered) // 10_000) - 1] if ordered else None)
        timed = [q[1] for q in sofar if q[1] is not None]
        assert same(x["total_mean"], sum(timed) / len(timed) if timed else None) and same(x["total_min"], min(timed, default=None)) and same(x["total_max"], max(timed, default=None))
        seen.add((x["every"], x["name"], x["desde"]))
    steps = {(e, n, int(q[4].timestamp()) // 10 - k) for q in rows for e, n in ((0, q[0]), (1, None)) for k in range(3)}
    assert len(seen) == len(got) == len(steps)
    assert r.request_log_history(log.where("false")).count() == 0
