"""Every query with SQL against DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 4)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=key)
    place = [want.columns.index(c) for c in order]
    b = sorted((tuple(plain(r[i]) for i in place) for r in want.fetchall()), key=key)
    assert a == b


def test_entry(spark):
    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fixture_counts(spark, medium):
    found = {r["motivo_rechazo"]: r["filas"] for r in QUERIES["reject_counts"](spark, medium).collect()}
    assert found == {"id_nulo": 15, "duplicado": 30, "usuario_nulo": 30, "fecha_nula": 15, "monto_nulo": 75, "monto_no_positivo": 15, "tipo_nulo": 45, "tipo_desconocido": 15, "estado_desconocido": 15}


def test_request_log_against_percentile(spark):
    """Exact quantiles, by name and overall, are those of Spark's own aggregate; names may be null and latencies negative, zero or null."""
    from ledgerloom.operators.request_log import PERCENTILES, request_log_report, request_log_series

    log = spark.range(5000).selectExpr(
        "case when id % 7 = 0 then null when id % 3 = 0 then 'a' else 'b' end as name", "case when id % 11 = 0 then null else round(pow((id * 37 % 1009) / 100.0 - 2, 3), 1) end as latency",
        "3 as size", "id % 10 = 0 as failed", "timestamp_seconds(id) as at")
    want = log.rollup("name").agg(F.grouping("name").alias("every"), F.percentile("latency", F.lit(0.5)).alias("median"), *(F.percentile("latency", F.lit(p)).alias(n) for n, p in PERCENTILES.items()))
    key = lambda r: (str(r["name"]), round(r["median"], 6), r["p90"])
    got = sorted(request_log_report(log).collect(), key=key)
    assert len(got) == 4 and sum(r["requests"] for r in got) == 10_000
    for a, b in zip(got, sorted(want.collect(), key=key), strict=True):
        assert a["name"] == b["name"] and all(abs(a[c] - b[c]) < 1e-9 for c in ("median", *PERCENTILES))
    assert request_log_series(log.where("false")).count() == 0
    assert [r["requests"] for r in request_log_report(log.where("false")).collect()] in ([], [0])
