import json
import re
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import serving
from ledgerloom.operators.summary import type_summary
from ledgerloom.plans.queries import fact
from ledgerloom.sources.schema import FACT

#: usuario_id, limit, offset, status: a known user's pages, then each field just inside and just outside its bounds.
CASES = [
    ("14", "3", None, 200),
    ("14", "2", "1", 200),
    (" 14 ", None, "0", 200),
    ("14", "1000", "2147483647", 200),
    ("2147483647", None, None, 404),
    ("2147483647", None, "3", 200),
    ("2147483648", None, None, 422),
    ("-14", None, None, 422),
    ("1e1", None, None, 422),
    ("14", "1001", "0", 422),
    ("14", "-3", None, 422),
    ("14", "2.0", None, 422),
    ("14", "3", "2147483648", 422),
    ("14", "", None, 422),
    (None, "3", "3", 422),
    ("7" * 45, None, None, 422),
]


@pytest.fixture(scope="module")
def rows(spark, small):
    return fact(spark, small).cache()


def asked(spark, cases):
    return spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "request_id long, usuario_id string, limit string, offset string")


def test_statuses(spark, rows):
    found = {r["request_id"]: r["status"] for r in serving.history_counts(rows, asked(spark, CASES)).collect()}
    assert [found[i] for i in range(len(CASES))] == [c[3] for c in CASES]


def test_pages_are_parts_of_longer_pages(spark, rows):
    user = rows.groupBy("usuario_id").count().orderBy(F.desc("count")).first()["usuario_id"]
    whole = serving.history_page(rows, user, 1000).collect()
    assert whole == sorted(whole, key=lambda r: (r["fecha"], r["id"]), reverse=True)
    cuts = [(limit, offset) for limit in (1, 4, 9) for offset in (0, 2, 5)]
    batch = serving.history_rows(rows, asked(spark, [(str(user), str(n), str(k)) for n, k in cuts])).collect()
    for request, (n, k) in enumerate(cuts):
        assert serving.history_page(rows, user, n, k).collect() == whole[k : k + n]
        got = [tuple(r)[3:] for r in sorted(batch, key=lambda r: r["rn"]) if r["request_id"] == request]
        assert got == [tuple(r) for r in whole[k : k + n]]


def test_a_very_active_user_is_ranked_in_groups(spark):
    """One user holds nearly all rows; another's far offset does not widen what is ranked for the first."""
    many = spark.range(40_000).selectExpr("id", "timestamp '2024-01-01' + make_interval(0,0,0,0,0,0,id % 977) as fecha", "int(if(id < 39000, 6, 9)) as usuario_id", "cast(1 as decimal(14,2)) as monto", "cast(1 as decimal(14,2)) as monto_neto", "'RETIRO' as tipo_transaccion", "'FALLIDA' as estado")
    found = serving.history_rows(many, asked(spark, [("6", "5", "3"), ("9", "2", "900"), ("9", "7", "2147483000")]))
    want = [r["id"] for r in many.where("usuario_id = 6").orderBy(F.desc("fecha"), F.desc("id")).limit(8).collect()[3:]]
    got = sorted(found.collect(), key=lambda r: (r["request_id"], r["rn"]))
    assert [r["id"] for r in got if r["request_id"] == 0] == want and [r["rn"] for r in got if r["request_id"] == 1] == [901, 902]
    assert not [r for r in got if r["request_id"] == 2]


def test_plans_of_the_registered_queries(spark, small):
    from ledgerloom.plans.queries import QUERIES

    page = QUERIES["user_history_page"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
    batch = QUERIES["history_batch"](spark, small)._jdf.queryExecution().executedPlan().toString()
    # counted by user and day, then only the touched days' rows are ranked
    assert "partial_count" in batch and "__newer" in batch and "__day" in batch
    assert not re.search(r"Window \[row_number\(\)[^\n]*?\], \[usuario_id#\d+\], ", batch)


def test_a_far_page_reads_no_other_day(spark, tmp_path):
    """Rows that are ranked are those of the page's days."""
    many = spark.range(6_000).selectExpr("id", "timestamp '2024-01-01' + make_interval(0,0,0,id % 60,0,0,id div 60) as fecha", "int(6) as usuario_id", "cast(1 as decimal(14,2)) as monto", "cast(1 as decimal(14,2)) as monto_neto", "'RETIRO' as tipo_transaccion", "'FALLIDA' as estado")
    found = serving.history_rows(many, asked(spark, [("6", "10", "5795"), ("6", "1000", "5990"), ("6", "3", "6000"), ("6", "120", "50")]))
    want = [r["id"] for r in many.orderBy(F.desc("fecha"), F.desc("id")).collect()]
    pages = {}
    for r in sorted(found.collect(), key=lambda r: r["rn"]):
        pages.setdefault(r["request_id"], []).append(r["id"])
    assert pages == {0: want[5795:5805], 1: want[5990:], 3: want[50:170]}
    days = serving.touched_days(many, asked(spark, [("6", "10", "5795")])).collect()
    assert sorted((str(d["__day"]), d["__newer"]) for d in days) == [("2024-01-02", 5800), ("2024-01-03", 5700)]


def test_documents(spark, rows):
    out = {r["request_id"]: r for r in serving.history_documents(rows, asked(spark, CASES)).collect()}
    assert set(out) == {i for i, c in enumerate(CASES) if c[3] != 422}
    page = json.loads(out[1]["documento"], parse_float=D)
    assert list(page) == ["usuario_id", "cantidad", "limit", "offset", "transacciones"] and page["cantidad"] == len(page["transacciones"])
    assert list(page["transacciones"][0]) == list(serving.PAGE)
    assert json.loads(out[3]["documento"])["transacciones"] == []
    assert all(0 <= t["monto_neto"] <= t["monto"] and -t["monto"].as_tuple().exponent == 2 for t in page["transacciones"])


def test_summary_document(spark, rows):
    doc = serving.summary_document(type_summary(rows)).first()
    text = json.loads(doc["documento"], parse_float=D)
    assert text["monto_total"] == doc["monto_total"] and [t["tipo_transaccion"] for t in text["por_tipo"]] == [t["tipo_transaccion"] for t in doc["por_tipo"]]
    stamped = serving.summary_document(type_summary(rows).withColumn("actualizado_en", F.lit("2024-05-06 07:08:09").cast("timestamp"))).first()
    assert json.loads(stamped["documento"])["actualizado_en"].startswith("2024-05-06T07:08:09")
    assert doc["total_transacciones"] == sum(t["total_transacciones"] for t in doc["por_tipo"]) == rows.count()
    assert [t["tipo_transaccion"] for t in doc["por_tipo"]] == sorted(t["tipo_transaccion"] for t in doc["por_tipo"])
    empty = serving.summary_document(type_summary(spark.createDataFrame([], FACT))).first()
    assert empty["total_transacciones"] == 0 and empty["por_tipo"] == []
    with pytest.raises(Exception, match="no total row"):
        serving.summary_document(type_summary(rows).where("tipo_transaccion is not null")).collect()


def test_page_sizes_need_no_window(spark, small):
    from ledgerloom.plans import queries

    for query in (queries.request_status, queries.history_page_counts):
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "CartesianProduct" not in plan
