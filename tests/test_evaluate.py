from datetime import datetime, timezone
from decimal import ROUND_HALF_UP, Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions.expressions import net_amount, stripped, uniform
from ledgerloom.operators.evaluate import MAP_BITS, accepted, evaluate, rejected, repeated_ids, repeated_map, with_maybe_repeated
from ledgerloom.sources.schema import FACT, RATES, RAW, REASONS, TYPES

AT = datetime(2024, 11, 3, 7, 45, tzinfo=timezone.utc)
D = Decimal


def batch(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id long, fecha timestamp, usuario_id int, monto decimal(14,2), tipo_transaccion string, estado string, place int")


def reasons(spark, rows):
    return {r["place"]: r["motivo_rechazo"] for r in evaluate(batch(spark, rows), ["place"]).collect()}


def net(spark, pairs):
    rows = spark.createDataFrame([(i, D(m), t) for i, (m, t) in enumerate(pairs)], "i int, monto decimal(14,2), tipo string").coalesce(2)
    out = rows.select("i", net_amount(F.col("monto"), F.col("tipo")).alias("n")).collect()
    return [r["n"] for r in sorted(out)]


def test_half_cents_round_up_at_every_rate(spark):
    """For each rate the smallest amounts whose withholding ends in half a cent, and one cent to either side."""
    pairs = []
    for kind, rate in RATES.items():
        halves = [c for c in range(1, 2000) if (c * rate) % 1 == D("0.5")][:3]
        pairs += [(D(c + d) / 100, kind) for c in halves or [777] for d in (-1, 0, 1) if c + d > 0]
    want = [m - (m * RATES[t]).quantize(D("0.01"), ROUND_HALF_UP) for m, t in pairs]
    assert len(pairs) > 20 and net(spark, pairs) == want


@settings(max_examples=8, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.decimals("0.01", "999999999999.99", places=2), st.sampled_from(TYPES)), min_size=50, max_size=400))
def test_net_amounts_of_any_size(spark, pairs):
    assert net(spark, pairs) == [m - (m * RATES[t]).quantize(D("0.01"), ROUND_HALF_UP) for m, t in pairs]


def test_unknown_type_is_an_error(spark):
    with pytest.raises(Exception, match="no rate for type"):
        net(spark, [("1.00", "CRIPTO")])


def flawed():
    """A good row, and for each reason one row that only it refuses, with the reason expected."""
    good = {"id": 400, "fecha": AT, "usuario_id": 31, "monto": D("73.15"), "tipo_transaccion": "TRANSFERENCIA", "estado": "FALLIDA"}
    faults = {
        "id_nulo": {"id": None}, "duplicado": {"id": 400}, "usuario_nulo": {"usuario_id": None}, "fecha_nula": {"fecha": None}, "monto_nulo": {"monto": None},
        "monto_no_positivo": {"monto": D("0.00")}, "tipo_nulo": {"tipo_transaccion": None}, "tipo_desconocido": {"tipo_transaccion": "TRUEQUE"}, "estado_desconocido": {"estado": "PERDIDA"},
    }
    assert tuple(faults) == REASONS
    rows = [good] + [good | {"id": 500 + i} | fault for i, fault in enumerate(faults.values())]
    return [tuple(r.values()) for r in rows], [None, *faults]


def test_each_reason_alone(spark):
    rows, want = flawed()
    done = evaluate(batch(spark, rows), ["place"])
    assert {r["place"]: r["motivo_rechazo"] for r in done.collect()} == dict(enumerate(want))
    ok, bad = accepted(done), rejected(done)
    assert ok.columns == FACT.names and bad.columns == [*RAW.names, "motivo_rechazo"]
    assert [f.dataType for f in ok.schema] == [f.dataType for f in FACT]
    # 0.4 % of 73.15 is 0.2926
    assert [tuple(r)[2:] for r in ok.collect()] == [(31, D("73.15"), D("72.86"), "TRANSFERENCIA", "FALLIDA")]
    assert bad.count() == len(rows) - 1


def test_of_several_reasons_the_first_counts(spark):
    """A row with all faults from one on is refused for that one; of two faults of a column the first is taken."""
    rows, want = flawed()
    good, broken = rows[0], []
    for at in range(3, len(want)):
        row = [900 + at, *good[1:]]
        for fault in rows[at:]:
            row = [x if i == 0 or x != good[i] else fault[i] for i, x in enumerate(row)]
        broken.append(tuple(row))
    assert [r for _, r in sorted(reasons(spark, broken).items())] == want[3:]


def test_an_id_sent_very_often_is_refused_after_the_first(spark):
    rows = spark.range(30_000).selectExpr("int(id % 2) as id", "timestamp '2025-01-05 00:00:00' as fecha", "1 as usuario_id", "cast(2 as decimal(14,2)) as monto", "'RETIRO' as tipo_transaccion", "string(null) as estado", "30000 - id as place")
    done = evaluate(rows.repartition(7), ["place"])
    assert [(r["place"], r["id"]) for r in done.where("motivo_rechazo is null").orderBy("place").collect()] == [(1, 1), (2, 0)]
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_min" in plan


def test_only_ids_that_may_be_repeated_move(spark):
    """Null ids and one hot id hold half of all rows; without broadcasts of data the join sees candidates only."""
    rows = spark.range(40_000).selectExpr("case when id % 4 = 0 then null when id % 4 = 1 then 7 when id % 400 = 2 then 1000000 + id div 800 else 2000000 + id end as id", "timestamp '2025-01-05 00:00:00' as fecha", "1 as usuario_id", "cast(2 as decimal(14,2)) as monto", "'RETIRO' as tipo_transaccion", "string(null) as estado", "40000 - id as place")
    want = sorted((r["place"], r["motivo_rechazo"]) for r in evaluate(rows, ["place"]).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = evaluate(rows, ["place"])
        assert sorted((r["place"], r["motivo_rechazo"]) for r in done.collect()) == want
        assert [r["n"] for r in done.groupBy("motivo_rechazo").agg(F.count("*").alias("n")).orderBy("motivo_rechazo").collect()] == [19_950 + 1, 10_000 - 1 + 50, 10_000]
        again = repeated_ids(rows, ["place"])
        seen = with_maybe_repeated(rows, again)
        assert seen.where("__maybe and id is null").count() == 0
        assert seen.where("__maybe").join(again, F.col("id") == F.col("__id"), "left_semi").count() == rows.join(again, F.col("id") == F.col("__id"), "left_semi").count()
        assert seen.where("__maybe").count() < 10_000 + 100 + 50
        plan = done._jdf.queryExecution().executedPlan().toString()
        assert "bitmap_construct_agg" in plan and "Union" in plan and "Python" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_null_ids_are_never_duplicates(spark):
    rows = [(None, AT, 1, D("1.00"), "COMPRA", None)] * 3
    assert set(reasons(spark, rows).values()) == {"id_nulo"}


def test_first_occurrence_counts_even_if_it_is_invalid(spark):
    rows = [(1, AT, 1, None, "COMPRA", None), (1, AT, 1, D("1.00"), "COMPRA", None)]
    assert reasons(spark, rows) == {0: "monto_nulo", 1: "duplicado"}


def test_white_space_and_blanks(spark):
    rows = [(1, AT, 1, D("1.00"), "\t retiro \n", "\tfallida\n"), (2, AT, 1, D("1.00"), "  ", None), (3, AT, 1, D("1.00"), "COMPRA", " ")]
    assert reasons(spark, rows) == {0: None, 1: "tipo_desconocido", 2: "estado_desconocido"}
    assert spark.range(1).select(stripped(F.lit("\t a b \n"))).first()[0] == "a b"


def test_published_order(spark, small):
    from ledgerloom.plans.queries import QUERIES

    found = [(r["usuario_id"], r["fecha"], r["id"]) for r in QUERIES["accepted_transactions"](spark, small).collect()]
    assert found == sorted(found) and len(found) > 1000


def test_empty_batch(spark):
    done = evaluate(batch(spark, []), ["place"])
    assert accepted(done).count() == 0 and rejected(done).count() == 0


def test_uniform_numbers_do_not_depend_on_partitions(spark):
    one = spark.range(0, 500, 1, 1).select("id", uniform(3, "x", F.col("id")).alias("u"))
    many = spark.range(0, 500, 1, 13).select("id", uniform(3, "x", F.col("id")).alias("u"))
    assert sorted(one.collect()) == sorted(many.collect())
    assert 0.4 < one.agg(F.avg("u")).first()[0] < 0.6


def test_no_python_in_the_plan(spark, small):
    from ledgerloom.plans.queries import QUERIES

    plan = QUERIES["summary_by_type"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_map_of_repeated_ids_is_met_by_single_numbers(spark):
    """Each row meets 64 bits of the map, whose bits are those of the repeated ids and no others."""
    ids = [7, -1, 0, 2**40, *range(1000, 1500)]
    again = spark.createDataFrame([(i,) for i in ids], "__id long")
    words = repeated_map(again)
    assert dict(words.dtypes) == {"__word": "bigint", "__bits": "bigint"}
    bits = sum(bin(r["__bits"] & (1 << 64) - 1).count("1") for r in words.collect())
    assert bits == again.select(F.pmod(F.xxhash64("__id"), F.lit(1 << MAP_BITS))).distinct().count()
    rows = spark.createDataFrame([(i,) for i in [*ids, *range(10_000, 14_000), None]], "id long")
    told = {r["id"]: r["__maybe"] for r in with_maybe_repeated(rows, again).collect()}
    assert all(told[i] for i in ids) and told[None] is False and sum(told.values()) < len(ids) + 10


def test_repeated_ids_of_a_large_batch_are_searched_for_once(spark, small):
    """Queries read the repeated ids from a file, unless they are surely few."""
    from ledgerloom.plans.queries import evaluated

    want = sorted((r["src_id"], r["seq"], str(r["motivo_rechazo"])) for r in evaluated(spark, small).collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        done = evaluated(spark, small)
        assert any("/again/" in f for f in done.inputFiles())
        assert "partial_min" not in done._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["src_id"], r["seq"], str(r["motivo_rechazo"])) for r in done.collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
