from datetime import datetime, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import audit
from ledgerloom.operators.evaluate import accepted, evaluate
from ledgerloom.operators.summary import consistency, type_summary
from ledgerloom.plans.load import load
from ledgerloom.sources.schema import FACT, RAW, REJECT
from ledgerloom.sources.store import ConcurrentLoadError, Store, read_batch, read_csv, write_clustered, write_csv, write_version, written_files

AT = datetime(2025, 6, 1, 12, tzinfo=timezone.utc)


def raw(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "id long, fecha timestamp, usuario_id int, monto decimal(14,2), tipo_transaccion string, estado string, place int")


GOOD = [(i, AT, i % 3, D("10.00"), "COMPRA", None) for i in range(1, 8)]


def test_publish_and_read_back(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    assert store.current() is None
    for read in (store.fact, store.summary, store.rejects):
        with pytest.raises(LookupError, match="nothing was published"):
            read()
    store.init()
    assert store.fact().count() == 0
    assert [tuple(r)[:4] for r in store.summary().collect()] == [(None, 0, D("0.00"), D("0.00"))]
    assert store.summary().where("actualizado_en is null").count() == 0
    first = store.current()
    assert store.init() == first
    result = load(store, raw(spark, GOOD + GOOD[:2]), ["place"])
    assert store.current() == result.version != first
    assert result.report["filas_leidas"] == 9 and result.report["por_motivo"] == "duplicado=2"
    assert store.fact().count() == 7 and store.rejects().count() == 2
    doc = store.metrics()
    assert doc == result.metrics and (doc["filas_leidas"], doc["filas_cargadas"], doc["rechazos_por_motivo"]) == (9, 7, {"duplicado": 2})
    assert doc["auditoria"]["monto_neto_total"] == "58.80" and doc["total_filas_por_segundo"] > 0 and (doc["lotes"] > 0) and doc["mb_enviados"] > 0 and set(doc["tiempos_s"]) == {"repeated ids", "evaluate", "write", "audit"}
    assert result.totals == (7, D("70.00"), D("58.80"))
    assert spark.read.parquet(first + "/fact").count() == 0  # the old version is still whole
    assert store.init(reset=True) == store.current() != result.version


def test_empty_load_publishes_nothing_but_writes_rejects(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.init()
    live = store.current()
    with pytest.raises(audit.EmptyLoadError):
        load(store, raw(spark, [(1, AT, 1, None, "COMPRA", None), (2, AT, None, D("1.00"), "COMPRA", None)]), ["place"])
    assert store.current() == live
    assert spark.read.parquet(store.path("staging") + "/*/rejects").count() == 2
    store.drop_staging()
    with pytest.raises(Exception):
        spark.read.parquet(store.path("staging") + "/*/rejects").count()


def test_of_two_loads_at_once_one_is_refused(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    store = Store(spark, f"file://{tmp_path}/store")
    before = store.init()
    at = Barrier(2)

    def one(rows):
        staged = store.stage()
        write_version(accepted(evaluate(raw(spark, rows), ["place"])), spark.createDataFrame([], REJECT), staged)
        at.wait()
        try:
            return store.publish(staged)
        except ConcurrentLoadError as error:
            return error

    with ThreadPoolExecutor(2) as pool:
        done = list(pool.map(one, (GOOD, GOOD[:3])))
    refused = [d for d in done if isinstance(d, ConcurrentLoadError)]
    (version,) = [d for d in done if isinstance(d, str)]
    assert len(refused) == 1 and store.current() == version != before
    assert store.fact().count() == (7 if done[0] == version else 3) == store.summary().where("tipo_transaccion is null").first()["total_transacciones"]
    # the refused load's folder has no lease and goes; the one of a load that runs stays until its lease is old
    running = store.stage()
    assert len(store.drop_staging()) == 1 and store.staged(running)
    assert load(store, raw(spark, GOOD), ["place"]).version == store.current()
    with pytest.raises(ConcurrentLoadError):
        store.publish(running)
    old = store.stage()
    assert set(store.drop_staging(-60)) == {x.rpartition("/")[2] for x in (running, old)}


def test_csv_round_trip_and_its_files(spark, small, tmp_path):
    from ledgerloom.plans.queries import fact

    rows = fact(spark, small).withColumn("fecha", F.col("fecha").cast("timestamp"))
    write_csv(rows, f"file://{tmp_path}/csv", 100)
    back = read_csv(spark, f"file://{tmp_path}/csv")
    assert back.exceptAll(rows).count() == rows.exceptAll(back).count() == 0
    files = written_files(back).collect()
    assert sum(f["filas"] for f in files) == rows.count() and max(f["filas"] for f in files) == 100
    assert sum(f["bytes"] for f in files) == sum(p.stat().st_size for p in tmp_path.glob("csv/part-*"))
    (tmp_path / "bad.csv").write_text("1,nonsense,3\n")
    with pytest.raises(Exception, match="[Mm]alformed|MALFORMED"):
        read_csv(spark, f"file://{tmp_path}/bad.csv").collect()


def test_tampered_staging_is_refused(spark):
    fact = accepted(evaluate(raw(spark, GOOD), ["place"]))
    summary = type_summary(fact)
    audit.reconcile(fact, summary)
    with pytest.raises(audit.ReconciliationError):
        audit.reconcile(fact, summary.withColumn("monto_total", (F.col("monto_total") + D("0.01")).cast("decimal(20,2)")))
    with pytest.raises(audit.ReconciliationError):
        audit.reconcile(fact, summary.where("tipo_transaccion is not null"))


def test_consistency_and_constraints(spark):
    fact = accepted(evaluate(raw(spark, GOOD), ["place"]))
    assert all(consistency(type_summary(fact)).first())
    assert audit.constraint_report(fact).agg(F.sum("violaciones")).first()[0] == 0
    broken = fact.unionByName(fact.limit(1)).withColumn("monto_neto", F.col("monto") + 1).withColumn("estado", F.lit("X"))
    found = {r["restriccion"]: r["violaciones"] for r in audit.constraint_report(broken).collect()}
    assert found["id_unico"] == 1 and found["neto_en_rango"] == 8 and found["estado_en_dominio"] == 8 and found["monto_positivo"] == 0


def test_summary_of_nothing_has_a_total(spark):
    assert [tuple(r) for r in type_summary(spark.createDataFrame([], FACT)).collect()] == [(None, 0, D("0.00"), D("0.00"))]


def test_files_keep_input_order_and_prune_by_user(spark, tmp_path):
    rows = raw(spark, GOOD + GOOD)
    rows.select(*RAW.names).coalesce(1).write.parquet(f"{tmp_path}/batch")
    done = evaluate(read_batch(spark, f"{tmp_path}/batch"), ["file", "row"]).orderBy("row").collect()
    assert [r["motivo_rechazo"] for r in done] == [None] * 7 + ["duplicado"] * 7
    write_clustered(accepted(evaluate(rows, ["place"])), f"{tmp_path}/fact", 2)
    plan = spark.read.schema(FACT).parquet(f"{tmp_path}/fact").where("usuario_id = 1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(usuario_id,1)" in plan
    write_csv(accepted(evaluate(rows, ["place"])), f"{tmp_path}/csv", 3)
    assert spark.read.csv(f"{tmp_path}/csv").count() == 7



def test_an_empty_selection_of_the_tables_has_a_total(spark, small):
    from ledgerloom.plans.queries import fact

    nothing = fact(spark, small).where("monto > 99999999999")
    assert [tuple(r) for r in type_summary(nothing).collect()] == [(None, 0, D("0.00"), D("0.00"))]


def test_declared_columns_hold_no_nulls(spark):
    described = audit.describe(accepted(evaluate(raw(spark, GOOD), ["place"])), FACT).collect()
    assert [r["columna"] for r in described] == FACT.names and not any(r["admite_nulos"] for r in described)


def test_observed_totals_are_those_of_a_scan(spark, small, tmp_path):
    from ledgerloom.operators.evaluate import net_amount
    from ledgerloom.operators.summary import control_totals
    from ledgerloom.sources.fixtures import raw_transactions

    rows = evaluate(raw_transactions(spark, small), ["seq", "src_id"])
    rows = rows.withColumn("monto_neto", net_amount(rows["monto"], rows["tipo_transaccion"], rows["motivo_rechazo"].isNull()))
    seen, measures = audit.observed("test")
    rows.observe(seen, *measures).write.parquet(f"{tmp_path}/rows")
    report, totals = audit.observed_report(seen.get)
    assert report == audit.run_report(rows).first().asDict()
    assert totals == tuple(control_totals(rows.where("motivo_rechazo is null")).first())
