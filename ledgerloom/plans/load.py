"""The batch load: evaluate once, guard, stage, audit, publish."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, evaluate
from ..sources.schema import FACT, REJECT
from ..sources.store import Store, write_clustered, write_metrics, write_summary, written_files


def together(spark: SparkSession, *jobs: Callable[[], object]) -> list:
    """Results of independent Spark jobs, submitted at once; the first error is raised when all have ended."""
    from pyspark import inheritable_thread_target

    with ThreadPoolExecutor(len(jobs)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(job)) for job in jobs]
    return [r.result() for r in running]


@dataclass
class LoadResult:
    version: str
    totals: tuple
    report: dict
    seconds: dict[str, float] = field(default_factory=dict)
    metrics: dict = field(default_factory=dict)


def load(store: Store, raw: DataFrame, order: list[str]) -> LoadResult:
    """Publishes a raw batch as the store's next version, all or nothing.

    The evaluated rows are written once (accepted rows with their net amount), so the split does not repeat the
    search for repeated ids; rows by reason and control totals are observed on that write and need no scan. Rejects are written even if no row is accepted, in the staging
    folder; readers see nothing of a load that fails. The version holds a metrics document: rows, rejects by
    reason, seconds by phase, rows a second, files and megabytes of the fact, and the audited totals (to the moment of publication).
    A load that fails gives up the lease of its staging folder; one that another load overtook raises ConcurrentLoadError.
    """
    staged = store.stage()
    try:
        return _load(store, raw, order, staged)
    except Exception:
        if store.staged(staged):
            store.release(staged)
        raise


def _load(store: Store, raw: DataFrame, order: list[str], staged: str) -> LoadResult:
    spark, seconds = store.spark, {}
    began = started = time.time()

    def took(step: str) -> None:
        nonlocal began
        seconds[step] = round(time.time() - began, 3)
        began = time.time()
        if store.staged(staged):
            store.renew(staged)

    evaluate.repeated_ids(raw, order).write.parquet(staged + "/again")
    took("repeated ids")
    rows = evaluate.evaluate(raw, order, spark.read.parquet(staged + "/again"))
    ok = rows["motivo_rechazo"].isNull()
    seen, measures = audit.observed(f"load {staged}")
    rows.withColumn("monto_neto", evaluate.net_amount(rows["monto"], rows["tipo_transaccion"], ok)).select(*FACT.names, "motivo_rechazo").observe(seen, *measures).write.parquet(staged + "/evaluated")
    report, expected = audit.observed_report(seen.get)
    evaluated = spark.read.parquet(staged + "/evaluated")
    took("evaluate")
    fact, rejects = evaluated.where("motivo_rechazo is null").select(*FACT.names), evaluated.where("motivo_rechazo is not null").select(*REJECT.names)
    together(
        spark,
        lambda: rejects.write.option("compression", "zstd").parquet(staged + "/rejects"),
        lambda: write_clustered(fact, staged + "/fact"),
    )
    took("write")
    if not report["filas_aceptadas"]:
        raise audit.EmptyLoadError("no row was accepted")
    written = spark.read.schema(FACT).parquet(staged + "/fact")

    def summarised() -> tuple:
        write_summary(written, staged)
        return audit.reconcile(expected, spark.read.parquet(staged + "/summary"))

    def files() -> tuple:
        return tuple(written_files(written).agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())

    totals, broken, (batches, size) = together(spark, summarised, lambda: audit.constraint_report(written).where("violaciones > 0").collect(), files)
    if broken:
        raise audit.ReconciliationError(f"constraints violated: {broken}")
    took("audit")
    total = time.time() - started
    metrics = {
        "filas_leidas": report["filas_leidas"],
        "filas_cargadas": report["filas_aceptadas"],
        "filas_rechazadas": report["filas_rechazadas"],
        "rechazos_por_motivo": {k: int(n) for k, n in (x.split("=") for x in report["por_motivo"].split(",") if x)},
        "tiempos_s": dict(seconds),
        "total_s": round(total, 3),
        "total_filas_por_segundo": round(report["filas_leidas"] / max(total, 1e-3)),
        "lotes": batches,
        "mb_enviados": round(size / 1e6, 3),
        "filas_escritas_por_segundo": round(report["filas_aceptadas"] / max(seconds["write"], 1e-3)),
        "auditoria": dict(zip(("total_transacciones", "monto_total", "monto_neto_total"), map(str, totals), strict=True)),
        "escrito_en": datetime.now(timezone.utc).isoformat(),
    }
    write_metrics(spark, metrics, staged)
    version = store.publish(staged)
    for scratch in ("/evaluated", "/again"):  # no reader looks for them
        fs, at = store._fs(version + scratch)
        fs.delete(at, True)
    took("publish")
    return LoadResult(version, totals, report, seconds, metrics)
