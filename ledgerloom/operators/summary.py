"""Totals by type with a grand total, control totals, rejection counts, busiest user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import SUMMARY, TOTAL


def _sums():
    zero = F.lit(0).cast(TOTAL)
    return (
        F.count("*").alias("total_transacciones"),
        F.coalesce(F.sum("monto").cast(TOTAL), zero).alias("monto_total"),
        F.coalesce(F.sum("monto_neto").cast(TOTAL), zero).alias("monto_neto_total"),
    )


def type_summary(fact: DataFrame) -> DataFrame:
    """A row for each type and one of all (type null), which is there for an empty fact too.

    The fact is aggregated once; the total is the aggregate of the few rows by type.
    """
    by_type = fact.groupBy("tipo_transaccion").agg(*_sums())
    zero = F.lit(0).cast(TOTAL)
    total = by_type.agg(
        F.coalesce(F.sum("total_transacciones"), F.lit(0)).cast("bigint").alias("total_transacciones"),
        F.coalesce(F.sum("monto_total").cast(TOTAL), zero).alias("monto_total"),
        F.coalesce(F.sum("monto_neto_total").cast(TOTAL), zero).alias("monto_neto_total"),
    ).withColumn("tipo_transaccion", F.lit(None).cast("string"))
    return by_type.unionByName(total).select(*SUMMARY.names)


def ordered_summary(summary: DataFrame) -> DataFrame:
    return summary.orderBy(F.asc_nulls_first("tipo_transaccion"))


def control_totals(fact: DataFrame) -> DataFrame:
    return fact.agg(*_sums())


def reject_counts(rejects: DataFrame) -> DataFrame:
    return rejects.groupBy("motivo_rechazo").agg(F.count("*").alias("filas")).orderBy(F.desc("filas"), "motivo_rechazo")


def busiest_user(fact: DataFrame) -> DataFrame:
    return fact.groupBy("usuario_id").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "usuario_id").limit(1)


def consistency(summary: DataFrame) -> DataFrame:
    """The total row held against the sum of the others, exactly; and net against gross."""
    is_total = F.col("tipo_transaccion").isNull()
    zero = F.lit(0).cast(TOTAL)
    part = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0) if c == "total_transacciones" else zero)
    return summary.agg(
        (part("total_transacciones", ~is_total) == part("total_transacciones", is_total)).alias("conteo_cuadra"),
        (part("monto_total", ~is_total) == part("monto_total", is_total)).alias("monto_cuadra"),
        (part("monto_neto_total", ~is_total) == part("monto_neto_total", is_total)).alias("neto_cuadra"),
        F.coalesce(F.bool_and(F.col("monto_neto_total") <= F.col("monto_total")), F.lit(True)).alias("neto_no_excede"),
    )
