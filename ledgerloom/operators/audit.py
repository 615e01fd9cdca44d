"""Constraint checks, reconciliation, profiles, table descriptions and run reports."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.schema import FACT, REASONS, STATES, SUMMARY, TOTAL, TYPES
from .summary import control_totals


class ReconciliationError(RuntimeError):
    """Staged totals differ from the source's; nothing was published."""


class EmptyLoadError(RuntimeError):
    """No row was accepted; nothing was published."""


def constraint_report(fact: DataFrame) -> DataFrame:
    """One row for each constraint with its number of violations, in one pass plus one for the key."""
    checks = {f"not_null_{c}": F.col(c).isNull() for c in FACT.names} | {
        "monto_positivo": F.col("monto") <= 0,
        "neto_en_rango": (F.col("monto_neto") < 0) | (F.col("monto_neto") > F.col("monto")),
        "tipo_en_dominio": ~F.col("tipo_transaccion").isin(*TYPES),
        "estado_en_dominio": ~F.col("estado").isin(*STATES),
    }
    one = fact.agg(*(F.count_if(test).alias(name) for name, test in checks.items()))
    rows = one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*map(F.col, checks)))).alias("restriccion", "violaciones"))
    key = fact.where("id is not null").groupBy("id").count().where("count > 1").agg(F.lit("id_unico").alias("restriccion"), F.count("*").alias("violaciones"))
    return rows.unionByName(key)


def reconcile(evaluated_fact: DataFrame | tuple, staged_summary: DataFrame) -> tuple:
    """The totals, if the staged summary's total row equals those of the source (rows, or their totals) to the cent."""
    expected = evaluated_fact if isinstance(evaluated_fact, tuple) else tuple(control_totals(evaluated_fact).first())
    rows = staged_summary.where(F.col("tipo_transaccion").isNull()).select(*SUMMARY.names[1:]).collect()
    actual = tuple(rows[0]) if len(rows) == 1 else None
    if actual != expected:
        raise ReconciliationError(f"expected {expected}, staged {actual}")
    return expected


def observed(name: str) -> tuple[Observation, list[Column]]:
    """An observation of evaluated rows (with ``monto_neto``) and its measures: rows by reason, and the accepted rows' sums.

    It counts while the rows are written; nothing behind it may sample them again, such as a range exchange.
    """
    ok = F.col("motivo_rechazo").isNull()
    sums = [F.sum(F.when(ok, F.col(c))).cast(TOTAL).alias(c) for c in ("monto", "monto_neto")]
    return Observation(name), [F.count("*").alias("filas"), *(F.count_if(F.col("motivo_rechazo") == r).alias(r) for r in REASONS), *sums]


def observed_report(seen: dict) -> tuple[dict, tuple]:
    """``run_report``'s row and ``control_totals``' from what was observed."""
    by = {r: seen[r] for r in sorted(REASONS) if seen[r]}
    refused, rows = sum(by.values()), seen["filas"]
    report = {"filas_leidas": rows, "filas_aceptadas": rows - refused, "filas_rechazadas": refused, "porcentaje_rechazado": round(100.0 * refused / rows, 2) if rows else 0.0, "por_motivo": ",".join(f"{r}={n}" for r, n in by.items())}
    zero = Decimal("0.00")
    return report, (rows - refused, seen["monto"] or zero, seen["monto_neto"] or zero)


def source_profile(raw: DataFrame) -> DataFrame:
    """Rows, nulls by column, repeated ids (nulls count as one value) and amounts that are not positive, in one row."""
    distinct = F.countDistinct("id") + F.coalesce(F.max(F.col("id").isNull().cast("int")), F.lit(0))
    columns = [c for c in ("id", "fecha", "usuario_id", "monto", "tipo_transaccion", "estado") if c in raw.columns]
    return raw.agg(
        F.count("*").alias("filas"),
        *(F.count_if(F.col(c).isNull()).alias(f"nulos_{c}") for c in columns),
        (F.count("*") - distinct).cast("bigint").alias("ids_repetidos"),
        F.count_if(F.col("monto") <= 0).alias("montos_no_positivos"),
    )


def head_sample(raw: DataFrame, rows: int = 5) -> DataFrame:
    return raw.orderBy(F.asc_nulls_last("id")).limit(rows)


def describe(df: DataFrame, declared=None) -> DataFrame:
    """posicion, columna, tipo, admite_nulos and no_nulos (values that are not null) of every column.

    ``declared``, a schema, says which columns may hold nulls; a file's own schema does not.
    """
    fields = df.schema.fields
    may = {f.name: f.nullable for f in fields} | {f.name: f.nullable for f in declared or []}
    counts = df.agg(*(F.count(F.col(f.name)).alias(f"c{i}") for i, f in enumerate(fields)))
    rows = [F.struct(F.lit(i + 1).alias("posicion"), F.lit(f.name).alias("columna"), F.lit(f.dataType.simpleString()).alias("tipo"), F.lit(may[f.name]).alias("admite_nulos"), F.col(f"c{i}").alias("no_nulos")) for i, f in enumerate(fields)]
    return counts.select(F.inline(F.array(*rows)))


def run_report(evaluated: DataFrame) -> DataFrame:
    """One row: rows read, accepted, rejected, percentage rejected and the counts by reason (sorted by reason)."""
    by = evaluated.groupBy("motivo_rechazo").agg(F.count("*").alias("n"))
    bad = F.col("motivo_rechazo").isNotNull()
    total = F.coalesce(F.sum("n"), F.lit(0))
    refused = F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0))
    return by.agg(
        total.cast("bigint").alias("filas_leidas"),
        (total - refused).cast("bigint").alias("filas_aceptadas"),
        refused.cast("bigint").alias("filas_rechazadas"),
        F.round(F.when(total > 0, 100.0 * refused / total).otherwise(0.0), 2).alias("porcentaje_rechazado"),
        F.array_join(F.sort_array(F.collect_list(F.when(bad, F.concat("motivo_rechazo", F.lit("="), "n")))), ",").alias("por_motivo"),
    )
