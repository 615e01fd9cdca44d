"""The registered queries over the given tables, and their SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import uniform
from ..operators import audit, request_log, sampling, serving, summary
from ..operators.evaluate import accepted, evaluate, is_small, normalize, rejected, repeated_ids
from ..sources.fixtures import ODD_REQUESTS, raw_transactions, requests, table
from ..sources.schema import DEFAULT_STATE, FACT, RATES, RAW, REASONS, STATES, TYPES
from ..sources.store import Store, read_csv, write_csv, write_version
from .load import load

Query = Callable[[SparkSession, str], DataFrame]
ORDER = ["seq", "src_id"]
PAGE_USER, PAGE_LIMIT, PAGE_OFFSET = 8, 10, 2


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluated batch. Unless they are surely few, repeated ids are searched for once and written, as in ``load``:
    their true size is then known, and no later pass over the batch looks for them again."""
    rows = raw_transactions(spark, sf_dir)
    again = repeated_ids(rows, ORDER)
    if not is_small(again):
        path = shared_root(spark) + "/again"
        again.write.parquet(path)
        again = spark.read.parquet(path)
    return evaluate(rows, ORDER, again)


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accepted(evaluated(spark, sf_dir))


def shared_root(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
    return f"{where}/store-{uuid.uuid4().hex}"


def published(spark: SparkSession, sf_dir: str) -> Store:
    store = Store(spark, shared_root(spark))
    rows = raw_transactions(spark, sf_dir).withColumn("fecha", F.col("fecha").cast("timestamp"))
    load(store, rows, ORDER)
    return store


def normalized_transactions(spark, sf_dir):
    return normalize(raw_transactions(spark, sf_dir)).select("src_id", "seq", "tipo_transaccion", "estado")


def rejection_reasons(spark, sf_dir):
    return evaluated(spark, sf_dir).select("src_id", "seq", "motivo_rechazo")


def accepted_transactions(spark, sf_dir):
    return fact(spark, sf_dir).orderBy("usuario_id", "fecha", "id")


def rejected_transactions(spark, sf_dir):
    return rejected(evaluated(spark, sf_dir))


def reject_counts(spark, sf_dir):
    return summary.reject_counts(rejected(evaluated(spark, sf_dir)))


def control_totals(spark, sf_dir):
    return summary.control_totals(fact(spark, sf_dir))


def summary_by_type(spark, sf_dir):
    return summary.ordered_summary(summary.type_summary(fact(spark, sf_dir)))


def summary_document(spark, sf_dir):
    return serving.summary_document(summary.type_summary(fact(spark, sf_dir))).select("documento")


def user_history_page(spark, sf_dir):
    return serving.history_page(fact(spark, sf_dir), PAGE_USER, PAGE_LIMIT, PAGE_OFFSET)


def history_batch(spark, sf_dir):
    return serving.history_rows(fact(spark, sf_dir), requests(spark, sf_dir))


def history_page_counts(spark, sf_dir):
    return serving.history_counts(fact(spark, sf_dir), requests(spark, sf_dir)).where("status <> 422").select("request_id", "cantidad")


def request_status(spark, sf_dir):
    return serving.history_counts(fact(spark, sf_dir), requests(spark, sf_dir)).select("request_id", "status")


def history_json(spark, sf_dir):
    return serving.history_documents(fact(spark, sf_dir), requests(spark, sf_dir)).select("request_id", "documento")


def busiest_user(spark, sf_dir):
    return summary.busiest_user(fact(spark, sf_dir))


def constraint_report(spark, sf_dir):
    """Constraints of the normalised raw rows read as a fact, so that there is something to find."""
    rows = normalize(raw_transactions(spark, sf_dir)).withColumn("monto_neto", F.col("monto")).select(*FACT.names)
    return audit.constraint_report(rows)


def source_profile(spark, sf_dir):
    return audit.source_profile(raw_transactions(spark, sf_dir))


def source_head(spark, sf_dir):
    return audit.head_sample(raw_transactions(spark, sf_dir).where("seq = 0").select(*RAW.names))


def summary_consistency(spark, sf_dir):
    return summary.consistency(summary.type_summary(fact(spark, sf_dir)))


def reconciliation(spark, sf_dir):
    """Totals of a staged round trip, which raise unless they equal the source's."""
    rows = fact(spark, sf_dir)
    rows = rows.withColumn("fecha", F.col("fecha").cast("timestamp"))
    staged = shared_root(spark)
    write_version(rows, rejected(evaluated(spark, sf_dir)).withColumn("fecha", F.col("fecha").cast("timestamp")), staged)
    audit.reconcile(rows, spark.read.parquet(staged + "/summary"))
    return spark.read.parquet(staged + "/summary").where("tipo_transaccion is null").drop("tipo_transaccion", "actualizado_en")


def published_snapshot(spark, sf_dir):
    """The fact read back from a published version."""
    return published(spark, sf_dir).fact().withColumn("fecha", F.col("fecha").cast("timestamp_ntz"))


def csv_round_trip(spark, sf_dir):
    """The fact written in the bulk format, in files of bounded size, and read back in its own types."""
    path = shared_root(spark)
    write_csv(fact(spark, sf_dir).withColumn("fecha", F.col("fecha").cast("timestamp")), path)
    return read_csv(spark, path).withColumn("fecha", F.col("fecha").cast("timestamp_ntz"))


def synthetic_uniforms(spark, sf_dir):
    """The reproducible random numbers by order, in whole 32-bit steps."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("clave"), (uniform(42, "type", k) * float(1 << 32)).cast("bigint").alias("tipo_u"), (uniform(42, "state", k) < 0.9).alias("completada"))


def schema_description(spark, sf_dir):
    return audit.describe(fact(spark, sf_dir), FACT)


def _log(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("value").alias("latency"), F.length("props").alias("size"), (F.col("event_type") == "error").alias("failed"), F.col("ts").alias("at"))


def request_log_report(spark, sf_dir):
    return request_log.request_log_report(_log(spark, sf_dir)).select("name", "requests", "failures", "min", "max", F.round("median", 6).alias("median"), *(F.round(p, 6).alias(p) for p in request_log.PERCENTILES), F.round("mean", 6).alias("mean"), F.round("mean_size", 6).alias("mean_size"), F.round("rps", 4).alias("rps"))


def request_log_series(spark, sf_dir):
    return request_log.request_log_series(_log(spark, sf_dir), "1 hour", "1 hour")


def request_log_history(spark, sf_dir):
    """Two-hour windows that slide by an hour."""
    rounded = lambda c: F.round(c, 6).alias(c)
    up = lambda c: F.round(F.col(c) + 1e-9, 6).alias(c)  # noqa: E731  a mean that lies half-way goes up whatever the order of its sum
    out = request_log.request_log_history(_log(spark, sf_dir), "1 hour", 2)
    return out.select("every", "name", "desde", "hasta", "requests", "failures", rounded("rps"), rounded("fps"), *request_log.HISTORY, "total_requests", "total_failures", up("total_mean"), "total_min", "total_max", up("total_mean_size"))


def order_sample(spark, sf_dir):
    """A thousandth of all orders exactly, rounded down, without replacement."""
    return sampling.exact_sample(table(spark, sf_dir, "orders"), "o_orderkey", 0.001).select("o_orderkey", "o_totalprice")


def order_sample_by_price(spark, sf_dir):
    """A hundred orders drawn by price, without replacement."""
    return sampling.weighted_sample(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 100).select("o_orderkey", "o_totalprice")


def run_report(spark, sf_dir):
    return audit.run_report(evaluated(spark, sf_dir))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        normalized_transactions, rejection_reasons, accepted_transactions, rejected_transactions, reject_counts, control_totals,
        summary_by_type, summary_document, user_history_page, history_batch, history_page_counts, request_status,
        history_json, busiest_user, constraint_report, source_profile, source_head, summary_consistency, reconciliation, published_snapshot, csv_round_trip,
        synthetic_uniforms, schema_description, request_log_report, request_log_series, request_log_history, order_sample, order_sample_by_price, run_report,
    )
}


# --- SQL -------------------------------------------------------------------------------------------

_KIND = "CASE o_orderpriority WHEN '1-URGENT' THEN 'COMPRA' WHEN '2-HIGH' THEN 'DEPOSITO' WHEN '3-MEDIUM' THEN 'RETIRO' WHEN '4-NOT SPECIFIED' THEN 'TRANSFERENCIA' ELSE 'PAGO_SERVICIO' END"
_STATE = "CASE WHEN o_orderkey % 100 = 99 THEN 'REVERTIDA' WHEN o_orderstatus = 'F' THEN 'COMPLETADA' WHEN o_orderstatus = 'O' THEN 'PENDIENTE' ELSE 'FALLIDA' END"
_IN = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"

_RAW_SQL = f"""
base AS (
  SELECT o_orderkey AS src_id, 0 AS seq,
    CASE WHEN o_orderkey % 1000 <> 37 THEN o_orderkey END AS id,
    CASE WHEN o_orderkey % 1000 <> 11 THEN o_orderdate END AS fecha,
    CASE WHEN o_orderkey % 500 <> 7 THEN (o_custkey + 1)::INTEGER END AS usuario_id,
    CASE WHEN o_orderkey % 200 = 3 THEN NULL WHEN o_orderkey % 1000 = 5 THEN -(o_totalprice::DECIMAL(14,2)) ELSE o_totalprice::DECIMAL(14,2) END::DECIMAL(14,2) AS monto,
    CASE WHEN o_orderkey % 1000 IN (13, 213, 613) THEN NULL
         WHEN o_orderkey % 1000 = 117 THEN chr(9) || {_KIND} || chr(10)
         WHEN o_orderkey % 100 = 17 THEN '  ' || {_KIND} || ' '
         WHEN o_orderkey % 100 = 19 THEN lower({_KIND})
         WHEN o_orderkey % 1000 = 21 THEN 'CRIPTO' ELSE {_KIND} END AS tipo_transaccion,
    CASE WHEN o_orderkey % 100 = 23 THEN NULL WHEN o_orderkey % 1000 = 29 THEN 'EN_REVISION' ELSE {_STATE} END AS estado
  FROM orders
), raw AS (
  SELECT * FROM base UNION ALL
  SELECT src_id, 1, id, fecha, usuario_id, coalesce(monto, 1.00)::DECIMAL(14,2), tipo_transaccion, estado FROM base WHERE src_id % 1000 IN (31, 203)
)"""

_NORMAL_SQL = f"""{_RAW_SQL}, normal AS (
  SELECT src_id, seq, id, fecha, usuario_id, monto,
    upper(regexp_replace(tipo_transaccion, '^\\s+|\\s+$', '', 'g')) AS tipo_transaccion,
    coalesce(upper(regexp_replace(estado, '^\\s+|\\s+$', '', 'g')), '{DEFAULT_STATE}') AS estado
  FROM raw
)"""

_EVALUATED_SQL = f"""{_NORMAL_SQL}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq, src_id) AS nth FROM normal
), evaluated AS (
  SELECT *, CASE WHEN id IS NULL THEN '{REASONS[0]}' WHEN nth > 1 THEN '{REASONS[1]}' WHEN usuario_id IS NULL THEN '{REASONS[2]}'
    WHEN fecha IS NULL THEN '{REASONS[3]}' WHEN monto IS NULL THEN '{REASONS[4]}' WHEN monto <= 0 THEN '{REASONS[5]}'
    WHEN tipo_transaccion IS NULL THEN '{REASONS[6]}' WHEN tipo_transaccion NOT IN {_IN(TYPES)} THEN '{REASONS[7]}'
    WHEN estado NOT IN {_IN(STATES)} THEN '{REASONS[8]}' END AS motivo_rechazo
  FROM numbered
), fact AS (
  SELECT id, fecha, usuario_id, monto,
    (monto - ((((monto * 100)::BIGINT * CASE tipo_transaccion {' '.join(f"WHEN '{k}' THEN {int(v * 10000)}" for k, v in RATES.items())} END + 5000) // 10000)::DECIMAL(16,0) / 100)::DECIMAL(14,2))::DECIMAL(14,2) AS monto_neto,
    tipo_transaccion, estado
  FROM evaluated WHERE motivo_rechazo IS NULL
)"""

_SUM_JSON = "'\"total_transacciones\":' || total_transacciones || ',\"monto_total\":' || monto_total || ',\"monto_neto_total\":' || monto_neto_total"
_SUMS = "count(*) AS total_transacciones, coalesce(sum(monto), 0)::DECIMAL(20,2) AS monto_total, coalesce(sum(monto_neto), 0)::DECIMAL(20,2) AS monto_neto_total"

_REQUESTS_SQL = f"""asked AS (
  SELECT c_custkey AS request_id, (c_custkey + 1)::VARCHAR AS usuario_id,
    CASE WHEN c_custkey % 7 <> 0 THEN (3 + c_custkey % 8)::VARCHAR END AS "limit", CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 4)::VARCHAR END AS "offset" FROM customer
  UNION ALL VALUES {', '.join('(' + ', '.join('NULL' if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ')' for r in ODD_REQUESTS)}
), parsed AS (
  SELECT request_id, coalesce(try_cast(usuario_id AS HUGEINT) BETWEEN 1 AND {serving.MOST_USER}, false)
     AND ("limit" IS NULL OR coalesce(try_cast("limit" AS HUGEINT) BETWEEN 1 AND {serving.MOST_LIMIT}, false))
     AND ("offset" IS NULL OR coalesce(try_cast("offset" AS HUGEINT) BETWEEN 0 AND {serving.MOST_OFFSET}, false)) AS valid,
    try_cast(usuario_id AS HUGEINT) AS usuario_id, coalesce(try_cast("limit" AS HUGEINT), {serving.DEFAULT_LIMIT}) AS lim, coalesce(try_cast("offset" AS HUGEINT), 0) AS off FROM asked
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY usuario_id ORDER BY fecha DESC, id DESC) AS rn FROM fact
), pages AS (
  SELECT r.request_id, t.* FROM parsed r JOIN ranked t ON r.usuario_id = t.usuario_id AND t.rn > r.off AND t.rn <= r.off + r.lim WHERE r.valid
), sizes AS (
  SELECT r.request_id, r.valid, r.off, count(p.id) AS cantidad FROM parsed r LEFT JOIN pages p ON p.request_id = r.request_id GROUP BY ALL
)"""

_CHECKS = {f"not_null_{c}": f"{c} IS NULL" for c in FACT.names} | {
    "monto_positivo": "monto <= 0",
    "neto_en_rango": "monto_neto < 0 OR monto_neto > monto",
    "tipo_en_dominio": f"tipo_transaccion NOT IN {_IN(TYPES)}",
    "estado_en_dominio": f"estado NOT IN {_IN(STATES)}",
}
_LOG_AGG = "count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, min(value) AS \"min\", max(value) AS \"max\", round(median(value), 6) AS median, " + ", ".join(
    f"round(quantile_cont(value, {p}), 6) AS {name}" for name, p in request_log.PERCENTILES.items()
) + ", round(avg(value), 6) AS mean, round(avg(length(props)), 6) AS mean_size, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1e6, 4) AS rps"

_DIGITS = "CASE WHEN abs(value) < 10 THEN round(value, 2) WHEN abs(value) < 100 THEN round(value, 1) WHEN abs(value) < 1000 THEN round(value, 0) WHEN abs(value) < 10000 THEN round(value, -1) WHEN abs(value) < 100000 THEN round(value, -2) ELSE round(value, -3) END"
_HISTORY_SQL = f"""WITH log AS (
  SELECT event_type AS name, value, {_DIGITS} AS bucket, length(props) AS size, event_type = 'error' AS failed, date_trunc('hour', ts) AS pane FROM events
), both_ AS (
  SELECT 0 AS every, * FROM log UNION ALL SELECT 1, NULL, value, bucket, size, failed, pane FROM log
), wide AS (
  SELECT *, unnest([pane, pane - INTERVAL 1 HOUR]) AS desde FROM both_
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY every, name, desde ORDER BY bucket) AS nth, count(value) OVER (PARTITION BY every, name, desde) AS n FROM wide
), told AS (
  SELECT every, name, desde, desde + INTERVAL 2 HOUR AS hasta, count(*) AS requests, count(*) FILTER (failed) AS failures, round(count(*) / 7200.0::DOUBLE, 6) AS rps, round(count(*) FILTER (failed) / 7200.0::DOUBLE, 6) AS fps,
    {', '.join(f'min(bucket) FILTER (nth * 10000 >= n * {p}) AS {k}' for k, p in request_log.HISTORY.items())} FROM ranked GROUP BY 1, 2, 3
)
SELECT t.*, count(*) AS total_requests, count(*) FILTER (b.failed) AS total_failures, round(avg(b.value) + 1e-9::DOUBLE, 6) AS total_mean, min(b.value) AS total_min, max(b.value) AS total_max, round(avg(b.size) + 1e-9::DOUBLE, 6) AS total_mean_size
FROM told t JOIN both_ b ON b.every = t.every AND b.name IS NOT DISTINCT FROM t.name AND b.pane + INTERVAL 1 HOUR <= t.hasta GROUP BY ALL"""
_MD5 = lambda salt: f"('0x' || substr(md5('42:{salt}:' || o_orderkey), 1, 8))::BIGINT"

_REPORT_SQL = """SELECT count(*) AS filas_leidas, count(*) FILTER (motivo_rechazo IS NULL) AS filas_aceptadas, count(*) FILTER (motivo_rechazo IS NOT NULL) AS filas_rechazadas,
  round(100.0 * count(*) FILTER (motivo_rechazo IS NOT NULL) / count(*), 2)::DOUBLE AS porcentaje_rechazado,
  (SELECT string_agg(motivo_rechazo || '=' || n, ',' ORDER BY motivo_rechazo) FROM (SELECT motivo_rechazo, count(*) AS n FROM evaluated WHERE motivo_rechazo IS NOT NULL GROUP BY 1)) AS por_motivo
FROM evaluated"""

ORACLE: dict[str, str] = {
    "normalized_transactions": f"WITH {_NORMAL_SQL} SELECT src_id, seq, tipo_transaccion, estado FROM normal",
    "rejection_reasons": f"WITH {_EVALUATED_SQL} SELECT src_id, seq, motivo_rechazo FROM evaluated",
    "accepted_transactions": f"WITH {_EVALUATED_SQL} SELECT * FROM fact ORDER BY usuario_id, fecha, id",
    "rejected_transactions": f"WITH {_EVALUATED_SQL} SELECT {', '.join(RAW.names)}, motivo_rechazo FROM evaluated WHERE motivo_rechazo IS NOT NULL",
    "reject_counts": f"WITH {_EVALUATED_SQL} SELECT motivo_rechazo, count(*) AS filas FROM evaluated WHERE motivo_rechazo IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1",
    "control_totals": f"WITH {_EVALUATED_SQL} SELECT {_SUMS} FROM fact",
    "summary_by_type": f"WITH {_EVALUATED_SQL} SELECT tipo_transaccion, {_SUMS} FROM fact GROUP BY ROLLUP (tipo_transaccion) ORDER BY tipo_transaccion NULLS FIRST",
    "summary_document": f"WITH {_EVALUATED_SQL}, s AS (SELECT tipo_transaccion, {_SUMS} FROM fact GROUP BY ROLLUP (tipo_transaccion)) SELECT '{{' || max({_SUM_JSON}) FILTER (tipo_transaccion IS NULL) || ',\"por_tipo\":[' || coalesce(string_agg('{{\"tipo_transaccion\":\"' || tipo_transaccion || '\",' || {_SUM_JSON} || '}}', ',' ORDER BY tipo_transaccion) FILTER (tipo_transaccion IS NOT NULL), '') || ']}}' AS documento FROM s",
    "history_json": f"WITH {_EVALUATED_SQL}, {_REQUESTS_SQL}, rows AS (SELECT request_id, string_agg('{{\"id\":' || id || ',\"fecha\":\"' || strftime(fecha, '%Y-%m-%dT%H:%M:%S.%f') || '\",\"monto\":' || monto || ',\"monto_neto\":' || monto_neto || ',\"tipo_transaccion\":\"' || tipo_transaccion || '\",\"estado\":\"' || estado || '\"}}', ',' ORDER BY rn) AS filas, count(*) AS n FROM pages GROUP BY 1) SELECT p.request_id, '{{\"usuario_id\":' || p.usuario_id || ',\"cantidad\":' || coalesce(n, 0) || ',\"limit\":' || lim || ',\"offset\":' || off || ',\"transacciones\":[' || coalesce(filas, '') || ']}}' AS documento FROM parsed p LEFT JOIN rows r ON r.request_id = p.request_id WHERE p.valid",
    "user_history_page": f"WITH {_EVALUATED_SQL} SELECT {', '.join(serving.PAGE)} FROM fact WHERE usuario_id = {PAGE_USER} ORDER BY fecha DESC, id DESC LIMIT {PAGE_LIMIT} OFFSET {PAGE_OFFSET}",
    "history_batch": f"WITH {_EVALUATED_SQL}, {_REQUESTS_SQL} SELECT request_id, usuario_id, rn, {', '.join(serving.PAGE)} FROM pages",
    "history_page_counts": f"WITH {_EVALUATED_SQL}, {_REQUESTS_SQL} SELECT request_id, cantidad FROM sizes WHERE valid",
    "request_status": f"WITH {_EVALUATED_SQL}, {_REQUESTS_SQL} SELECT request_id, CASE WHEN NOT valid THEN 422 WHEN cantidad = 0 AND off = 0 THEN 404 ELSE 200 END::INTEGER AS status FROM sizes",
    "busiest_user": f"WITH {_EVALUATED_SQL} SELECT usuario_id, count(*) AS total FROM fact GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "constraint_report": f"WITH {_NORMAL_SQL}, f AS (SELECT id, fecha, usuario_id, monto, monto AS monto_neto, tipo_transaccion, estado FROM normal) "
    + " UNION ALL ".join(f"SELECT '{k}' AS restriccion, count(*) FILTER ({v}) AS violaciones FROM f" for k, v in _CHECKS.items())
    + " UNION ALL SELECT 'id_unico', count(*) FROM (SELECT id FROM f WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1)",
    "source_profile": f"WITH {_RAW_SQL} SELECT count(*) AS filas, {', '.join(f'count(*) FILTER ({c} IS NULL) AS nulos_{c}' for c in RAW.names)}, count(*) - count(DISTINCT id) - max((id IS NULL)::INTEGER) AS ids_repetidos, count(*) FILTER (monto <= 0) AS montos_no_positivos FROM raw",
    "source_head": f"WITH {_RAW_SQL} SELECT {', '.join(RAW.names)} FROM raw WHERE seq = 0 ORDER BY id NULLS LAST LIMIT 5",
    "summary_consistency": f"WITH {_EVALUATED_SQL}, s AS (SELECT tipo_transaccion, {_SUMS} FROM fact GROUP BY ROLLUP (tipo_transaccion)) SELECT "
    + ", ".join(f"sum({c}) FILTER (tipo_transaccion IS NOT NULL) = sum({c}) FILTER (tipo_transaccion IS NULL) AS {n}" for c, n in (("total_transacciones", "conteo_cuadra"), ("monto_total", "monto_cuadra"), ("monto_neto_total", "neto_cuadra")))
    + ", bool_and(monto_neto_total <= monto_total) AS neto_no_excede FROM s",
    "reconciliation": f"WITH {_EVALUATED_SQL} SELECT {_SUMS} FROM fact",
    "csv_round_trip": f"WITH {_EVALUATED_SQL} SELECT * FROM fact",
    "published_snapshot": f"WITH {_EVALUATED_SQL} SELECT * FROM fact",
    "synthetic_uniforms": "SELECT o_orderkey AS clave, ('0x' || substr(md5('42:type:' || o_orderkey), 1, 8))::BIGINT AS tipo_u, ('0x' || substr(md5('42:state:' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 < 0.9 AS completada FROM orders",
    "schema_description": f"WITH {_EVALUATED_SQL} "
    + " UNION ALL ".join(f"SELECT {i + 1} AS posicion, '{f.name}' AS columna, '{'timestamp_ntz' if f.name == 'fecha' else f.dataType.simpleString()}' AS tipo, false AS admite_nulos, count({f.name}) AS no_nulos FROM fact" for i, f in enumerate(FACT.fields)),
    "request_log_report": f"SELECT event_type AS name, {_LOG_AGG} FROM events GROUP BY ROLLUP (event_type)",
    "request_log_series": "SELECT date_trunc('hour', ts) AS desde, date_trunc('hour', ts) + INTERVAL 1 HOUR AS hasta, count(*) AS requests, count(*) FILTER (event_type = 'error') AS failures, max(value) AS max_latency FROM events GROUP BY 1, 2",
    "request_log_history": _HISTORY_SQL,
    "order_sample": f"SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY {_MD5('sample')}, o_orderkey) <= floor(count(*) OVER () * 0.001)",
    "order_sample_by_price": f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln(({_MD5('draw')} + 0.5) / 4294967296.0::DOUBLE) / o_totalprice::DOUBLE, o_orderkey LIMIT 100",
    "run_report": f"WITH {_EVALUATED_SQL} {_REPORT_SQL}",
}
