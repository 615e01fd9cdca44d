"""Schemas, domains and rates, declared once."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
TOTAL = T.DecimalType(20, 2)

RAW = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("fecha", T.TimestampType()),
        T.StructField("usuario_id", T.IntegerType()),
        T.StructField("monto", MONEY),
        T.StructField("tipo_transaccion", T.StringType()),
        T.StructField("estado", T.StringType()),
    ]
)
FACT = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("fecha", T.TimestampType(), False),
        T.StructField("usuario_id", T.IntegerType(), False),
        T.StructField("monto", MONEY, False),
        T.StructField("monto_neto", MONEY, False),
        T.StructField("tipo_transaccion", T.StringType(), False),
        T.StructField("estado", T.StringType(), False),
    ]
)
REJECT = T.StructType([*RAW.fields, T.StructField("motivo_rechazo", T.StringType())])
SUMMARY = T.StructType(
    [
        T.StructField("tipo_transaccion", T.StringType()),
        T.StructField("total_transacciones", T.LongType()),
        T.StructField("monto_total", TOTAL),
        T.StructField("monto_neto_total", TOTAL),
    ]
)
#: As it is stored, with the time it was made at.
STORED_SUMMARY = T.StructType([*SUMMARY.fields, T.StructField("actualizado_en", T.TimestampType())])
#: Requests arrive as text, so that out-of-range values can be told apart.
REQUEST = T.StructType([T.StructField("request_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("usuario_id", "limit", "offset"))])

#: The domains, the default status, and the rate withheld for each type.
TYPES = ("COMPRA", "DEPOSITO", "RETIRO", "TRANSFERENCIA", "PAGO_SERVICIO")
STATES = ("COMPLETADA", "PENDIENTE", "FALLIDA", "REVERTIDA")
DEFAULT_STATE = "PENDIENTE"
RATES = {
    "COMPRA": Decimal("0.1600"),
    "PAGO_SERVICIO": Decimal("0.0500"),
    "RETIRO": Decimal("0.0150"),
    "TRANSFERENCIA": Decimal("0.0040"),
    "DEPOSITO": Decimal("0.0000"),
}
#: Rejection reasons in order of precedence.
REASONS = ("id_nulo", "duplicado", "usuario_nulo", "fecha_nula", "monto_nulo", "monto_no_positivo", "tipo_nulo", "tipo_desconocido", "estado_desconocido")
assert set(RATES) == set(TYPES)
