"""Pure column expressions of the cleaning rules and of reproducible random numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.schema import DEFAULT_STATE, MONEY, RATES, STATES, TYPES


def stripped(c: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` would leave tabs and line feeds)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normal_type(c: Column) -> Column:
    return F.upper(stripped(c))


def normal_state(c: Column) -> Column:
    """Only a null takes the default; a blank stays blank and is unknown later."""
    return F.coalesce(F.upper(stripped(c)), F.lit(DEFAULT_STATE))


def rejection_reason(first: Column) -> Column:
    """The first reason that applies to a normalised row, null for none. ``first``: first row with its id."""
    rules = (
        (F.col("id").isNull(), "id_nulo"),
        (~first, "duplicado"),
        (F.col("usuario_id").isNull(), "usuario_nulo"),
        (F.col("fecha").isNull(), "fecha_nula"),
        (F.col("monto").isNull(), "monto_nulo"),
        (F.col("monto") <= 0, "monto_no_positivo"),
        (F.col("tipo_transaccion").isNull(), "tipo_nulo"),
        (~F.col("tipo_transaccion").isin(*TYPES), "tipo_desconocido"),
        (~F.col("estado").isin(*STATES), "estado_desconocido"),
    )
    (test, name), *rest = rules
    chain = F.when(test, F.lit(name))
    for test, name in rest:
        chain = chain.when(test, F.lit(name))
    return chain


def net_amount(amount: Column, kind: Column, wanted: Column | None = None) -> Column:
    """amount minus its withheld part, rounded half-up to cents in decimal arithmetic.

    A type without a rate is an error where ``wanted`` holds (everywhere by default).
    """
    rates = F.create_map(*(F.lit(x) for pair in RATES.items() for x in pair))
    rate = F.coalesce(F.element_at(rates, kind), F.raise_error(F.concat(F.lit("no rate for type "), F.coalesce(kind, F.lit("null")))).cast("decimal(5,4)"))
    net = (amount - F.round(amount * rate, 2)).cast(MONEY)
    return net if wanted is None else F.when(wanted, net)


def uniform(seed: int, salt: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed, salt and key alone, not on partitioning."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))

