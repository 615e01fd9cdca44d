"""Raw transactions derived from the order table by plain modular arithmetic, and inputs of the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import MONEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dirty batch in the raw schema plus ``src_id`` and ``seq``, which give its input order.

    ``fecha`` stays a time stamp without zone here, as in the tables.
    """
    k = F.col("o_orderkey")

    def every(modulus: int, *rest: int):
        return F.pmod(k, F.lit(modulus)).isin(*rest)

    kind = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "COMPRA")
        .when(F.col("o_orderpriority") == "2-HIGH", "DEPOSITO")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "RETIRO")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "TRANSFERENCIA")
        .otherwise("PAGO_SERVICIO")
    )
    state = F.when(every(100, 99), "REVERTIDA").when(F.col("o_orderstatus") == "F", "COMPLETADA").when(F.col("o_orderstatus") == "O", "PENDIENTE").otherwise("FALLIDA")
    amount = F.col("o_totalprice").cast(MONEY)
    rows = table(spark, sf_dir, "orders").select(
        k.alias("src_id"),
        F.lit(0).alias("seq"),
        F.when(~every(1000, 37), k).alias("id"),
        F.when(~every(1000, 11), F.col("o_orderdate")).alias("fecha"),
        F.when(~every(500, 7), (F.col("o_custkey") + 1).cast("int")).alias("usuario_id"),
        F.when(every(200, 3), F.lit(None)).when(every(1000, 5), -amount).otherwise(amount).cast(MONEY).alias("monto"),
        F.when(every(1000, 13, 213, 613), F.lit(None))
        .when(every(1000, 117), F.concat(F.lit("\t"), kind, F.lit("\n")))
        .when(every(100, 17), F.concat(F.lit("  "), kind, F.lit(" ")))
        .when(every(100, 19), F.lower(kind))
        .when(every(1000, 21), F.lit("CRIPTO"))
        .otherwise(kind)
        .alias("tipo_transaccion"),
        F.when(every(100, 23), F.lit(None)).when(every(1000, 29), F.lit("EN_REVISION")).otherwise(state).alias("estado"),
    )
    again = rows.where(F.pmod("src_id", F.lit(1000)).isin(31, 203)).withColumns({"seq": F.lit(1), "monto": F.coalesce("monto", F.lit("1.00").cast(MONEY))})
    return rows.unionByName(again)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History requests as text: one for each customer, by modular arithmetic, and some odd ones."""
    k = F.col("c_custkey")
    made = table(spark, sf_dir, "customer").select(
        k.alias("request_id"),
        (k + 1).cast("string").alias("usuario_id"),
        F.when(F.pmod(k, F.lit(7)) != 0, (3 + F.pmod(k, F.lit(8))).cast("string")).alias("limit"),
        F.when(F.pmod(k, F.lit(5)) != 0, F.pmod(k, F.lit(4)).cast("string")).alias("offset"),
    )
    odd = spark.createDataFrame(ODD_REQUESTS, "request_id long, usuario_id string, limit string, offset string")
    return made.unionByName(odd)


#: Bounds just passed and just kept, text that is no number, and nothing at all: request_id, usuario_id, limit, offset.
ODD_REQUESTS = [
    (-1, "2147483647", "1000", "0"),
    (-2, "2147483648", "7", None),
    (-3, "4", "1000", "2147483647"),
    (-4, "4", "7", "2147483648"),
    (-5, "-4", None, None),
    (-6, "4 4", None, None),
    (-7, "4", "7 rows", None),
    (-8, "4", "1001", "1"),
    (-9, "4", "", "2"),
    (-10, "5", "4", "50000"),
    (-11, None, "4", "4"),
    (-12, "88888888888888888888888888888888888888888888", None, None),
]
