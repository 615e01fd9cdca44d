"""Normalise, find first occurrences, label each row with its first rejection reason, split, compute net amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import net_amount, normal_state, normal_type, rejection_reason
from ..sources.schema import FACT, RAW


def normalize(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"tipo_transaccion": normal_type(F.col("tipo_transaccion")), "estado": normal_state(F.col("estado"))})


def with_input_order(files: DataFrame) -> DataFrame:
    """Adds ``file`` and ``row`` of rows read from Parquet, which order them as they were written."""
    return files.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def repeated_ids(rows: DataFrame, order: list[str]) -> DataFrame:
    """__id, __least: the ids that come again and the first place of each, by partial minima over narrow columns."""
    found = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("__rows"), F.min(F.struct(*order)).alias("__least"))
    return found.where("__rows > 1").select(F.col("id").alias("__id"), "__least")


#: Bits of the map of repeated ids: 2^19 rows of 64 bits at most, whatever the batch's size.
MAP_BITS = 25
#: Words of 64 bits in one of the bitmaps that Spark's functions build.
WORDS = 1 << 9


def _place(id: Column) -> Column:
    """An id's bit in the map, from 0 on."""
    return F.pmod(F.xxhash64(id), F.lit(1 << MAP_BITS))


def repeated_map(again: DataFrame) -> DataFrame:
    """__word, __bits: the words of a map of hashed repeated ids that have a bit, of a size that does not grow.

    The bitmap functions number bits from 1 on and bytes from the left; a word's first byte is its highest.
    """
    at = again.select((_place(F.col("__id")) + 1).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    half = lambda i, k: F.conv(F.hex(F.substring(F.col("bits"), i * 8 + 1 + k, F.lit(4))), 16, 10).cast("bigint")
    words = maps.select("part", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.shiftleft(half(i, 0), 32).bitwiseOR(half(i, 4)))).alias("nth", "__bits"))
    return words.where("__bits <> 0").select(((F.col("part") - 1) * WORDS + F.col("nth")).alias("__word"), "__bits")


def with_maybe_repeated(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Adds ``__maybe``: false for null ids and for all ids that certainly come once."""
    place = _place(F.col("id"))
    # a row meets one number, never a whole bitmap, which would be copied for it
    met = rows.join(F.broadcast(repeated_map(again)), F.when(F.col("id").isNotNull(), F.shiftright(place, 6)) == F.col("__word"), "left")
    # bytes are numbered from a word's high end, the bits in them from the low end; a null id meets no word
    held = F.call_function("getbit", F.col("__bits"), place.bitwiseXOR(F.lit(56)).bitwiseAND(F.lit(63)).cast("int")) != 0
    return met.withColumn("__maybe", F.coalesce(held, F.lit(False))).drop("__word", "__bits")


def is_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate of the size is below the session's limit for broadcasts."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit


def mark_first(rows: DataFrame, order: list[str], again: DataFrame | None = None) -> DataFrame:
    """Adds ``__first``: whether a row is the first of its id in input order.

    Where the repeated ids are small enough to be sent to all tasks, no row moves. Otherwise a bitmap of them, of fixed
    size, tells the rows whose id certainly comes once: those, and all with a null id, stay where they are, and the
    others alone are shuffled to the list of repeated ids. A map that fills up lets more rows through; results are
    the same. Rows with a null id are first; nothing depends on it. ``again`` may hold ``repeated_ids`` read back
    from a file, whose size Spark knows.
    """
    again = repeated_ids(rows, order) if again is None else again
    first = F.col("__least").isNull() | (F.struct(*order) == F.col("__least"))

    def told(some: DataFrame) -> DataFrame:
        return some.join(again, some["id"] == again["__id"], "left").withColumn("__first", first).drop("__id", "__least")

    if is_small(again):
        return told(rows)
    split = with_maybe_repeated(rows, again)
    # true in each row; a literal would let filters on the reason sink below the join, in code too long to be compiled
    once = split.where("not __maybe").withColumn("__first", ~F.col("__maybe")).drop("__maybe")
    return once.unionByName(told(split.where("__maybe").drop("__maybe")))


def evaluate(raw: DataFrame, order: list[str], again: DataFrame | None = None) -> DataFrame:
    """The normalised rows with ``motivo_rechazo``; ``order`` names the columns that give input order.

    Duplicates are judged before validity: of several rows with an id only the first can be accepted,
    and if it is invalid all are rejected. ``again``: see ``mark_first``.
    """
    rows = mark_first(normalize(raw), order, again)
    return rows.withColumn("motivo_rechazo", rejection_reason(F.col("__first"))).drop("__first")


def accepted(evaluated: DataFrame) -> DataFrame:
    """The accepted rows in the fact's columns, net amount added."""
    ok = F.col("motivo_rechazo").isNull()
    return evaluated.where(ok).withColumn("monto_neto", net_amount(F.col("monto"), F.col("tipo_transaccion"), ok)).select(*FACT.names)


def rejected(evaluated: DataFrame) -> DataFrame:
    return evaluated.where(F.col("motivo_rechazo").isNotNull()).select(*RAW.names, "motivo_rechazo")
