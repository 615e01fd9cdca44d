"""Summary documents and history pages, for one user or for a whole table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds and defaults of requests.
MOST_USER, MOST_LIMIT, DEFAULT_LIMIT, MOST_OFFSET = 2_147_483_647, 1000, 100, 2_147_483_647
#: Groups that a user's rows of one day are dealt over before they are ranked.
SALTS = 64
PAGE = ("id", "fecha", "monto", "monto_neto", "tipo_transaccion", "estado")
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def summary_document(summary: DataFrame) -> DataFrame:
    """The total and the list of types as one row, and as JSON text; an error where the total row is missing.

    A stored summary's ``actualizado_en`` comes along.
    """
    kind = F.col("tipo_transaccion")
    sums = ("total_transacciones", "monto_total", "monto_neto_total")
    entry = F.struct(kind.alias("tipo_transaccion"), *sums)
    total = lambda c: F.max(F.when(kind.isNull(), F.col(c))).alias(c)
    made = ["actualizado_en"] if "actualizado_en" in summary.columns else []
    out = summary.agg(*(total(c) for c in (*sums, *made)), F.sort_array(F.collect_list(F.when(kind.isNotNull(), entry))).alias("por_tipo"))
    out = out.withColumn("total_transacciones", F.coalesce("total_transacciones", F.raise_error(F.lit("the summary has no total row")).cast("bigint")))
    return out.withColumn("documento", F.to_json(F.struct(*sums, *made, "por_tipo"), JSON_TIME))


def history_page(fact: DataFrame, user: int, limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """One user's page, newest first: a pushed filter and a bounded top-k."""
    return fact.where(F.col("usuario_id") == user).orderBy(F.desc("fecha"), F.desc("id")).offset(offset).limit(limit).select(*PAGE)


def parse_requests(requests: DataFrame) -> DataFrame:
    """request_id, usuario_id, limit, offset as numbers (defaults filled in), and ``valid``."""
    user, limit, offset = (F.col(c).try_cast("decimal(38,0)") for c in ("usuario_id", "limit", "offset"))
    whole = lambda c: F.col(c).rlike(r"^\s*[+-]?\d+\s*$")
    # a number that is too long for the cast is out of range as well
    good = lambda c, value, low, high: F.coalesce(whole(c) & value.between(low, high), F.lit(False))
    valid = (
        good("usuario_id", user, 1, MOST_USER)
        & (F.col("limit").isNull() | good("limit", limit, 1, MOST_LIMIT))
        & (F.col("offset").isNull() | good("offset", offset, 0, MOST_OFFSET))
    )
    return requests.select(
        "request_id",
        F.when(valid, user.cast("int")).alias("usuario_id"),
        F.when(valid, F.coalesce(limit.cast("int"), F.lit(DEFAULT_LIMIT))).alias("limit"),
        F.when(valid, F.coalesce(offset.cast("int"), F.lit(0))).alias("offset"),
        valid.alias("valid"),
    )


def touched_days(fact: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, usuario_id, __from, __to (ranks), and each day that the page touches with the number of newer rows."""
    valid = parse_requests(requests).where("valid")
    day = F.to_date("fecha").alias("__day")
    days = fact.join(valid.select("usuario_id").distinct(), "usuario_id", "left_semi").groupBy("usuario_id", day).agg(F.count("*").alias("__rows"))
    upto = F.sum("__rows").over(Window.partitionBy("usuario_id").orderBy(F.desc("__day")))
    sums = days.select("usuario_id", "__day", (upto - F.col("__rows")).alias("__newer"), upto.alias("__upto"))
    r = valid.select("request_id", "usuario_id", F.col("offset").cast("long").alias("__from"), (F.col("offset").cast("long") + F.col("limit")).alias("__to"))
    return r.join(sums, "usuario_id").where("__newer < __to and __upto > __from").drop("__upto")


def history_rows(fact: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, rn and the page's columns for each row of each valid request's page.

    Counted order statistics: a user's rows are counted by day before they move, and running sums of the counts, newest
    day first, tell the days that a page touches. Rows of those days alone are read and ranked, each day by itself,
    so a far offset moves no newer row.
    """
    touched = touched_days(fact, requests)
    # how far each day must be ranked
    reach = touched.groupBy("usuario_id", "__day").agg(F.max(F.col("__to") - F.col("__newer")).alias("__most"))
    read = fact.withColumn("__day", F.to_date("fecha")).join(reach, ["usuario_id", "__day"]).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    newest = (F.desc("fecha"), F.desc("id"))
    near = read.withColumn("__nth", F.row_number().over(Window.partitionBy("usuario_id", "__day", "__salt").orderBy(*newest))).where("__nth <= __most")
    ranked = near.withColumn("__nth", F.row_number().over(Window.partitionBy("usuario_id", "__day").orderBy(*newest))).where("__nth <= __most").select("usuario_id", "__day", "__nth", *PAGE)
    met = touched.join(ranked, ["usuario_id", "__day"]).withColumn("rn", (F.col("__newer") + F.col("__nth")).cast("int"))
    return met.where("rn > __from and rn <= __to").select("request_id", "usuario_id", "rn", *PAGE)


def history_counts(fact: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, cantidad (the page's size) and status: 422 invalid, 404 no row and no offset, else 200.

    A page's size follows from the user's number of rows, which is counted once, before rows move.
    """
    parsed = parse_requests(requests)
    rows = fact.groupBy("usuario_id").agg(F.count("*").alias("__rows"))
    met = parsed.join(rows, "usuario_id", "left")
    cantidad = F.least(F.col("limit").cast("bigint"), F.greatest(F.lit(0).cast("bigint"), F.coalesce("__rows", F.lit(0)) - F.col("offset")))
    status = F.when(~F.col("valid"), 422).when((cantidad == 0) & (F.col("offset") == 0), 404).otherwise(200)
    return met.select("request_id", F.when(F.col("valid"), cantidad).otherwise(0).cast("bigint").alias("cantidad"), status.cast("int").alias("status"))


def history_documents(fact: DataFrame, requests: DataFrame) -> DataFrame:
    """One row per valid request: its page as a nested list (newest first) and as JSON text."""
    rows = history_rows(fact, requests).groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct("rn", *PAGE))).alias("page"))
    joined = parse_requests(requests).where("valid").join(rows, "request_id", "left")
    kinds = dict(fact.select(*PAGE).dtypes)
    entry = "struct<" + ",".join(f"{c}:{kinds[c]}" for c in PAGE) + ">"
    pages = F.coalesce(F.transform("page", lambda x: F.struct(*(x[c].alias(c) for c in PAGE))), F.array().cast(f"array<{entry}>"))
    out = joined.select("request_id", "usuario_id", F.size(pages).cast("bigint").alias("cantidad"), "limit", "offset", pages.alias("transacciones"))
    return out.withColumn("documento", F.to_json(F.struct("usuario_id", "cantidad", "limit", "offset", "transacciones"), JSON_TIME))
