import pytest
from pyspark.sql import functions as F

LONG = "Word number token alpha beta gamma delta epsilon. " * 4000
ODD = [
    (1, None),
    (2, ""),
    (3, "   \n\t\n "),
    (4, LONG),
    (5, "A short text, nothing more."),
    (5, "A short text, nothing more."),
    (6, "A short text, nothing more."),
    (None, "A row without an id but with words in it."),
    (None, None),
    (7, "x" * 50_000),
    (8, "Ünïcödé 你好 emoji 🙂 and\x00nul sep"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(3)
    extra = {c: F.lit("clash") for c in ("score", "part", "n", "key", "token", "found", "vid", "root", "rank", "fingerprint", "lang", "source", "n_lines_", "u", "v", "g")}
    return rows.withColumns(extra).withColumn("n_chars", F.lit(None).cast("long"))


@pytest.fixture(scope="session")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def docs(spark, medium):
    return spark.read.parquet(f"{medium}/documents.parquet").cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
