"""A corpus pipeline of five stages: quality, line dedup, near duplicates, decontamination, packing.

Each stage is a function of (spark, docs, sf_dir) on all that the stage before kept; all but the last
return the columns of ``documents``. Rows with a null doc_id pass the stages that need an id unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, line_templates, packing, quality, similarity_join
from ledgerloom.llm.common import materialize, table

#: Documents that score lower are rejected.
QUALITY_THRESHOLD = 0.3
#: Near duplicates: words of a shingle, and the similarity as a ratio.
SHINGLE_WORDS, SIMILAR = 5, (80, 100)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")), QUALITY_THRESHOLD)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without recurring lines; one of which no word is left goes."""
    done = line_templates.dedup_lines(docs)
    cut = F.col("n_dropped") > 0
    kept = done.where(~cut | F.col("text").rlike(r"\S"))
    return kept.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return similarity_join.one_per_component(docs, SHINGLE_WORDS, *SIMILAR)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", benchmark_stage),
    ("pack", pack_stage),
]

#: SQL expresses none of the stages; they are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written once and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
