"""Bounded samples of labelled documents, to fit the classifiers on the driver.

Rows are chosen by a hash, never by length; of a long text, ``WINDOWS`` windows spread evenly over it are
taken, so a sample's size on the driver is bounded by its number of rows times ``chars``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod

#: A text longer than the bound is read in so many windows.
WINDOWS = 4
#: Texts of all values of a column together, and values at most: the most frequent ones.
ALL_VALUES, MOST_VALUES = 20_000, 1000
#: Hashes that a task holds before it sends them on.
HELD = 1 << 20


def windowed(text: Column, chars: int) -> Column:
    """The text, or of a longer one than ``chars`` code points windows spread evenly from its first to its last, a line feed between."""
    size, each = F.length(text), chars // WINDOWS
    parts = [F.substring(text, F.floor((size - each) * k / (WINDOWS - 1)).cast("int") + 1, F.lit(each)) for k in range(WINDOWS)]
    return F.when(size <= chars, text).otherwise(F.concat_ws("\n", *parts))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: tuple[int, int], chars: int) -> list[tuple[str, int]]:
    """At most ``per_class`` documents of labels 0 and 1, in hash order among the ``usable`` rows that have both a text and a label.

    Rows with a null id, text or label never take part. Only ids are joined with all labels; the texts of
    the chosen ids, of fixed number, are then looked up.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    rows = rows.join(texts.select("doc_id"), "doc_id", "left_semi").distinct()
    order = F.xxhash64("doc_id", F.lit(11))
    ids = []
    for y in (0, 1):
        ids += [(r["doc_id"], y) for r in rows.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class[y]).collect()]
    if not ids:
        return []
    # at most the sum of per_class rows of two numbers: a bounded broadcast
    small = docs.sparkSession.createDataFrame(ids, "doc_id long, y int")
    found = texts.join(F.broadcast(small), "doc_id").select("doc_id", "y", windowed(F.col("text"), chars).alias("text"))
    out: list[tuple[str, int]] = []
    for y in (0, 1):
        out += [(r["text"], y) for r in found.where(F.col("y") == y).orderBy(order, "doc_id", "text").limit(per_class[y]).collect()]
    return out


def smallest_hashes(rows: DataFrame, count: int) -> DataFrame:
    """v, h: the ``count`` smallest different hashes of each value of ``rows`` (v string, h long).

    Each task keeps that many of a value, so neither repeated nor frequent texts are moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def send() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([v for v, h in held.items() for _ in range(len(h))], pa.string()), pa.array(np.concatenate([*held.values(), np.zeros(0, np.int64)]), pa.int64())], ["v", "h"])
            held.clear()
            return out

        for batch in batches:
            coded = batch.column("v").dictionary_encode()
            place, h = coded.indices.to_numpy(), batch.column("h").to_numpy()
            for k, v in enumerate(coded.dictionary.to_pylist()):
                held[v] = np.union1d(held.get(v, h[:0]), h[place == k])[:count]
            if sum(map(len, held.values())) > HELD:
                yield send()
        yield send()

    least = rows.mapInArrow(run, "v string, h long").distinct()
    return least.withColumn("nth", F.row_number().over(Window.partitionBy("v").orderBy("h"))).where(F.col("nth") <= count).select("v", "h")


def per_value_sample(docs: DataFrame, value: str, usable: Column, per_value: int, chars: int) -> dict[str, list[str]]:
    """The ``per_value`` different texts of each value of a column that come first by hash (fewer where there are so many
    values that all together would pass ``ALL_VALUES``). Every value is there, however frequent the others and however
    often its texts repeat; of more than ``MOST_VALUES`` values the most frequent are (ties: the first by name)."""
    rows = docs.where(F.col(value).isNotNull() & F.col("text").isNotNull() & usable).withColumn(value, F.col(value).cast("string"))
    known = [r[value] for r in rows.groupBy(value).count().orderBy(F.desc("count"), value).limit(MOST_VALUES).collect()]
    if not known:
        return {}
    per_value = min(per_value, max(1, ALL_VALUES // len(known)))
    keyed = rows.select(F.col(value).alias("v"), F.xxhash64("text").alias("h"), "text")
    few = smallest_hashes(keyed.where(F.col("v").isin(known)).select("v", "h"), per_value)
    # at most ALL_VALUES (or one for each value) rows of a value and a number
    small = docs.sparkSession.createDataFrame([(r["v"], r["h"]) for r in few.collect()], "v string, h long")
    texts = keyed.join(F.broadcast(small), ["v", "h"]).groupBy("v", "h").agg(F.min(windowed(F.col("text"), chars)).alias("text"))
    out: dict[str, list[str]] = {v: [] for v in sorted(known)}
    for r in texts.collect():
        out[r["v"]].append(r["text"])
    return {v: sorted(t) for v, t in out.items()}


def held_out(modulus: int, remainder: int) -> Column:
    return crc_mod(F.col("doc_id"), modulus) == remainder
