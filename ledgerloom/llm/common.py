"""Helpers that the training-data operators share: reading, materialising, batching and hashing text.

Conventions every operator follows: a null text counts as an empty text, a null ``doc_id`` is
carried through as null, extra columns of the input are ignored (only the named columns are
selected), and an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a task, so that numpy's temporaries stay small whatever a batch holds.
SLICE_BYTES = 1 << 19
#: Rows of whole texts, and bytes of them, that Spark hands to Python at once (a row is never cut).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; in local mode, where the session names none, a new one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes: texts are long, and
    the default is more than a worker should hold. Spark reads both settings when a lazy result runs, so they
    stay set; smaller ones are left alone."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).lower().removesuffix("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def documents_only(docs: DataFrame) -> DataFrame:
    """The two columns an operator on texts may see, nulls made empty."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch by rows so that each part holds about ``limit`` bytes of text (or one row)."""
    if not batch.num_rows:
        return
    _, offsets = raw_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the row offsets into them, without a copy."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: workers live on, and the next task may be another's."""

    @functools.wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def map_texts(docs: DataFrame, schema: str, build: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch] | pa.RecordBatch]], limit: int = SLICE_BYTES) -> DataFrame:
    """Applies ``build()``'s function to bounded slices of the rows of ``docs``, inside the scan's own tasks.

    ``build`` runs once per task, so state such as a tokenizer or a cache lives in the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = build()
        for batch in batches:
            for part in text_slices(batch, limit=limit):
                out = work(part)
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return docs.mapInArrow(tidy(run), schema)


# --- hashing of words, vectorised over all texts of a slice -----------------------------------

_RNG = np.random.default_rng(20240607)
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII white space: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[size] = (out[0], out[1])
    return _POWERS[size]


def mix64(h: np.ndarray) -> np.ndarray:
    """A finalising mixer (fixed odd multipliers), so that every bit depends on every input bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the words (runs without ASCII white space) of all rows."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    back = cut[cut > 0] - 1
    last[back] = inside[back]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix sums of one polynomial over the slice."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``width`` words inside a row (a shorter row gives one run of all its words).

    Returns the hashes and their row numbers, rows in order; repeated runs are not removed.
    """
    counts = np.bincount(rows, minlength=n_rows)
    total = len(words)
    acc = np.zeros(total, np.uint64)
    weight = np.uint64(1)
    for k in range(width):
        weight = np.uint64((int(weight) * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF) | np.uint64(1)
        acc[: total - k] += (words[k:] ^ (words[k:] >> np.uint64(29))) * weight
    firsts = np.cumsum(counts) - counts
    place = np.arange(total) - firsts[rows]
    whole = place + width <= counts[rows]
    out_h, out_r = mix64(acc[whole]), rows[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            h = int(counts[r])
            for w in words[firsts[r] : firsts[r] + counts[r]]:
                h = (h * _BASE + int(w) + 1) & 0xFFFFFFFFFFFFFFFF
            extra[i] = h
        out_h = np.concatenate([out_h, mix64(extra)])
        out_r = np.concatenate([out_r, short])
        order = np.argsort(out_r, kind="stable")
        out_h, out_r = out_h[order], out_r[order]
    return out_h, out_r
