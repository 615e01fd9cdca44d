"""Sums of large arrays over all tasks: each task sends its own in blocks, which are added up in two levels.

However many tasks there are, a block is added row by row in bounded memory; the first level deals the
rows of a block out over ``SALTS`` keys, so no task reads what all tasks sent for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PARTS = "block long, salt int, wide boolean, part binary"
SALTS = 64
#: Values of a block.
BLOCK = 16_384


def send(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The blocks of a task's flat array that are not all zero; integers and floats of 4 bytes where they fit."""
    from pyspark import TaskContext

    context = TaskContext.get()
    salt = (context.partitionId() if context else 0) % SALTS
    whole = total.dtype.kind in "iu"
    wide = bool(whole and len(total) and total.max() >= 1 << 32)
    kind = ("<i8" if wide else "<u4") if whole else "<f4"
    starts = [a for a in range(0, len(total), BLOCK) if total[a : a + BLOCK].any()]
    parts = [total[a : a + BLOCK].astype(kind).tobytes() for a in starts]
    yield pa.RecordBatch.from_arrays(
        [pa.array([a // BLOCK for a in starts], pa.int64()), pa.array([salt] * len(starts), pa.int32()), pa.array([wide] * len(starts), pa.bool_()), pa.array(parts, pa.binary())],
        ["block", "salt", "wide", "part"],
    )


def summed(sent: DataFrame, size: int, whole: bool) -> np.ndarray:
    """The sum of what all tasks sent, as int64 (``whole``) or float64 of length ``size``."""
    narrow, broad = ("<u4", "<i8") if whole else ("<f4", "<f8")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), pa.array([True]), pa.array([total.tobytes()], pa.binary())], ["block", "salt", "wide", "part"])

        for batch in batches:
            for block, salt, wide, part in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "wide", "part")), strict=True):
                value = np.frombuffer(part, broad if wide else narrow).astype(broad)
                if key != (block, salt):
                    if key is not None:
                        yield done()
                    key, total = (block, salt), value
                else:
                    total = total + value
        if key is not None:
            yield done()

    width = max(1, int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = sent.repartition(width, "block", "salt").sortWithinPartitions("block", "salt").mapInArrow(add, PARTS)
    second = first.selectExpr("block", "0 as salt", "wide", "part").repartition(width, "block").sortWithinPartitions("block").mapInArrow(add, PARTS)
    out = np.zeros(size, broad)
    for r in second.collect():
        part = np.frombuffer(r["part"], broad)
        out[r["block"] * BLOCK : r["block"] * BLOCK + len(part)] = part
    return out
