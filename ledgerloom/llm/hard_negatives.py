"""Hard-negative mining by exact integer scores: residue-number-system matrix products, then windowed selection.

Vectors are whole numbers. For each of several small primes both matrices are reduced to centred residues and
multiplied in float32, in strips of the inner dimension so short that every sum stays below 2 ** 24 and is
exact. Chinese remaindering (mixed radix) gives the signed scores back; as many primes are taken as the
largest possible score of the two blocks needs.

1. Rows are packed into chunks, and the anchors among them, a stated query set, into blocks of ``ANCHORS``.
2. A block of anchors meets a group of ``GROUP`` chunks in a task of its own, so memory is bounded by the two
   sizes and work spreads over all pairs of blocks. Each sends its best rows of the anchor's label.
3. The best of all groups are an anchor's positives; their scores are packed beside its block.
4. In a second round of products each task sends the best rows of other labels inside each positive's window.

Scores rank downwards, ties by the smaller id. Nothing is approximate, sampled or capped.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; equal rows
(id, label, vector) count once; of rows that share an id only, each takes part by itself, and none is a
positive of a row with its own id; vectors of unequal length are filled up with zeros; a component beyond
``MOST`` counts as ``MOST`` and a score beyond a long as the largest long; positives that score below zero
have an empty window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table, tidy

#: Rows of a chunk, anchors of a block, chunks that meet a block in one task, rows multiplied at once.
CHUNK, ANCHORS, GROUP, TILE = 1000, 4096, 8, 512
#: Largest component.
MOST = 2.0**150
#: Sums of whole numbers up to here are exact in float32.
EXACT = 1 << 24
#: Scores below half of it can be multiplied by 100 in 64 bits.
WIDE = 1 << 55


def primes_below(n: int) -> list[int]:
    """All odd primes below ``n``, largest first."""
    return [p for p in range(n - 1, 2, -1) if all(p % q for q in range(2, int(p**0.5) + 1))]


PRIMES = primes_below(256)


def primes_for(bound: int) -> list[int]:
    """So many primes that their product tells all whole numbers from -bound to bound apart."""
    out, product = [], 1
    for p in PRIMES:
        if product > 2 * bound:
            break
        out.append(p)
        product *= p
    if product <= 2 * bound:
        raise OverflowError("scores are too large for the primes below 256")
    return out


def residues(m: np.ndarray, p: int) -> np.ndarray:
    """The matrix modulo p as float32, from -(p - 1) / 2 to (p - 1) / 2."""
    r = np.fmod(m, p)
    half = (p - 1) // 2
    return (r - p * (r > half) + p * (r < -half)).astype(np.float32)


def products_modulo(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p, from 0 to p - 1, as int32."""
    strip = EXACT // ((p - 1) // 2) ** 2
    total = np.zeros((len(a), len(b)), np.int32)
    for at in range(0, a.shape[1], strip):
        part = residues(a[:, at : at + strip], p) @ residues(b[:, at : at + strip], p).T
        total = (total + part.astype(np.int32)) % p
    return total


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers held as float64, exactly: int64, or Python's integers where ``WIDE`` is passed."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * int(np.abs(a).max()) * int(np.abs(b).max())
    primes = primes_for(bound)
    product = 1
    for p in primes:
        product *= p
    kind = np.int64 if product < WIDE else object
    digits: list[np.ndarray] = []
    for k, p in enumerate(primes):
        digit = products_modulo(a, b, p).astype(np.int64)
        for q, d in zip(primes[:k], digits, strict=True):  # the next digit of the mixed radix
            digit = (digit - d) * pow(q, -1, p) % p
        digits.append(digit)
    value = digits[-1].astype(kind)
    for p, d in zip(primes[-2::-1], digits[-2::-1], strict=True):
        value = value * p + d
    return np.where(value > product // 2, value - product, value)


CHUNKS = "chunk long, rows int, dim int, kind string, ids binary, labels binary, anchors binary, data binary"


def _pack(chunk: int, ids: np.ndarray, labels: np.ndarray, anchors: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
    """A chunk as one row, its rows in order of id; components in the narrowest type that holds them."""
    order = np.argsort(ids, kind="stable")
    top = np.abs(m).max(initial=0)
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<f8"
    values = (chunk, len(ids), m.shape[1], kind, ids[order].astype("<i8").tobytes(), labels[order].astype("<i8").tobytes(), anchors[order].astype(np.bool_).tobytes(), np.ascontiguousarray(m[order]).astype(kind).tobytes())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = np.frombuffer(row["data"], row["kind"]).astype(np.float64).reshape(row["rows"], row["dim"])
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8"), np.frombuffer(row["anchors"], np.bool_), m


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Several unpacked chunks as one, shorter vectors filled up with zeros."""
    dim = max((p[3].shape[1] for p in parts), default=0)
    wide = [np.pad(p[3], ((0, 0), (0, dim - p[3].shape[1]))) for p in parts]
    return tuple(np.concatenate(x) for x in (*([p[k] for p in parts] for k in range(3)), wide))


def _number() -> int:
    """A number that no other task of the job counts on from."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return (context.partitionId() if context else 0) << 32


def packed(rows: DataFrame) -> DataFrame:
    """Chunks of ``rows``: vec_id long, label long, anchor boolean, vector array<double> of whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _number()
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                vectors = part.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                m = np.zeros((part.num_rows, int(sizes.max(initial=0))))
                m[np.arange(m.shape[1]) < sizes[:, None]] = np.clip(vectors.flatten().to_numpy(zero_copy_only=False), -MOST, MOST)
                yield _pack(number, part.column("vec_id").to_numpy(), part.column("label").to_numpy(), part.column("anchor").to_numpy(zero_copy_only=False), m)
                number += 1

    return rows.select("vec_id", "label", "anchor", "vector").mapInArrow(tidy(run), CHUNKS)


def anchor_blocks(chunks: DataFrame) -> DataFrame:
    """The anchors of all chunks in blocks of up to ``ANCHORS``, in the form of chunks."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels, anchors, m = _unpack(row)
                if anchors.any():
                    yield _pack(row["chunk"], ids[anchors], labels[anchors], anchors[anchors], m[anchors])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, count = _number(), [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if held and count + row["rows"] > ANCHORS:
                    yield _pack(number, *_joined(held))
                    number, held, count = number + 1, [], 0
                held.append(_unpack(row))
                count += row["rows"]
        if held:
            yield _pack(number, *_joined(held))

    few = materialize(chunks.mapInArrow(tidy(only), CHUNKS), "anchors")
    count = few.agg(F.sum("rows")).first()[0] or 0
    return materialize(few.repartition(max(1, -(-count // ANCHORS))).mapInArrow(tidy(gather), CHUNKS), "blocks")


FOUND = "block long, place int, anchor_id long, nth int, vec_id long, score long"


def best(s: np.ndarray, ids: np.ndarray, fits: np.ndarray, count: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of ``s`` up to ``count`` of its fitting columns, best first: pairs of (rows, columns). ``ids`` ascend, so the
    first of equal scores has the smallest."""
    low = s.min(initial=0) - 1
    held = np.where(fits, s, low)
    row = np.arange(len(s))
    for _ in range(count):
        column = held.argmax(1)
        some = held[row, column] > low
        if not some.any():
            return
        yield row[some], column[some]
        held[row, column] = low


def _met(blocks: DataFrame, chunks: DataFrame, pick, count: int) -> DataFrame:
    """Every block with every group of chunks, in tasks of their own; ``pick(block row, anchors, rows, scores)``
    gives columns of finds, of which each task sends the best ``count`` for an anchor and ``nth``."""
    slots = (blocks.agg(F.max(_slot())).first()[0] or 0) + 1
    groups = max(1, -(-chunks.count() // GROUP))
    # the stated query set against all rows, in blocks: each block goes to every group, each chunk to every slot of blocks
    left = blocks.withColumnRenamed("chunk", "block").withColumn("slot", _slot("block")).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = chunks.withColumn("grp", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    width = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(width, "slot", "grp"), right.repartition(width, "slot", "grp")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        for block in a.to_pylist():
            ours = _unpack(block)
            for row in b.to_pylist():
                theirs = _unpack(row)
                dim = max(ours[3].shape[1], theirs[3].shape[1])
                mine, other = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (ours[3], theirs[3]))
                for at in range(0, len(other), TILE):
                    s = scores(mine, other[at : at + TILE])
                    out += pick(block, ours, tuple(x[at : at + TILE] for x in theirs), s)
        block, place, anchor, nth, vec, score = (np.concatenate([np.asarray(o[k], np.int64) for o in out]) if out else np.zeros(0, np.int64) for k in range(6))
        order = np.lexsort((vec, ~score, nth, place, block))
        key = np.stack([block, place, nth])[:, order]
        begins = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]) if len(order) else np.zeros(0, bool)
        at = np.arange(len(order))
        kept = order[at - np.maximum.accumulate(np.where(begins, at, 0)) < count]
        names, kinds = zip(*(c.split() for c in FOUND.split(", ")), strict=True)
        return pa.Table.from_arrays([pa.array(c[kept], pa.int64()).cast({"long": pa.int64(), "int": pa.int32()}[k]) for c, k in zip((block, place, anchor, nth, vec, score), kinds, strict=True)], list(names))

    return left.groupBy("slot", "grp").cogroup(right.groupBy("slot", "grp")).applyInArrow(run, FOUND)


def _slot(number: str = "chunk") -> Column:
    """The task that made a block: one or two blocks have the same."""
    return F.shiftright(F.col(number), 32).cast("int")


def _long(s: np.ndarray) -> np.ndarray:
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in s], np.int64) if s.dtype == object else s


def _first(found: DataFrame, keys: list[str], count: int) -> DataFrame:
    """Of each key's finds the best ``count``, ranked."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows marked ``anchor``.

    ``rows``: vec_id, label, anchor, vector (see ``packed``). A negative's score lies from ``low`` to ``high`` per
    cent of the positive's.
    """
    kept = rows.where("vec_id is not null and label is not null").select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.coalesce("anchor", F.lit(False)).alias("anchor"), "vector").distinct()
    chunks = materialize(packed(kept), "chunks")
    blocks = anchor_blocks(chunks)

    def same_label(block: dict, ours: tuple, theirs: tuple, s: np.ndarray) -> list:
        fits = (ours[1][:, None] == theirs[1]) & (ours[0][:, None] != theirs[0])
        return [(np.full(len(r), block["block"]), r, ours[0][r], r * 0, theirs[0][c], _long(s[r, c])) for r, c in best(s, theirs[0], fits, positives)]

    near = _first(_met(blocks, chunks, same_label, positives), ["block", "place"], positives)
    near = materialize(near.select("block", "place", "anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    def windows(key: tuple, t: pa.Table) -> pa.Table:
        values = np.stack([t.column(c).to_numpy().astype("<i8") for c in ("place", "nth", "positive_score")], 1)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([values.tobytes()], pa.binary())], ["block", "windows"])

    aimed = near.groupBy("block").applyInArrow(windows, "block long, windows binary")  # ANCHORS * positives rows a block
    wanted = blocks.join(aimed.withColumnRenamed("block", "chunk"), "chunk")

    def in_window(block: dict, ours: tuple, theirs: tuple, s: np.ndarray) -> list:
        aims = np.frombuffer(block["windows"], "<i8").reshape(-1, 3)
        out = []
        for nth in range(1, positives + 1):
            aim = aims[aims[:, 1] == nth]
            at, score = aim[:, 0], aim[:, 2]
            if np.abs(score.astype(float)).max(initial=0) >= WIDE // 2:
                score = score.astype(object)
            mine = s[at]
            floor, ceiling = -(-low * score // 100), high * score // 100  # whole scores from low % to high % of it
            fits = (ours[1][at][:, None] != theirs[1]) & (mine >= floor[:, None]) & (mine <= ceiling[:, None])
            for r, c in best(mine, theirs[0], fits.astype(bool), negatives):
                out.append((np.full(len(r), block["block"]), at[r], ours[0][at[r]], np.full(len(r), nth), theirs[0][c], _long(mine[r, c])))
        return out

    far = _first(_met(wanted, chunks, in_window, negatives), ["block", "place", "nth"], negatives)
    met = far.select("block", "place", "nth", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return near.join(met, ["block", "place", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_vectors(rows: DataFrame, vector: str, scale: float = 256.0) -> DataFrame:
    """``vector`` as array<double> of floor(scale * x), without rows whose vector is null or has a null or non-finite component."""
    each = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    good = rows.where(F.col(vector).isNotNull() & F.forall(vector, each))
    whole = lambda x: (lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y))(x.cast("double") * F.lit(scale))  # noqa: E731  larger ones are whole already
    return good.withColumn("vector", F.transform(vector, whole))


def relabelled(vec_id: Column, label: Column) -> Column:
    return F.when(F.pmod(vec_id, F.lit(7)) == 0, F.pmod(label + 1, F.lit(10))).otherwise(label)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = whole_vectors(rows, "embedding").select("vec_id", relabelled(F.col("vec_id"), F.col("label")).alias("label"), (F.pmod("vec_id", F.lit(50)) == 0).alias("anchor"), "vector")
    return hard_negatives(rows)


OP11_SQL = """WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), met AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_inner_product(a.v, b.v)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), near AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM met WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), far AS (
  SELECT n.*, m.vec_id AS negative_id, m.score AS negative_score FROM near n JOIN met m ON m.anchor_id = n.anchor_id AND NOT m.same AND 50 * positive_score <= 100 * m.score AND 100 * m.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INTEGER AS rank, negative_id, positive_score, negative_score
FROM far QUALIFY rank <= 3"""
