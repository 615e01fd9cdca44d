"""Document fingerprints: improbable byte features in chained Bloom filters, compared by overlap.

Every window of ``WINDOW`` bytes has an entropy; windows whose entropy is rare in ordinary data get a
low rank (are preferred), those of very low or very high entropy none. A window that holds the smallest
rank of at least ``POPULAR`` of the neighbourhoods of ``WINDOW`` successive windows it lies in is selected.
Selected features are inserted, in reading order, into Bloom filters of ``FILTER_BITS`` bits; after
``PER_FILTER`` features the next filter begins. The fingerprint is the base64 text of the chain, with
each filter's number of features before it.

Likeness of two fingerprints: each filter of either chain is held against its best match in the other;
the shared bits above those expected by chance are normalised by the most there could be; the mean over
both chains is taken, weighted by features.

Defined cases: a null text is empty; texts of under ``SHORT`` bytes give every window of ``SHORT_WINDOW``
bytes, shorter ones one feature, the whole text (empty: an empty chain). Equal fingerprints have likeness 1, also two empty ones; an empty and a
non-empty one 0. Rows that share a doc_id are ordered by the hash of their text; null ids come last of all. A single
document is its own next one. A text is read whole: its features and one block of filters take memory in
proportion to it, the comparison of two chains time in proportion to the product of their filters.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, mix64, table, text_slices, tidy

WINDOW, POPULAR, USUAL = 32, 8, 690
#: A text of fewer bytes than SHORT gives all its windows of SHORT_WINDOW bytes: selection would leave too few.
SHORT, SHORT_WINDOW = 160, 8
FILTER_BITS, HASHES, PER_FILTER = 2048, 5, 160
BLOCK = 1 << 15
#: Filters of either chain that are compared at once.
TILE = 256
#: x log2 x for a count of x bytes in a window, in units of 1/1024, so that sums are exact.
_XLOGX = np.array([0, *(round(1024 * x * np.log2(x)) for x in range(1, WINDOW + 1))], np.int32)
_GAIN = np.diff(_XLOGX, prepend=0).astype(np.int32)
LEVELS = 1000
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
#: Rows are finished together once they hold so many bytes.
TOGETHER = 1 << 18


def ranks_by_entropy() -> np.ndarray:
    """The rank of each entropy level from 0 to LEVELS (0: never selected). Windows with 100 to 990
    thousandths of the largest entropy may be selected; those of running text lie near ``USUAL``, and the
    further from there, the rarer and the lower (better) the rank."""
    level = np.arange(LEVELS + 1)
    rank = 1000 - np.minimum(999, np.abs(level - USUAL) * 2)
    return np.where((level < 100) | (level > 990), 0, rank).astype(np.int32)


RANKS = ranks_by_entropy()


def entropy_levels(x: np.ndarray) -> np.ndarray:
    """The entropy level of each window, from how often each entering and leaving byte stands in it.

    Sliding by one byte changes one count down and one up, so the sum of count x log2 count is a prefix
    sum of gains and losses; both come from counting equal bytes at distances below WINDOW. A window's
    level depends on its own bytes only, so texts may be joined and read in one go.
    """
    n = len(x)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    behind, ahead = np.ones(n, np.uint8), np.ones(n, np.uint8)
    for a in range(0, n, BLOCK):
        b = min(n, a + BLOCK)
        for d in range(1, WINDOW):
            lo = max(a, d)
            if lo < b:
                same = (x[lo:b] == x[lo - d : b - d]).view(np.uint8)
                behind[lo:b] += same
                ahead[lo - d : b - d] += same
    change = _GAIN[behind].astype(np.int64)
    change[WINDOW:] -= _GAIN[ahead[: n - WINDOW]]
    bits = np.log2(WINDOW) - np.cumsum(change)[WINDOW - 1 :] / (1024 * WINDOW)
    return np.clip(np.rint(bits * (LEVELS / np.log2(WINDOW))), 0, LEVELS).astype(np.int64)


def selected(levels: np.ndarray) -> np.ndarray:
    """Begins of the selected windows of one text, from its windows' levels."""
    rank = RANKS[levels]
    n = len(rank)
    # smallest (rank, place) of each neighbourhood, by doubling; ties go to the left
    best = np.where(rank > 0, rank, 1 << 20).astype(np.int64) << 32 | np.arange(n)
    width, span = 1, min(WINDOW, n)
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[: len(best) - step], best[step:])
        width += step
    popular = np.bincount(best & 0xFFFFFFFF, minlength=n)
    return np.flatnonzero((popular >= min(POPULAR, n)) & (rank > 0))


def feature_hashes(x: np.ndarray, at: np.ndarray, width: int = WINDOW) -> np.ndarray:
    if not len(at):
        return np.zeros(0, np.uint64)
    return mix64(((x[at[:, None] + np.arange(width)].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[:width]).sum(1, dtype=np.uint64))


def features(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Begins and hashes of every text's selected windows, all texts' entropies in one go."""
    levels = entropy_levels(np.frombuffer(b"".join(raws), np.uint8))
    out, at = [], 0
    for raw in raws:
        if len(raw) >= SHORT:
            begins, width = selected(levels[at : at + len(raw) - WINDOW + 1]), WINDOW
        else:
            begins, width = np.arange(max(0, len(raw) - SHORT_WINDOW + 1)), SHORT_WINDOW
        out.append((begins, feature_hashes(np.frombuffer(raw, np.uint8), begins, width)))
        at += len(raw)
    return out


def features_after_cut(raws: list[bytes], cuts: list[int], olds: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of texts that are as before up to byte ``cut``: a window at i is chosen by bytes up to
    i + 2 WINDOW - 2 only, so those well before the cut are kept and the rest is read anew."""
    # short texts, and those of which little is left behind the cut, are read from their beginning
    froms = [max(0, cut - 3 * WINDOW) if len(raw) - max(0, cut - 3 * WINDOW) >= SHORT and len(old) else 0 for raw, cut, (old, _) in zip(raws, cuts, olds, strict=True)]
    keeps = [max(0, cut - 2 * WINDOW + 2) if start else 0 for cut, start in zip(cuts, froms, strict=True)]
    out = []
    for (begins, hashes), start, keep, (old, old_hashes) in zip(features([r[f:] for r, f in zip(raws, froms, strict=True)]), froms, keeps, olds, strict=True):
        begins = begins + start
        new, before = begins >= keep, old < keep
        out.append((np.concatenate([old[before], begins[new]]), np.concatenate([old_hashes[before], hashes[new]])))
    return out


def chain_of(raw: bytes, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chain of filters (rows of packed bits) and the number of features in each."""
    if not raw:
        return np.zeros((0, FILTER_BITS // 8), np.uint8), np.zeros(0, np.int64)
    if not len(hashes):
        hashes = np.frombuffer(hashlib.sha256(raw).digest()[:8], np.uint64)
    # a feature that comes again anywhere in the text is taken once
    hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    number = -(-len(hashes) // PER_FILTER)
    bits = np.zeros((number, FILTER_BITS), bool)
    of = np.arange(len(hashes)) // PER_FILTER
    for k in range(HASHES):
        bits[of, ((hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    return np.packbits(bits, axis=1), np.bincount(of, minlength=number)


def fingerprint(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    return chain_of(raw, features([raw])[0][1])


def as_text(chain: tuple[np.ndarray, np.ndarray]) -> str:
    bits, number = chain
    return base64.b64encode(b"".join(int(c).to_bytes(2, "little") + b.tobytes() for b, c in zip(bits, number, strict=True))).decode()


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """0 to 1: how much of either chain's features the other holds, each filter against its best match."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if a[0].shape == b[0].shape and np.array_equal(a[0], b[0]):
        return 1.0
    best, best_other = np.zeros(len(a[0])), np.zeros(len(b[0]))
    # blocks of filters, so that chains of very long texts need little memory
    for i in range(0, len(a[0]), TILE):
        s = np.unpackbits(a[0][i : i + TILE], axis=1).astype(np.float32)
        for j in range(0, len(b[0]), TILE):
            t = np.unpackbits(b[0][j : j + TILE], axis=1).astype(np.float32)
            ones, others = s.sum(1)[:, None], t.sum(1)[None, :]
            chance = ones * others / FILTER_BITS
            score = np.clip((s @ t.T - chance) / np.maximum(1, np.minimum(ones, others) - chance), 0, 1)
            best[i : i + TILE] = np.maximum(best[i : i + TILE], score.max(1))
            best_other[j : j + TILE] = np.maximum(best_other[j : j + TILE], score.max(0))
    return float(((best * a[1]).sum() + (best_other * b[1]).sum()) / (a[1].sum() + b[1].sum()))


PLACE = "struct<absent: boolean, id: bigint, hash: bigint, row: bigint>"
#: Rows sampled for each part.
SAMPLED = 16
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return (text[:-n] + following[:n]) if n else text


def with_next(docs: DataFrame, rows_per_part: int = 1024, most_parts: int = 1 << 15) -> DataFrame:
    """Deals rows out in descending doc_id order, in parts that each also hold the row after their last.

    A row's place is (null id last, doc_id descending, hash of the text, number of the row in the scan), so
    no two rows share one, and null ids or one id repeated without end are split like any others. Part
    bounds are places in a sample of about ``SAMPLED`` rows a part; the first place of each part (one row a part)
    comes from an aggregate without texts, so texts are shuffled once. ``docs`` is scanned three times and
    has to give its rows in the same order each time, as files do. Columns: part, last (a copied row), place, doc_id, text.
    """
    total = docs.count()
    parts = min(most_parts, max(1, -(-total // rows_per_part)))
    absent = F.col("doc_id").isNull()
    place = F.struct(
        absent.alias("absent"),
        F.when(absent, F.lit(0)).otherwise(F.bitwise_not("doc_id")).alias("id"),
        F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = docs.withColumn("place", place)
    cuts = _cuts(placed, parts, SAMPLED * parts / total) if parts > 1 else []
    dealt = placed.withColumn("part", _part(cuts))
    heads = sorted((r["part"], r["head"]) for r in dealt.groupBy("part").agg(F.min("place").alias("head")).collect())
    # the first row of a part is also dealt to the part before it, the very first row to the last part
    rows = [(part, head, heads[i - 1][0]) for i, (part, head) in enumerate(heads)]
    first = docs.sparkSession.createDataFrame(rows, f"part int, head {PLACE}, before int")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("last"))
    copy = F.struct(F.col("before").alias("part"), F.lit(True).alias("last"))
    dealt = dealt.join(F.broadcast(first), "part")
    dealt = dealt.select(F.explode(F.when(F.col("place") == F.col("head"), F.array(own, copy)).otherwise(F.array(own))).alias("p"), "place", "doc_id", "text")
    return dealt.select("p.part", "p.last", "place", "doc_id", "text")


def _cuts(placed: DataFrame, parts: int, share: float) -> list[dict]:
    """Places that part the rows about evenly, in order: every so-many-th place of a sample by hash of the row's number."""
    chosen = F.pmod(F.xxhash64(F.col("place.row")), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)) + 1)
    sample = placed.where(chosen).select("place.*").toArrow()
    if not sample.num_rows:
        return []
    sample = sample.sort_by([(c, "ascending") for c in sample.column_names])
    return sample.take(np.unique(np.arange(1, parts) * sample.num_rows // parts)).to_pylist()


def _part(cuts: list[dict]) -> Column:
    """How many of the cuts a row's place has reached: first among every ``step``-th, then among those between."""
    if not cuts:
        return F.lit(0)

    def reached(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c <= F.col("place")))

    step = math.isqrt(len(cuts)) + 1
    every, all_ = (F.from_json(F.lit(json.dumps(c)), f"array<{PLACE}>") for c in (cuts[step - 1 :: step], cuts))
    coarse = reached(every) if len(cuts) >= step else F.lit(0)
    return coarse * step + reached(F.slice(all_, coarse * step + 1, step - 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by part, then in order, the copied row last: each row is finished with the row behind it
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for piece in text_slices(batch, limit=TOGETHER):
                for part, last, key, text in zip(*(piece.column(c).to_pylist() for c in ("part", "last", "doc_id", "text")), strict=True):
                    rows.append((part, last, key, text))
                    held += len(text)
                if held >= TOGETHER:
                    yield from _finished(rows)
                    rows, held = rows[-1:], 0
        yield from _finished(rows)

    dealt = with_next(docs)
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = dealt.repartition(width, "part").sortWithinPartitions("part", "last", "place")
    return ordered.select("part", "last", "doc_id", "text").mapInArrow(tidy(run), RESULT)


def _finished(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Results of all rows that have their next row behind them."""
    pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
    if not pairs:
        return
    raws = [r[3].encode() for r in rows]
    found = features(raws)
    chains = [chain_of(raw, f[1]) for raw, f in zip(raws, found, strict=True)]
    changed = [edited(rows[i][3], rows[i + 1][3]).encode() for i in pairs]
    cuts = [len(rows[i][3][: len(rows[i][3]) - len(rows[i][3]) // 3].encode()) for i in pairs]
    out = []
    for i, raw, (_, hashes) in zip(pairs, changed, features_after_cut(changed, cuts, [found[i] for i in pairs]), strict=True):
        chain, other = chains[i], chain_of(raw, hashes)
        out.append((rows[i][2], len(rows[i][3]), hashlib.sha256(raw).hexdigest(), as_text(chain), as_text(other), likeness(chain, other), likeness(chain, chains[i + 1])))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in RESULT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents_only(table(spark, sf_dir, "documents")))
