"""N-gram Jaccard join: a grouped prefix join on word shingles, exact at a rational threshold.

1. A fixed-size sketch of hashed shingle counts, summed over all documents, gives one global order of
   shingles, rare ones first. Any order is right; this one keeps frequent shingles out of prefixes.
2. Each document becomes its set's size, a 128-bit digest of the set and its *prefix*: the first
   n - ceil(t n) + 1 shingles in that order. Two sets that reach the threshold share a prefix shingle.
3. Documents with the same set form a class. Classes with the same prefix and size form a group; groups
   meet in the buckets of their prefix shingles.
4. In a small bucket all pairs that pass the size and position bounds are candidates. Of a bucket of over
   ``SMALL`` groups, those stay that the bounds let link to anything, and one leader, which stands in most
   buckets, is held against every member. Members are then linked to it, near it or far from it. Jaccard
   distance obeys the triangle inequality, so a linked and a far member cannot link: the bucket falls into
   (linked, near) and (near, far). A part that is one component needs no pair; in an open one of at most
   ``WHOLE`` members all pairs across components are candidates; a larger one is split by the next shared
   shingle, for sets that reach the threshold share the first ``level`` shingles of prefixes longer by as
   many. After ``LEVELS`` such rounds the rest is paired across components exhaustively.
5. Candidate group pairs are expanded to their classes. Parity bitmaps, a few bits a shingle, rule most
   of the unlike pairs out with certainty; the rest is verified on whole texts.

Shingles whose count stands out go to the large buckets at once, so no task reads all rows of one.

The result is each document's component, so pairs inside a component that is already connected may go
untested; there is no cap on partners or candidates.

Defined cases: texts without a word (null, empty) have 0 shingles and are their own component; fewer
words than a shingle has are one shingle; repeated rows are one class; the texts with words of rows that
share a doc_id count as one document, so whatever they link to is one component; a row with a null doc_id
belongs to the component of the rows with the same set, and has a null component where all of those are
null; an empty table gives no rows; other columns are ignored. One text must fit a task's memory (about 60
bytes for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks
from .common import LOWER, documents_only, map_texts, materialize, mix64, raw_bytes, shingle_hashes, table, text_slices, tidy, word_hashes, word_spans
from .graph import components

SKETCH_BITS = 21
#: Groups of a bucket whose pairs are all tried; most shingles that a bucket is split by.
SMALL, LEVELS = 16, 4
#: Members of an open part whose pairs across components are all tried.
WHOLE = 2048
#: A shingle whose sketch bucket counts so much, and so many times the mean, is hot.
HOT, HOT_MEANS = 512, 64


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text in ascending order, and each text's number of them."""
    data, offsets = raw_bytes(texts)
    data = LOWER[data]
    starts, ends, rows = word_spans(data, offsets)
    h, r = shingle_hashes(word_hashes(data, starts, ends), rows, len(texts), width)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[keep], np.bincount(r[keep], minlength=len(texts))


def sketch(rows: DataFrame, hashes, bits: int) -> np.ndarray:
    """Counts of the hashes by their upper ``bits`` bits, over all rows: a fixed size whatever the table's.

    ``hashes(batch)`` gives arrays of uint64 hashes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for part in hashes(batch):
                np.add.at(total, (part >> np.uint64(64 - bits)).astype(np.int64), 1)
        yield from blocks.send(total)

    return blocks.summed(rows.mapInArrow(tidy(count), blocks.PARTS), 1 << bits, True)


def order_ranks(docs: DataFrame, width: int, bits: int = SKETCH_BITS) -> tuple[np.ndarray, int]:
    """For each hash bucket a byte, larger where its shingles are more frequent, and the byte from which they are hot."""

    def hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (shingle_sets(p.column("text"), width)[0] for p in text_slices(batch))

    counts = sketch(docs.select("text"), hashes, bits)
    hot = max(HOT, HOT_MEANS * counts.sum() / len(counts))
    return np.floor(4 * np.log2(np.maximum(counts, 1))).astype(np.uint8), int(np.ceil(4 * np.log2(hot)))


DIGESTS = "doc_id long, n int, usual int, s1 long, s2 long, prefix_hash long, parity binary, prefix array<long>"


def parity_bitmaps(h: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each set a bitmap of 2 to 4 bits a member: bit i is the parity of the members whose hash ends in i.

    Two sets' bitmaps differ in no more bits than the sets differ in members.
    """
    size = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(size)])
    at = (h & np.repeat(size - 1, n).astype(np.uint64)).astype(np.int64) + np.repeat(ends[:-1], n)
    bits = np.packbits((np.bincount(at, minlength=ends[-1]) & 1).astype(bool), bitorder="little")
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends // 8).astype(np.int32)), pa.py_buffer(bits)])


def folded(bits: bytes, size: int) -> int:
    """A parity bitmap as it would be with ``size`` bytes."""
    value, length = int.from_bytes(bits, "little"), len(bits)
    while length > size:
        length //= 2
        value = (value >> 8 * length) ^ (value & ((1 << 8 * length) - 1))
    return value


def digests(docs: DataFrame, width: int, num: int, den: int, ranks: np.ndarray, hot: int, more: int = LEVELS - 1) -> DataFrame:
    """A row per document: its set's size and digest, the prefix and its hash, the parity bitmap. ``prefix`` has
    ``more`` shingles beyond the prefix proper; ``usual`` of its first ones are not hot."""
    bits = int(len(ranks)).bit_length() - 1

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            h, n = shingle_sets(part.column("text"), width)
            row = np.repeat(np.arange(len(n)), n)
            starts = np.cumsum(n) - n
            some = n > 0
            sums = []
            for salt in (0x1B873593, 0x7FEB352D):
                s = np.zeros(len(n), np.uint64)
                if len(h):
                    s[some] = np.add.reduceat(mix64(h ^ np.uint64(salt * 0x9E3779B1)), starts[some])
                sums.append(s.view(np.int64))
            rank = ranks[(h >> np.uint64(64 - bits)).astype(np.int64)]
            order = np.lexsort((h, rank, row))
            place = np.arange(len(h)) - starts[row]
            length = np.where(some, prefix_length(n, num, den), 0)
            usual = np.bincount(row[(rank[order] < hot) & (place < length[row])], minlength=len(n))
            kept = place < np.minimum(n, length + more)[row]
            prefix = h[order][kept]
            ends = np.concatenate([[0], np.cumsum(np.where(some, np.minimum(n, length + more), 0))])
            proper = place[kept] < length[row[kept]]
            weighted = mix64(prefix + place[kept].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * proper
            whole = n.astype(np.uint64)
            if len(prefix):
                whole[some] += np.add.reduceat(weighted, ends[:-1][some])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(prefix.view(np.int64)))
            columns = [part.column("doc_id"), pa.array(n, pa.int32()), pa.array(usual, pa.int32()), pa.array(sums[0]), pa.array(sums[1]), pa.array(mix64(whole).view(np.int64)), parity_bitmaps(h, n), lists]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "usual", "s1", "s2", "prefix_hash", "parity", "prefix"])

        return work

    return map_texts(docs, DIGESTS, build)


def prefix_length(n, num: int, den: int):
    """The number of shingles of which two sets that reach the threshold share one."""
    return n - (num * n + den - 1) // den + 1


def needed(a, b, num: int, den: int):
    """The smallest intersection of sets of sizes a and b that reaches the threshold."""
    return -(-(num * (a + b)) // (num + den))


PAIRS = "kind int, key long, g long, h long, n int, pos int"


def bucket_pairs(rows: DataFrame, num: int, den: int, small: int = SMALL, level: int = 1) -> DataFrame:
    """Rows of kind 0: candidate pairs (g, h) of the small buckets; of kind 1: the members of the others, h the root.

    ``rows``: key, g, n, pos, root; ``level`` shingles up to place ``pos`` of the prefix are shared in a bucket.
    Small are those of ``small`` members.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # rows of the last key of a batch, which may go on in the next
        large = None  # a key whose rows are already known to be too many
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "g", "n", "pos", "root")])
            if not rows.shape[1]:
                continue
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            begin = _runs(rows[0])[-1]
            last = rows[:, begin:]
            yield from _bucket_batch(rows[:, :begin], large, num, den, small, level)
            if begin:
                large = None
            if last.shape[1] > small or large == last[0, 0]:
                large = last[0, 0]
                yield from _emit(np.ones(last.shape[1], np.int64), last[0], last[1], last[4], last[2], last[3])
                held = last[:, :0]
            else:
                held = last
        if held is not None:
            yield from _bucket_batch(held, large, num, den, small, level)

    ordered = rows.select("key", "g", "n", "pos", "root").repartition(_width(rows), "key").sortWithinPartitions("key", "n", "g")
    return ordered.mapInArrow(tidy(run), PAIRS)


def _width(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Begins of the runs of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _emit(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(columns[0]):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["kind", "key", "g", "h", "n", "pos"])


def _bucket_batch(rows: np.ndarray, large, num: int, den: int, small: int, level: int) -> Iterator[pa.RecordBatch]:
    """All buckets of ``rows`` (key, g, n, pos, root; sorted by key, n, g), whole ones except that ``large`` was begun before."""
    key, g, n, pos, root = rows
    if not len(key):
        return
    begins = _runs(key)
    sizes = np.diff(np.append(begins, len(key)))
    size = np.repeat(sizes, sizes)
    big = (size > small) | (key == large if large is not None else False)
    yield from _emit(np.ones(big.sum(), np.int64), key[big], g[big], root[big], n[big], pos[big])
    # a row against the one ``gap`` places behind it in its bucket, which is no smaller
    place = np.arange(len(key)) - np.repeat(begins, sizes)
    found = []
    for gap in range(1, int(size[~big].max(initial=1))):
        i = np.flatnonzero(~big & (place + gap < size))
        if not len(i):
            break
        j = i + gap
        need = needed(n[i], n[j], num, den)
        ok = (den * n[i] >= num * n[j]) & (np.minimum(n[i] - pos[i], n[j] - pos[j]) + level - 1 >= need) & (root[i] != root[j])
        found.append(np.stack([np.minimum(g[i[ok]], g[j[ok]]), np.maximum(g[i[ok]], g[j[ok]])]))
    if found:
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        zero = pairs[0] * 0
        yield from _emit(zero, zero, pairs[0], pairs[1], zero, zero)


def compared(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v, star) by their parity bitmaps: ``near`` false where the threshold is not ruled out, true
    for pairs with a leader (``star``) whose distance may still be at most twice the largest of a link.
    Pairs that are left out are farther apart; none that reaches the threshold is lost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, near = [], []
            for star, nu, pu, nv, pv in zip(*(batch.column(c).to_pylist() for c in ("star", "n_u", "parity_u", "n_v", "parity_v")), strict=True):
                size = min(len(pu), len(pv))
                # the sets differ in so many members at least
                differ = max((folded(pu, size) ^ folded(pv, size)).bit_count(), abs(nu - nv))
                near.append(differ > nu + nv - 2 * needed(nu, nv, num, den))
                # distance: 2 differ / (nu + nv + differ); of a link 1 - num / den at most
                keep.append(not near[-1] or (star and 2 * differ * den <= 2 * (den - num) * (nu + nv + differ)))
            out = batch.select(["u", "v"]).append_column("near", pa.array(near, pa.bool_()))
            yield out.filter(pa.array(keep, pa.bool_()))

    side = lambda k: sets.select(F.col("vid").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"parity_{k}"))
    held = pairs.join(side("u"), "u").join(side("v"), "v").mapInArrow(tidy(run), "u long, v long, near boolean")
    return held.groupBy("u", "v").agg(F.min("near").alias("near"))


def verified(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) of vertices whose texts' sets reach the threshold. ``texts``: vid, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "text_u"):
                for piece in text_slices(part, "text_v"):
                    (hu, nu), (hv, nv) = shingle_sets(piece.column("text_u"), width), shingle_sets(piece.column("text_v"), width)
                    # the shared shingles of each row: equal neighbours in the sorted union
                    h = np.concatenate([hu, hv])
                    r = np.concatenate([np.repeat(np.arange(len(nu)), nu), np.repeat(np.arange(len(nv)), nv)])
                    order = np.lexsort((h, r))
                    h, r = h[order], r[order]
                    both = np.bincount(r[1:][(h[1:] == h[:-1]) & (r[1:] == r[:-1])], minlength=len(nu)) if len(h) else np.zeros(len(nu), np.int64)
                    linked = den * both >= num * (nu + nv - both)
                    yield pa.RecordBatch.from_arrays([piece.column("u"), piece.column("v")], ["u", "v"]).filter(pa.array(linked))

    left = texts.select(F.col("vid").alias("u"), F.col("text").alias("text_u"))
    right = texts.select(F.col("vid").alias("v"), F.col("text").alias("text_v"))
    # texts meet pair by pair: a leader's pairs are many rows with one key, which adaptive joins split
    return pairs.join(left, "u").join(right, "v").select("u", "v", "text_u", "text_v").mapInArrow(tidy(run), "u long, v long")


def _candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """vid, text of the wanted vertices: a fixed-size bitmap of their ids thins the texts out where they are read."""
    bitmap = np.packbits(sketch(wanted.select(_place(F.col("vid")).alias("p")), lambda b: [b.column("p").to_numpy().astype(np.uint64) << np.uint64(44)], 20) > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").to_numpy()
            hit = (bitmap[p >> 3] >> (7 - (p & 7)) & 1).astype(bool)
            if hit.any():
                yield batch.filter(pa.array(hit)).select(["vid", "text"])

    keyed = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("vid"), "text", _place(F.col("doc_id")).alias("p"))
    return keyed.mapInArrow(tidy(run), "vid long, text string").join(wanted, "vid", "left_semi")


def _place(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 44)


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, small: int = SMALL, levels: int = LEVELS, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; sets link at a Jaccard similarity of num / den or more."""
    docs = documents_only(docs)
    made = materialize(digests(docs, width, num, den, *order_ranks(docs, width), levels - 1), "digests")
    classes = materialize(_classes(made), "classes")
    roots = _roots(docs, made, classes, width, num, den, small, levels, whole).select(F.col("u").alias("vid"), F.col("v").alias("root"))
    named = classes.select("vid", "n", "s1", "s2", "named").join(roots, "vid", "left").select("n", "s1", "s2", F.when(F.col("named"), F.coalesce("root", "vid")).alias("component_id"))
    some = made.where("n > 0").select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    none = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n", "component_id").unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _classes(made: DataFrame) -> DataFrame:
    """One row per set: n, s1, s2, vid (smallest doc_id), gid (smallest vid of the classes with this prefix and
    size), grouped (their number), and what the set's documents have in common."""
    # all rows of a set have the same prefix and bitmap
    same = F.struct("prefix_hash", "usual", "parity", "prefix")
    c = made.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("vid"), F.first(same).alias("same"))
    c = c.select("n", "s1", "s2", F.col("vid").isNotNull().alias("named"), F.coalesce("vid", F.xxhash64("s1", "s2")).alias("vid"), "same.*")
    g = c.groupBy("n", "prefix_hash").agg(F.min("vid").alias("gid"), F.count("*").alias("grouped"))
    return c.join(g, ["n", "prefix_hash"]).drop("prefix_hash")


def _shared_ids(made: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (u, v) between the classes of rows that share a doc_id."""
    rows = made.where("n > 0 and doc_id is not null")
    again = rows.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    held = rows.join(again, "doc_id").select("doc_id", "n", "s1", "s2").distinct().join(classes.select("n", "s1", "s2", "vid"), ["n", "s1", "s2"])
    least = held.groupBy("doc_id").agg(F.min("vid").alias("v"), F.max("vid").alias("most")).where("v < most").select("doc_id", "v")
    return held.join(least, "doc_id").where("vid != v").select(F.col("vid").alias("u"), "v").distinct()


def _roots(docs: DataFrame, made: DataFrame, classes: DataFrame, width: int, num: int, den: int, small: int, levels: int, whole: int) -> DataFrame:
    """Edges (u, v) from each linked class to its component's smallest."""
    # sets that link and differ share num / (den - num) shingles at least
    levels = max(1, min(levels, -(-num // (den - num)))) if num < den else 1
    # one row of each group stands for it
    heads = classes.where("vid = gid").select(F.col("vid").alias("g"), "n", "usual", F.expr(f"slice(prefix, 1, n - cast((bigint({num}) * n + {den - 1}) div {den} as int) + 1)").alias("prefix"))
    tokens = heads.select("g", "n", "usual", F.posexplode("prefix").alias("pos", "key")).select("key", "g", "n", "pos", F.col("g").alias("root"), (F.col("pos") >= F.col("usual")).alias("hot"))
    buckets = materialize(bucket_pairs(tokens.where("not hot"), num, den, small), "buckets")
    members = classes.where("grouped > 1").select("gid", "vid", "n")
    # classes of one group meet in a bucket of their own: their first shared shingle is the first of all
    own = members.select(F.xxhash64("gid", F.lit("group")).alias("key"), F.col("vid").alias("g"), "n", F.lit(0).alias("pos"), F.col("vid").alias("root"))
    inside = materialize(bucket_pairs(own, num, den, small), "groups")
    expand = members.select(F.col("gid").alias("h0"), F.col("vid").alias("w"))

    def expanded(groups: DataFrame) -> DataFrame:
        u = groups.join(expand.withColumnRenamed("h0", "g"), "g", "left").select(F.coalesce("w", "g").alias("u"), "h")
        return u.join(expand.withColumnRenamed("h0", "h"), "h", "left").select("u", F.coalesce("w", "h").alias("v"))

    pairs = expanded(buckets.where("kind = 0").select("g", "h")).unionByName(inside.where("kind = 0").select(F.col("g").alias("u"), F.col("h").alias("v")))
    rows = buckets.where("kind = 1").select("key", "g", "n", "pos").unionByName(tokens.where("hot").select("key", "g", "n", "pos"))
    rows = rows.join(expand.withColumnRenamed("h0", "g"), "g", "left").select("key", F.coalesce("w", "g").alias("g"), "n", "pos")
    large = materialize(_viable(rows.unionByName(inside.where("kind = 1").select("key", "g", "n", "pos")), num, den, 1), "large")
    forest = _shared_ids(made, classes)
    for level in range(1, levels + 1):
        if large.isEmpty():
            return _linked(forest, pairs.withColumn("star", F.lit(False)), classes, docs, width, num, den)[0]
        met = materialize(_met(large), "met")
        stars = met.select(F.col("lead").alias("u"), F.col("g").alias("v"))
        forest, near = _linked(forest, pairs.withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(True))), classes, docs, width, num, den)
        parts = materialize(_open(_with_roots(_viable(_parts(met, near), num, den, level), forest)), "open")
        if parts.isEmpty():
            return forest
        if level == levels:
            break
        tried = materialize(bucket_pairs(parts, num, den, whole, level), "buckets")
        split = materialize(bucket_pairs(_by_next(tried.where("kind = 1"), classes, num, den, level), num, den, whole, level + 1), "buckets")
        pairs = tried.where("kind = 0").unionByName(split.where("kind = 0")).select(F.col("g").alias("u"), F.col("h").alias("v"))
        large = materialize(_open(split.where("kind = 1").select("key", "g", "n", "pos", F.col("h").alias("root"))).drop("root"), "large")
    other = parts.select("key", *(F.col(c).alias(f"{c}_a") for c in ("g", "n", "pos", "root")))
    fits = (F.col("g_a") < F.col("g")) & (F.col("root_a") != F.col("root")) & _possible("n_a", "pos_a", "n", "pos", num, den, levels)
    left = other.join(parts, "key").where(fits).select(F.col("g_a").alias("u"), F.col("g").alias("v"), F.lit(False).alias("star"))
    return _linked(forest, left, classes, docs, width, num, den)[0]


def _linked(forest: DataFrame, pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The forest with the links among the pairs (u, v, star), and (u, v, linked) of the leaders' pairs that are not far."""
    ordered = pairs.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "star").groupBy("u", "v").agg(F.max("star").alias("star"))
    some = materialize(compared(ordered, classes, num, den), "pairs")
    trial = some.where("not near").select("u", "v")
    wanted = trial.select(F.explode(F.array("u", "v")).alias("vid")).distinct()
    texts = _candidate_texts(docs, wanted).dropDuplicates(["vid", "text"])
    links = materialize(verified(trial, texts, width, num, den).distinct(), "links")
    known = some.select("u", "v").join(links.withColumn("linked", F.lit(True)), ["u", "v"], "left").select("u", "v", F.coalesce("linked", F.lit(False)).alias("linked"))
    return _forest(forest.select("u", "v").unionByName(links)), known


def _parts(met: DataFrame, near: DataFrame) -> DataFrame:
    """The buckets' members without their leaders, dealt into the parts within which links may be left: 0 linked and near ones, 1 near and far ones."""
    told = met.select("*", F.least("lead", "g").alias("u"), F.greatest("lead", "g").alias("v")).join(near, ["u", "v"], "left")
    part = F.when(F.col("linked"), F.array(F.lit(0))).when(F.col("linked").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return told.select("key", "g", "n", "pos", F.explode(part).alias("part")).select(F.xxhash64("key", "part").alias("key"), "g", "n", "pos")


def _with_roots(rows: DataFrame, forest: DataFrame) -> DataFrame:
    return rows.join(forest.select(F.col("u").alias("g"), F.col("v").alias("root")), "g", "left").withColumn("root", F.coalesce("root", "g"))


def _met(large: DataFrame) -> DataFrame:
    """The members with their bucket's leader: that in most buckets, as its shingles are the most shared."""
    often = large.groupBy("g").agg(F.count("*").alias("often"))
    leads = large.join(often, "g").groupBy("key").agg(F.max_by("g", F.struct("often", "g")).alias("lead"))
    return large.join(leads, "key").where("g != lead")


def _viable(rows: DataFrame, num: int, den: int, level: int) -> DataFrame:
    """The members that their size and position let link to the smallest member of the bucket that may be a partner."""
    least = rows.groupBy("key").agg(F.min("n").alias("low"))
    partner = F.greatest("low", F.ceil(F.col("n") * num / den))
    need = F.ceil(num * (F.col("n") + partner) / F.lit(num + den))
    return rows.join(least, "key").where(F.col("n") - F.col("pos") + level - 1 >= need).drop("low")


def _open(rows: DataFrame) -> DataFrame:
    """The rows of keys with more than one root."""
    split = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return rows.join(split, "key")


def _by_next(rows: DataFrame, classes: DataFrame, num: int, den: int, level: int) -> DataFrame:
    """Members (key, g, h: root, n, pos) by each shingle behind place ``pos`` of their prefixes, which are longer by ``level``."""
    behind = F.expr(f"slice(prefix, pos + 2, greatest(0, n - cast((bigint({num}) * n + {den - 1}) div {den} as int) + {level} - pos))")
    held = rows.select("key", "g", "pos", F.col("h").alias("root")).join(classes.select(F.col("vid").alias("g"), "n", "prefix"), "g")
    each = held.select("key", "g", "n", "pos", "root", F.posexplode(behind).alias("nth", "token"))
    return each.select(F.xxhash64("key", "token").alias("key"), "g", "n", (F.col("pos") + 1 + F.col("nth")).alias("pos"), "root")


def _forest(links: DataFrame) -> DataFrame:
    """Edges (u, v) from each linked vertex to its component's smallest."""
    return components(links).select(F.col("v").alias("u"), F.col("root").alias("v"))


def _possible(n_a: str, pos_a: str, n_b: str, pos_b: str, num: int, den: int, level: int) -> Column:
    """The size and position bounds, as in the small buckets."""
    a, b = F.col(n_a), F.col(n_b)
    need = F.ceil((num * (a + b)) / F.lit(num + den))
    return (den * F.least(a, b) >= num * F.greatest(a, b)) & (F.least(a - F.col(pos_a), b - F.col(pos_b)) + level - 1 >= need)


def one_per_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the document with the
    smallest doc_id stays, and of several rows with that id the one whose text sorts first. Texts without
    a word are linked with nothing and stay, as do rows with a null doc_id."""
    found = jaccard_components(docs, width, num, den).where("doc_id is not null and n_shingles > 0")
    seen = materialize(found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("component_id")), "components")
    gone = seen.where("component_id != doc_id").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    again = seen.where("component_id = doc_id and rows > 1").select("doc_id")
    if again.isEmpty():
        return kept
    first = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"))
    some = kept.join(again, "doc_id", "left_semi").select(docs.columns).withColumn("__nth", F.row_number().over(first)).where("__nth = 1").drop("__nth")
    return kept.join(again, "doc_id", "left_anti").select(docs.columns).unionByName(some)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


#: All pairs that share a shingle, and the closure of their links: for small tables only.
OP9_SQL = r"""WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * shared.n >= 85 * (a.n + b.n - shared.n)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM words UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), smallest AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM words LEFT JOIN sizes USING (doc_id) JOIN smallest ON u = doc_id"""
