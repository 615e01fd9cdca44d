"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

1. A set's sketch has ``SIZE`` coordinates. In round i every member is hashed to a coordinate and a value, and each
   coordinate keeps its smallest (round, value); rounds end when all are filled. After ``SIZE`` rounds each
   further one serves one coordinate, so every coordinate fills whatever the set's size. A coordinate of two sets
   agrees with the probability of their Jaccard similarity, and the share of agreeing ones is concentrated as if
   members were drawn without replacement. A set needs about SIZE * ln(SIZE) hashes, not SIZE times its members.
2. Equal sets form a class, of which one row is banded: ``BANDS`` bands of ``ROWS`` coordinates. Two sets at a
   similarity of 0.8 share no band once in 10 ** 8.
3. In small buckets all pairs are candidates. A larger bucket has a leader that meets every member: the first in one
   order of all classes, so the buckets of a group share few leaders. Buckets pass a task as sorted streams that hold
   ``SMALL`` rows. From there on the members of all buckets of one leader are one cluster, in which each class
   stands once, however many bands it shares. By the triangle inequality of Jaccard distance linked and far members
   of a cluster cannot link, and a part that is one component needs no pair. Parts that stay open get other leaders,
   ``ROUNDS`` times; each round costs in proportion to their members. What is left is paired across components,
   where a pair shares a band. Parts of over ``BLOCK`` members are dealt out in blocks.
4. Parity bitmaps rule most unlike pairs out with certainty; the others are verified on the full sets of
   whole texts. Components come from star rounds.

Sets meet by 64-bit hashes of shingles. There is no cap on partners or candidates.

Defined cases: as in ``similarity_join``: texts without a word have 0 shingles and are their own component; fewer words
than a shingle has are one shingle; repeated rows are one class; rows that share a doc_id are one component; a row with
a null doc_id belongs to the component of the rows with the same set, with a null component where all of those
are null, and is kept only then; an empty table gives no rows; other columns are ignored. One text must fit a task's memory
(about 60 bytes for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, map_texts, materialize, mix64, table, tidy
from .similarity_join import _linked, _open, _runs, _shared_ids, _with_roots, needed, parity_bitmaps, shingle_sets

SIZE = 512
BANDS, ROWS = 60, 6
SMALL, ROUNDS, BLOCK = 8, 2, 4096
#: Hashes computed at once.
AT_ONCE = 1 << 17
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
VALUE_BITS = np.uint64(48)


def round_hashes(h: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """A row of fresh hashes of all members for each round."""
    return mix64(h + (rounds.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))[:, None])


def sketches(h: np.ndarray, n: np.ndarray, size: int = SIZE) -> np.ndarray:
    """A row of ``size`` coordinates for each set; ``h`` holds the sets' members one after another, ``n`` their numbers (over 0)."""
    bits = np.uint64(64 - (size.bit_length() - 1))
    low = (np.uint64(1) << VALUE_BITS) - np.uint64(1)
    out = np.full(len(n) * size, EMPTY)
    rows = np.repeat(np.arange(len(n)), n)
    at, active, active_rows = 0, h, rows
    while len(active) and at < size:
        rounds = np.arange(at, min(size, at + max(1, AT_ONCE // len(active))))
        v = round_hashes(active, rounds)
        place = active_rows * size + (v >> bits).astype(np.int64)
        np.minimum.at(out, place.ravel(), ((rounds.astype(np.uint64) << VALUE_BITS)[:, None] | (v & low)).ravel())
        at = int(rounds[-1]) + 1
        left = (out.reshape(-1, size) == EMPTY).any(1)[active_rows]
        active, active_rows = active[left], active_rows[left]
    # what the rounds left empty gets a round of its own
    hole = np.flatnonzero(out == EMPTY)
    begins = np.cumsum(n) - n
    for part in np.array_split(hole, max(1, int(n[hole // size].sum()) // AT_ONCE + 1)):
        if len(part):
            row, times = part // size, n[part // size]
            ends = np.cumsum(times)
            member = np.arange(ends[-1]) + np.repeat(begins[row] - (ends - times), times)
            rounds = np.repeat(size + part % size, times).astype(np.uint64)
            v = mix64(h[member] + rounds * np.uint64(0xD1342543DE82EF95) + np.uint64(0x2545F4914F6CDD1D))
            out[part] = np.minimum.reduceat((rounds << VALUE_BITS) | (v & low), ends - times)
    return out.reshape(-1, size)


def band_hashes(s: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 32-bit hash of each band of ``rows`` coordinates."""
    part = s[:, : bands * rows].reshape(len(s), bands, rows)
    out = np.zeros((len(s), bands), np.uint64)
    for k in range(rows):
        out = mix64(out + part[:, :, k])
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


DIGESTS = "doc_id long, n int, s1 long, s2 long, parity binary, bands array<int>"


def digests(docs: DataFrame, width: int, least: int) -> DataFrame:
    """A row per document: its set's size, digest, parity bitmap and band hashes; sets of under ``least`` members link to equal ones only and have no bands."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            h, n = shingle_sets(part.column("text"), width)
            starts, some = np.cumsum(n) - n, n > 0
            sums = []
            for salt in (0x1B873593, 0x7FEB352D):
                s = np.zeros(len(n), np.uint64)
                if len(h):
                    s[some] = np.add.reduceat(mix64(h ^ np.uint64(salt * 0x9E3779B1)), starts[some])
                sums.append(pa.array(s.view(np.int64)))
            banded = n >= least
            s = sketches(h[np.repeat(banded, n)], n[banded])
            ends = np.concatenate([[0], np.cumsum(banded * BANDS)])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(band_hashes(s, BANDS, ROWS).ravel()))
            columns = [part.column("doc_id"), pa.array(n, pa.int32()), *sums, parity_bitmaps(h, n), bands]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

        return work

    return map_texts(docs, DIGESTS, build)


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, small: int = SMALL, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; sets link at a Jaccard similarity of num / den or more."""
    docs = documents_only(docs)
    # sets that link and differ share so many members at least
    least = -(-num // (den - num)) if num < den else 1 << 30
    made = materialize(digests(docs, width, least), "digests")
    c = made.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("vid"), F.first(F.struct("parity", "bands")).alias("same"))
    classes = materialize(c.select("n", "s1", "s2", F.col("vid").isNotNull().alias("named"), F.coalesce("vid", F.xxhash64("s1", "s2")).alias("vid"), "same.*"), "classes")
    roots = _roots(docs, made, classes, width, num, den, small, rounds, block).select(F.col("u").alias("vid"), F.col("v").alias("root"))
    named = classes.select("vid", "n", "s1", "s2", "named").join(roots, "vid", "left").select("n", "s1", "s2", F.when(F.col("named"), F.coalesce("root", "vid")).alias("component_id"))
    some = made.where("n > 0").select("doc_id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left").select("doc_id", "n", "component_id")
    none = made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


BUCKETS = "kind int, u long, v long, n int"


def _buckets(tokens: DataFrame, num: int, den: int, small: int) -> DataFrame:
    """Of the buckets of up to ``small`` members the candidate pairs (kind 0; u, v), of the others each member with its
    leader (kind 1; u the leader, v and n the member). ``tokens``: key, g, n."""

    def out(kind: int, u: np.ndarray, v: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind), pa.int32()), pa.array(u), pa.array(v), pa.array(n, pa.int32())], ["kind", "u", "v", "n"])

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, g, n = rows
        begins = _runs(key)
        sizes = np.diff(np.append(begins, len(key)))
        size, first = np.repeat(sizes, sizes), np.repeat(begins, sizes)
        led = (size > small) & (g[first] != g)
        yield from out(1, g[first][led], g[led], n[led])
        place, found = np.arange(len(key)) - first, []
        for gap in range(1, int(size[size <= small].max(initial=1))):
            i = np.flatnonzero((size <= small) & (place + gap < size))
            j = i + gap
            ok = (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j])) & (g[i] != g[j])
            found.append(np.stack([np.minimum(g[i[ok]], g[j[ok]]), np.maximum(g[i[ok]], g[j[ok]])]))
        if found:
            u, v = np.unique(np.concatenate(found, axis=1), axis=1)
            yield from out(0, u, v, u * 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # rows of the last key of a batch, which may go on in the next
        led = None  # a key that is known to be large, and its leader
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "g", "n")])
            if led:
                on = rows[0] == led[0]
                more = on & (rows[1] != led[1])
                yield from out(1, np.full(more.sum(), led[1]), rows[1][more], rows[2][more])
                if on.all():
                    continue
                rows, led = rows[:, ~on], None
            rows = np.concatenate([held, rows], axis=1)
            begin = _runs(rows[0])[-1] if rows.shape[1] else 0
            yield from whole(rows[:, :begin])
            held = rows[:, begin:]
            if held.shape[1] > small:
                led = held[0, 0], held[1, 0]
                yield from whole(held)
                held = held[:, :0]
        yield from whole(held)

    width = max(1, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = tokens.select("key", "g", "n", F.xxhash64("g", F.lit(0)).alias("rank")).repartition(width, "key").sortWithinPartitions("key", "rank", "g")
    return ordered.select("key", "g", "n").mapInArrow(tidy(run), BUCKETS)


def _roots(docs: DataFrame, made: DataFrame, classes: DataFrame, width: int, num: int, den: int, small: int, rounds: int, block: int) -> DataFrame:
    """Edges (u, v) from each linked class to its component's smallest."""
    tokens = classes.select(F.col("vid").alias("g"), "n", F.posexplode("bands").alias("band", "value")).select(F.xxhash64("band", "value").alias("key"), "g", "n")
    buckets = materialize(_buckets(tokens, num, den, small), "buckets")
    pairs = buckets.where("kind = 0").select("u", "v", F.lit(False).alias("star"))
    met = materialize(buckets.where("kind = 1").select(F.col("u").alias("lead"), F.col("v").alias("g"), "n").distinct(), "met")
    forest = _shared_ids(made, classes)
    for turn in range(1, rounds + 1):
        stars = met.select(F.col("lead").alias("u"), F.col("g").alias("v"), F.lit(True).alias("star"))
        forest, near = _linked(forest, pairs.unionByName(stars), classes, docs, width, num, den)
        large = materialize(_open(_with_roots(_parts(met, near), forest)), "open")
        if large.isEmpty():
            return forest
        if turn < rounds:
            pairs, met = stars.where("false"), materialize(_led(large, turn), "met")
    left = _banded_pairs(large, classes, num, den, block).withColumn("star", F.lit(False))
    return _linked(forest, left, classes, docs, width, num, den)[0]


def _led(large: DataFrame, turn: int) -> DataFrame:
    """The members with their part's leader, the first in the order of the turn, which is that of all parts."""
    leads = large.groupBy("key").agg(F.min_by("g", F.xxhash64("g", F.lit(turn))).alias("lead"))
    return large.select("key", "g", "n").join(leads, "key").where("g != lead").select("lead", "g", "n").distinct()


def _parts(met: DataFrame, near: DataFrame) -> DataFrame:
    """The clusters' members without their leaders, dealt into the parts within which links may be left: 0 linked and near ones, 1 near and far ones."""
    told = met.select("*", F.least("lead", "g").alias("u"), F.greatest("lead", "g").alias("v")).join(near, ["u", "v"], "left")
    part = F.when(F.col("linked"), F.array(F.lit(0))).when(F.col("linked").isNull(), F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    return told.select("lead", "g", "n", F.explode(part).alias("part")).select(F.xxhash64("lead", "part").alias("key"), "g", "n")


#: Bytes of the folded bitmaps that pairs are compared by, the longest that both have.
FOLDS = (8, 32, 128, 512)


def folds(bitmaps: list[bytes]) -> tuple[np.ndarray, ...]:
    """The bitmaps' lengths, and each folded to every length of ``FOLDS`` (zeros where it is shorter)."""
    lengths = np.array([len(b) for b in bitmaps], np.int64)
    out = [np.zeros((len(bitmaps), size // 8), np.uint64) for size in FOLDS]
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        bits = np.frombuffer(b"".join(bitmaps[k] for k in at), np.uint64).reshape(len(at), -1)
        for size, folded in zip(reversed(FOLDS), reversed(out)):
            if length >= size:
                while bits.shape[1] > size // 8:
                    half = bits.shape[1] // 2
                    bits = bits[:, :half] ^ bits[:, half:]
                folded[at] = bits
    return (lengths, *out)


def least_difference(a: tuple, b: tuple, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For pairs of rows of two ``folds``: in how many members their sets differ at least."""
    common = np.minimum(a[0][u], b[0][v])
    out = np.zeros(len(u), np.int64)
    for k, size in enumerate(FOLDS):
        fits = (common >= size) & (common < (FOLDS[k + 1] if k + 1 < len(FOLDS) else 1 << 62))
        out[fits] = np.bitwise_count(a[k + 1][u[fits]] ^ b[k + 1][v[fits]]).sum(1)
    return out


def _banded_pairs(rows: DataFrame, classes: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """Pairs (u, v) of members (key, g, n, root) of different roots that share a band.
    Those whose parity bitmaps rule a link out with certainty are left out where they are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the block whose rows ``theirs`` are held against
        for batch in batches:
            key, blk, side, g, n, root = (batch.column(c).to_numpy() for c in ("key", "blk", "side", "g", "n", "root"))
            bands = batch.column("bands").flatten().to_numpy().reshape(len(g), -1)
            parity = folds(batch.column("parity").to_pylist())
            begins = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (blk[1:] != blk[:-1])])) if len(g) else []
            for a, e in zip(begins, [*begins[1:], len(g)]):
                at = np.arange(a, e)
                ours, theirs = at[side[at] == 0], at[side[at] == 1]
                name, mine = (key[a], blk[a]), (g[ours], n[ours], root[ours], bands[ours], *(x[ours] for x in parity))
                held = (name, tuple(np.concatenate([x, y]) for x, y in zip(held[1], mine, strict=True))) if held and held[0] == name else (name, mine)
                yield from across(held[1], (g[theirs], n[theirs], root[theirs], bands[theirs], *(x[theirs] for x in parity)))

    def across(ours: tuple, theirs: tuple) -> Iterator[pa.RecordBatch]:
        step = max(1, (1 << 21) // max(1, len(ours[0])))
        for at in range(0, len(theirs[0]), step):
            g, n, root, bands, *parity = (x[at : at + step] for x in theirs)
            small, high = np.minimum(ours[1][:, None], n), np.maximum(ours[1][:, None], n)
            i, j = np.nonzero((ours[0][:, None] < g) & (ours[2][:, None] != root) & (den * small.astype(np.int64) >= num * high.astype(np.int64)))
            for k in range(0, len(i), 1 << 16):
                u, v = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                share = (ours[3][u] == bands[v]).any(1)
                u, v = u[share], v[share]
                a, b = ours[1][u].astype(np.int64), n[v].astype(np.int64)
                may = least_difference(ours[4:], tuple(parity), u, v) <= a + b - 2 * needed(a, b, num, den)
                yield pa.RecordBatch.from_arrays([pa.array(ours[0][u[may]]), pa.array(g[v[may]])], ["u", "v"])

    blocks = rows.groupBy("key").agg(F.expr(f"cast((count(*) + {block - 1}) div {block} as int)").alias("blocks"))
    held = rows.join(blocks, "key").join(classes.select(F.col("vid").alias("g"), "bands", "parity"), "g")
    own = F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int")
    # each member stands in its own block, and meets all blocks of its part
    places = F.concat(F.array(F.struct(own.alias("blk"), F.lit(0).alias("side"))), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(b.cast("int").alias("blk"), F.lit(1).alias("side"))))
    dealt = held.select("key", "g", "n", "root", "bands", "parity", F.explode(places).alias("at")).select("key", "at.blk", "at.side", "g", "n", "root", "bands", "parity")
    width = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(width, "key", "blk").sortWithinPartitions("key", "blk", "side").mapInArrow(tidy(run), "u long, v long").distinct()


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2, num=80, den=100)


#: All pairs that share a shingle, and the closure of their links: for small tables only.
OP12_SQL = r"""WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1
), shared AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT u, v FROM shared JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE 100 * shared.n >= 80 * (a.n + b.n - shared.n)
), reach AS (
  SELECT doc_id AS u, doc_id AS v FROM words UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u
), smallest AS (
  SELECT u, min(v) AS component_id FROM reach GROUP BY 1
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM words LEFT JOIN sizes USING (doc_id) JOIN smallest ON u = doc_id"""
