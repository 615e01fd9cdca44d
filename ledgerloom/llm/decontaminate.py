"""Benchmark decontamination by latent semantic retrieval.

1. The terms are the words of the benchmark items. Over the whole corpus it is counted in how many distinct
   contexts (the word with its two neighbours) each term stands, which gives inverse document frequencies:
   copies of a passage, in whatever documents, repeat its contexts and so take no weight from its words.
   Every term keeps some weight.
2. A distributed randomised SVD of the TF-IDF passages of all documents and items gives ``RANK`` latent directions
   in one pass: tasks multiply their passages into a subspace, begun at random and turned towards the items by power
   iterations on these, and back; the driver takes the eigenvectors from that product (Nystroem's approximation of a
   matrix of terms by terms, which is never built).
3. Every passage of every document is projected; those whose cosine to an item reaches ``COSINE`` are
   candidates. Passages are overlapping windows that cover the whole text. So are passages with enough runs of
   ``LEAST_WORDS`` words of an item as they stand, whatever the weight of these words.
4. A candidate is checked on the words around its passage: the longest common subsequence must hold
   ``STRONG`` of the item's words, or ``WEAK`` of them and the item's answer (its last words) nearly whole.

Items are worked off in blocks of ``BLOCK_ITEMS``; the matches of a block are written before the next block's
index is made, so the driver and a task hold one index whatever the benchmark's size.

Defined cases: null and empty texts and items without a word match nothing; an item of under ``LEAST_WORDS`` words
matches a line that has just its words; rows that repeat an item's id and text are one item; a null
item_id is kept; an empty benchmark flags nothing; an item of everyday words only is found by its runs of
words; rows that share a doc_id are judged one by one; an empty table gives no rows; other columns are ignored
(``without_leaks`` carries them along). One text must fit a task's memory (about 100 bytes for each of its bytes).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks
from .common import LOWER, SPACE, documents_only, map_texts, materialize, mix64, raw_bytes, table, text_slices, tidy, word_hashes, word_spans

WINDOW, STRIDE = 48, 24
RANK, EXTRA, POWER = 96, 16, 2
COSINE, STRONG, WEAK, ANSWER_WORDS = 0.35, 0.75, 0.55, 6
BLOCK_ITEMS = 2000
#: Registers by which the distinct contexts of all words are counted (to 1.6 %).
REGISTERS = 1 << 12
#: A candidate passage must hold this share of the item's mass itself (of as much of the item as fits into it).
SHARED = 0.25
#: Items of fewer words are matched with whole lines only.
LEAST_WORDS = 4
#: Windows must hold this share of an item's inverse-document-frequency mass to be projected at all.
LEAST_MASS = 0.35

#: Punctuation ends no word but is left out of it.
_PLAIN = LOWER.copy()
_DROPPED = [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]
_PLAIN[_DROPPED] = 32
assert SPACE[32]


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (lower case, punctuation as white space) of all texts and each text's number of them."""
    data, offsets = raw_bytes(texts)
    data = _PLAIN[data]
    starts, ends, rows = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.bincount(rows, minlength=len(texts))


def contexts(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of each word with the words before and after it in its text."""
    ends = np.cumsum(counts[counts > 0])
    before, after = np.roll(words, 1), np.roll(words, -1)
    before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = 0
    after[ends - 1] = 0
    return mix64(words + mix64(before + np.uint64(1)) + mix64(after + np.uint64(2)))


def sequence_hashes(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of the first ``LEAST_WORDS`` words of each run of ``counts`` words, in order."""
    first = np.cumsum(counts) - counts
    value = np.zeros(len(counts), np.uint64)
    for k in range(LEAST_WORDS):
        some = np.flatnonzero(counts > k)
        value[some] = mix64(value[some] + words[first[some] + k])
    return value


def word_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first word and row of every run of ``LEAST_WORDS`` words inside a text."""
    row = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(max(0, len(words) - LEAST_WORDS + 1))
    at = at[row[at] == row[at + LEAST_WORDS - 1]]
    value = np.zeros(len(at), np.uint64)
    for k in range(LEAST_WORDS):
        value = mix64(value + words[at + k])
    return value, at, row[at]


@dataclass
class Terms:
    """The benchmark's terms: sorted hashes behind a bitmap that turns most other words away."""

    hashes: np.ndarray

    def __post_init__(self):
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    def of(self, words: np.ndarray) -> np.ndarray:
        """The term of each word, -1 for none."""
        out = np.full(len(words), -1, np.int64)
        maybe = np.flatnonzero(self.bits[(words >> np.uint64(44)).astype(np.int64)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.hashes, words[maybe]), len(self.hashes) - 1)
            out[maybe] = np.where(self.hashes[at] == words[maybe], at, -1)
        return out


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (word numbers) and row of the passages: overlapping, covering every text that has a word."""
    number = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
    row = np.repeat(np.arange(len(counts)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    first = np.cumsum(counts) - counts
    begin = first[row] + nth * STRIDE
    return begin, np.minimum(begin + WINDOW, (first + counts)[row]), row


def passage_vectors(term: np.ndarray, begin: np.ndarray, end: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of passages in sparse form: passage, term, value; rows have length 1. Term counts are damped by a root."""
    hits = np.flatnonzero((term >= 0) & (idf[term] > 0))
    lo, hi = np.searchsorted(hits, begin), np.searchsorted(hits, end)
    size = hi - lo
    passage = np.repeat(np.arange(len(begin)), size)
    which = term[hits[np.arange(len(passage)) + np.repeat(lo - (np.cumsum(size) - size), size)]]
    pair, count = np.unique(passage * len(idf) + which, return_counts=True)
    passage, which = pair // len(idf), pair % len(idf)
    value = np.sqrt(count) * idf[which]
    norm = np.sqrt(np.bincount(passage, value**2, len(begin)))
    return passage, which, (value / np.maximum(norm[passage], 1e-9)).astype(np.float32)


def project(passage: np.ndarray, term: np.ndarray, value: np.ndarray, number: int, basis: np.ndarray) -> np.ndarray:
    """Latent vectors of the passages, worked out some thousands of terms at a time."""
    out = np.zeros((number, basis.shape[1]), np.float32)
    starts = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else []
    for a in range(0, len(starts), 512):
        begin = starts[a : a + 512]
        end = starts[a + 512] if a + 512 < len(starts) else len(passage)
        out[passage[begin]] = np.add.reduceat(basis[term[begin[0] : end]] * value[begin[0] : end, None], begin - begin[0], axis=0)
    return out


def _summed(rows: DataFrame, size: tuple[int, int], add: Callable[[np.ndarray, pa.RecordBatch], None]) -> np.ndarray:
    """A matrix that ``add`` fills from slices of rows, summed over all tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float32)
        for batch in batches:
            for part in text_slices(batch):
                add(total, part)
        yield from blocks.send(total.reshape(-1))

    return blocks.summed(rows.mapInArrow(tidy(run), blocks.PARTS), size[0] * size[1], False).reshape(size)


def random_svd(rows: DataFrame, items: pa.Array, terms: Terms, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """The leading right singular vectors (terms x rank) of the passages of all ``rows`` and the items."""
    width = min(rank + EXTRA, len(idf))

    def there_and_back(total: np.ndarray, texts: pa.Array, basis: np.ndarray) -> None:
        words, counts = words_of(texts)
        begin, end, _ = windows(counts)
        passage, term, value = passage_vectors(terms.of(words), begin, end, idf)
        low = project(passage, term, value, len(begin), basis)
        order = np.argsort(term, kind="stable")
        if len(order):
            term = term[order]
            begin = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
            for a in range(0, basis.shape[1], 16):
                total[term[begin], a : a + 16] += np.add.reduceat(low[passage[order], a : a + 16] * value[order, None], begin, axis=0)

    def of_items(basis: np.ndarray) -> np.ndarray:
        own = np.zeros(basis.shape, np.float32)
        there_and_back(own, items, basis)
        return own

    basis = np.linalg.qr(np.random.default_rng(1).normal(size=(len(idf), width)))[0].astype(np.float32)
    for _ in range(POWER):
        # a part of the random directions stays, for passages that are unlike any item
        basis = np.linalg.qr(basis * 0.01 + of_items(basis))[0].astype(np.float32)
    total = _summed(rows, basis.shape, lambda t, part: there_and_back(t, part.column("text"), basis))
    own = of_items(basis)
    # the items weigh as much as the documents, so that each has a direction of its own
    total = total.astype(np.float64) + own * max(1.0, np.linalg.norm(total) / max(1e-9, np.linalg.norm(own)))
    # Nystroem: the matrix is about total core^-1 total', so its eigenvectors are the left singular vectors of total core^-1/2
    core = basis.T @ total
    values, turn = np.linalg.eigh((core + core.T) / 2)
    held = values > 1e-6 * max(values.max(), 1e-12)
    return np.linalg.svd(total @ (turn[:, held] / np.sqrt(values[held])), full_matrices=False)[0][:, :rank].astype(np.float32)


def common_subsequence(item: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with one bit of a whole number for each word of ``item``."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        if w in where:
            u = v & where[w]
            v = (v + u | v - u) & full
    return len(item) - v.bit_count()


@dataclass
class Index:
    """All a task needs to judge texts against one block of items."""

    terms: Terms
    idf: np.ndarray
    basis: np.ndarray
    keys: list
    words: list[list[int]]
    latent: np.ndarray
    mass: np.ndarray
    #: The keys of the items of few words, by their hash.
    short: dict[int, list]

    def __post_init__(self):
        if not self.words:
            return
        sizes = np.array([len(w) for w in self.words])
        term = self.terms.of(np.array([x for w in self.words for x in w], np.uint64))
        self.item_terms = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(self.idf) + term)
        self.least = SHARED * self.mass * np.minimum(1.0, WINDOW / np.maximum(1, sizes))
        value, _, item = word_runs(np.array([x for w in self.words for x in w], np.uint64), sizes)
        order = np.lexsort((item, value))
        value, item = value[order], item[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (item[1:] != item[:-1])
        self.run_items = item[new]
        hashes, self.run_first = np.unique(value[new], return_index=True)
        self.run_first = np.append(self.run_first, new.sum())
        self.runs = Terms(hashes)
        #: A passage's stride must hold this many runs of the item.
        self.least_runs = SHARED * np.minimum(STRIDE, sizes - LEAST_WORDS + 1)

    def _running(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The candidates that share runs of words, as passage x number of items + item, in order."""
        value, at, row = word_runs(words, counts)
        run = self.runs.of(value)
        hit = np.flatnonzero(run >= 0)
        run, at, row = run[hit], at[hit], row[hit]
        number = np.where(counts > 0, np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1), 0)
        nth = np.minimum((at - (np.cumsum(counts) - counts)[row]) // STRIDE, number[row] - 1)
        passage = (np.cumsum(number) - number)[row] + nth
        # a run counts once for a passage, so repetitions neither pass for an item nor multiply the work
        passage, run = np.divmod(np.unique(passage * len(self.runs.hashes) + run), len(self.runs.hashes))
        size = (self.run_first[1:] - self.run_first[:-1])[run]
        done = np.cumsum(size)
        out, a = [np.zeros(0, np.int64)], 0
        while a < len(run):
            b = max(a + 1, int(np.searchsorted(done, done[a] - size[a] + (1 << 20))))
            # whole passages at a time
            b = int(np.searchsorted(passage, passage[b - 1], side="right"))
            n = size[a:b]
            item = self.run_items[np.arange(n.sum()) + np.repeat(self.run_first[run[a:b]] - (np.cumsum(n) - n), n)]
            pair, shared = np.unique(np.repeat(passage[a:b], n) * len(self.words) + item, return_counts=True)
            out.append(pair[shared >= self.least_runs[pair % len(self.words)]])
            a = b
        return np.concatenate(out)

    def _sharing(self, at: np.ndarray, item: np.ndarray, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The candidates (passage, item) whose terms in common weigh enough."""
        lo, hi = np.searchsorted(passage, at), np.searchsorted(passage, at, side="right")
        size = hi - lo
        which = term[np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)]
        pair = np.repeat(np.arange(len(at)), size)
        key = item[pair] * len(self.idf) + which
        held = self.item_terms[np.minimum(np.searchsorted(self.item_terms, key), len(self.item_terms) - 1)] == key
        weight = np.bincount(pair[held], self.idf[which[held]], len(at))
        keep = weight >= self.least[item]
        return at[keep], item[keep]

    def matches(self, texts: pa.Array) -> list[tuple[int, int, float, float, bool]]:
        """(row, item id, cosine, share of the item in the common subsequence, answer found) of the leaks."""
        return [(r, self.keys[i], *x) for r, i, *x in self._long(texts)] + [(r, key, 1.0, 1.0, True) for r, key in self._lines(texts)]

    def _lines(self, texts: pa.Array) -> list[tuple]:
        """(row, item id) of the items of few words that are lines of a text."""
        if not self.short:
            return []
        data, offsets = raw_bytes(texts)
        ends = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
        plain = _PLAIN[data]
        starts, stops, line = word_spans(plain, ends)
        counts = np.bincount(line, minlength=len(ends) - 1)
        value = sequence_hashes(word_hashes(plain, starts, stops), counts)
        hit = np.flatnonzero((counts > 0) & (counts < LEAST_WORDS) & np.isin(value, np.array(list(self.short), np.uint64)))
        rows = np.searchsorted(offsets, ends[hit], side="right") - 1
        return sorted({(r, key) for r, v in zip(rows.tolist(), value[hit].tolist(), strict=True) for key in self.short[v]}, key=str)

    def _long(self, texts: pa.Array) -> list[tuple]:
        words, counts = words_of(texts)
        begin, end, row = windows(counts)
        if not len(begin) or not self.words:
            return []
        term = self.terms.of(words)
        heavy = np.concatenate([[0.0], np.cumsum(np.where(term >= 0, self.idf[term], 0.0))])
        running = self._running(words, counts)
        worth = heavy[end] - heavy[begin] >= LEAST_MASS * self.mass.min()
        worth[running // len(self.words)] = True
        some = np.flatnonzero(worth)
        running = np.searchsorted(some, running // len(self.words)) * len(self.words) + running % len(self.words)
        begin, end, row = begin[some], end[some], row[some]
        first = np.cumsum(counts) - counts
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for a in range(0, len(begin), 4096):
            b, e = begin[a : a + 4096], end[a : a + 4096]
            vectors = passage_vectors(term, b, e, self.idf)
            low = project(*vectors, len(b), self.basis)
            low /= np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-9)
            cos = low @ self.latent.T
            at, item = self._sharing(*np.nonzero(cos >= COSINE), *vectors[:2])
            lo, hi = np.searchsorted(running, [a * len(self.words), (a + len(b)) * len(self.words)])
            both = np.union1d(at * len(self.words) + item, running[lo:hi] - a * len(self.words))
            for at, item in zip((both // len(self.words)).tolist(), (both % len(self.words)).tolist(), strict=True):
                r, size = int(row[a + at]), len(self.words[item])
                if best.get((r, item), (0, 0, False))[1] >= 0.99:
                    continue
                lo, hi = max(first[r], b[at] - size), min(first[r] + counts[r], e[at] + size)
                near = words[lo:hi].tolist()
                share = common_subsequence(self.words[item], near) / size
                if share < WEAK:
                    continue
                answer = self.words[item][-ANSWER_WORDS:]
                answered = common_subsequence(answer, near) >= len(answer) - 1
                if share >= STRONG or answered:
                    best[r, item] = max(best.get((r, item), (0.0, 0.0, False)), (float(cos[at, item]), share, answered), key=lambda x: x[1])
        return [(r, i, *x) for (r, i), x in sorted(best.items())]


def registers(context: np.ndarray) -> np.ndarray:
    """HyperLogLog's registers of the contexts: of those that share their first bits the longest run of zeros, and one, that follows."""
    out = np.zeros(REGISTERS, np.int64)
    bits = 64 - (REGISTERS.bit_length() - 1)
    rest = (context & np.uint64((1 << bits) - 1)).astype(np.float64)
    np.maximum.at(out, (context >> np.uint64(bits)).astype(np.int64), bits + 1 - np.frexp(rest)[1])
    return out


def distinct_contexts(most: np.ndarray) -> float:
    """About how many different contexts the registers saw."""
    empty = int((most == 0).sum())
    found = 0.7213 / (1 + 1.079 / REGISTERS) * REGISTERS**2 / np.exp2(-most.astype(np.float64)).sum()
    return REGISTERS * np.log(REGISTERS / empty) if empty and found <= 2.5 * REGISTERS else found


def frequencies(docs: DataFrame, terms: Terms) -> np.ndarray:
    """Each term's inverse document frequency by its distinct contexts, as if these were dealt over passages."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            words, counts = words_of(part.column("text"))
            context, term = contexts(words, counts), terms.of(words)
            own, most = np.flatnonzero(term >= 0), registers(context)
            some = np.flatnonzero(most)
            # a register's row has its number below zero
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([term[own], -1 - some]), pa.int32()), pa.array(np.concatenate([context[own].view(np.int64), most[some]]))], ["term", "context"])

        return work

    held, most = np.zeros(len(terms.hashes)), np.zeros(REGISTERS, np.int64)
    for r in map_texts(docs, "term int, context long", build).groupBy("term").agg(F.approx_count_distinct("context").alias("n"), F.max("context").alias("most")).collect():
        if r["term"] >= 0:
            held[r["term"]] = r["n"]
        else:
            most[-1 - r["term"]] = r["most"]
    share = (1 + held) / (1 + max(distinct_contexts(most), held.sum()))
    return np.log1p(1 / -np.expm1(WINDOW * np.log1p(-np.minimum(share, 0.999)))) ** 1.5


def build_index(docs: DataFrame, items: list[tuple[int, str]], rank: int = RANK) -> Index | None:
    """The index of one block of items over the statistics of all ``docs``; None if no item has a word."""
    texts = pa.array([t for _, t in items], pa.string())
    words, counts = words_of(texts)
    if not len(words):
        return None
    terms = Terms(np.unique(words))
    idf = frequencies(docs, terms)
    basis = random_svd(docs.select("text"), texts, terms, idf, rank)
    term = terms.of(words)
    ends = np.cumsum(counts)
    latent = project(*passage_vectors(term, ends - counts, ends, idf), len(counts), basis)
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    some, few = np.flatnonzero(counts >= LEAST_WORDS), np.flatnonzero((counts > 0) & (counts < LEAST_WORDS))
    short: dict[int, list] = {}
    for i, v in zip(few.tolist(), sequence_hashes(words, counts)[few].tolist(), strict=True):
        short.setdefault(v, []).append(items[i][0])
    running = np.concatenate([[0.0], np.cumsum(idf[term])])
    mass = (running[ends] - running[ends - counts])[some]
    return Index(terms, idf, basis, [items[i][0] for i in some], [words[ends[i] - counts[i] : ends[i]].tolist() for i in some], latent[some], mass, short)


def item_blocks(benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[list[tuple[int, str]]]:
    """The items in order, a bounded number at a time."""
    last = None
    keyed = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct().withColumn("mark", F.struct(F.coalesce("item_id", F.lit(-(1 << 63))).alias("a"), F.xxhash64("text").alias("b"), F.sha2(F.col("text").cast("binary"), 256).alias("c")))
    while True:
        rows = (keyed if last is None else keyed.where(F.col("mark") > F.struct(F.lit(last[0]).alias("a"), F.lit(last[1]).alias("b"), F.lit(last[2]).alias("c")))).orderBy("mark").limit(size).collect()
        if not rows:
            return
        yield [(r["item_id"], r["text"]) for r in rows]
        last = rows[-1]["mark"]


def indexes(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_ITEMS) -> Iterator[Index]:
    """The indexes of the blocks, one after the other."""
    for block in item_blocks(benchmark, size):
        if (index := build_index(docs, block)) is not None:
            yield index


LEAKS = "doc_id long, item_id long, cosine double, common double, answered boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and benchmark item that it holds."""
    docs = documents_only(docs)
    found = docs.sparkSession.createDataFrame([], LEAKS)
    for index in indexes(docs, benchmark, size):
        found = found.unionByName(materialize(_matches(docs, index), "leaks"))
    return found


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = index.matches(part.column("text"))
            rows, items, cosine, share, answered = zip(*found, strict=True) if found else ((),) * 5
            keys = part.column("doc_id").take(pa.array(rows, pa.int64()))
            return pa.RecordBatch.from_arrays([keys, pa.array(items, pa.int64()), pa.array(cosine, pa.float64()), pa.array(share, pa.float64()), pa.array(answered, pa.bool_())], ["doc_id", "item_id", "cosine", "common", "answered"])

        return work

    return map_texts(docs, LEAKS, build)


def without_leaks(docs: DataFrame, benchmark: DataFrame, size: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    kept, before = docs, None
    for index in indexes(documents_only(docs), benchmark, size):
        # what one block leaves is written before the next one's index takes the place of this one's
        kept = _without(kept if before is None else materialize(before, "clean"), index)
        before = kept
    return kept


def _without(docs: DataFrame, index: Index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch):
                keep = np.ones(part.num_rows, bool)
                keep[[m[0] for m in index.matches(part.column("text").fill_null(""))]] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
