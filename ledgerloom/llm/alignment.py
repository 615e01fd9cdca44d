"""Cross-tokenizer alignment: two tokenizers' tokens of one text, cut into groups where both end, and linked inside them.

Tokenizer A is a byte-level BPE that gives character offsets, B a sentencepiece model whose immutable proto gives
byte spans. Both are coarse cuts: characters of several bytes can fall into several tokens of A that share their
offsets, and byte-fallback tokens of B have empty spans. Those are refined with the tokens' decoded bytes.

1. A text is cut before blanks that follow no white space. Neither tokenizer joins anything over such a place
   (A's pre-tokeniser begins a word there, none of B's pieces has a blank behind another character), so a chunk's
   tokens, groups and links are its own; each distinct chunk of a worker is tokenised once, many in one call where
   that alters none of their bytes.
2. Texts are read once, in slices. A slice is written as one row: its texts' numbers and digests, its distinct
   linked id pairs with the number of its texts that hold each, and which text holds which pair how often.
3. The pairs' counts are summed over all slices and the highest of each A id is marked.
4. The ``HOT`` most frequent pairs, a fixed number, go to every task and are looked up where slices are read; only the
   texts' rarer pairs are shuffled to their counts, so no pair that stands in a large share of texts is ever a key.

Defined cases: null and empty texts, and texts whose tokens' joined bytes differ from blank + text, have no tokens:
zeros and an empty digest; every row counts as a document of its own, so repeated rows count each; a null
doc_id stays null; an empty table gives no rows; other columns are ignored. One text must fit a task's memory (about
100 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, map_texts, materialize, raw_bytes, table, tidy
from .packing import byte_letters

#: Distinct chunks, and tokens of them, that a worker remembers.
CACHE_CHUNKS, CACHE_TOKENS = 150_000, 1_500_000
SLICE = 1 << 20
#: Links of a group whose ids are counted before they are paired.
LARGE = 1 << 12
#: Pairs whose counts go to every task.
HOT = 1 << 17
#: An id pair as one number: a * B_IDS + b.
B_IDS = 1 << 17
#: Chunks that are tokenised in one call, then those of a call that altered one of them.
JOINED = (64, 8)
#: White space (Unicode's property) of several bytes in UTF-8.
WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def chunk_starts(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where chunks begin: at each row's begin and at each blank behind a character that is no white space. ``rows``: begins and end."""
    at = np.flatnonzero(data == 32)
    at = at[at > 0]
    before = data[at - 1]
    split = (before > 32) & (before != 127)
    for c in WIDE_SPACE:
        same = np.ones(len(at), bool)
        for k, b in enumerate(reversed(c)):
            same &= data[np.maximum(at - 1 - k, 0)] == b
        split &= ~same
    return np.union1d(at[split], rows[:-1][np.diff(rows) > 0])


def refined(coarse: np.ndarray, exact: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Token ends: the coarse ones where they are exact, else counted on by decoded bytes from the last exact one of
    the chunk or from its begin. ``firsts``: the first token of each token's chunk, ``begins``: where that chunk begins."""
    if exact.all():
        return coarse
    total = np.cumsum(sizes)
    at = np.arange(len(coarse))
    last = np.maximum.accumulate(np.where(exact, at, -1))
    inside = last >= firsts
    return np.where(inside, coarse[last] + total - total[last], begins + total - (total - sizes)[firsts])


#: Characters behind which a blank begins no chunk, as in ``chunk_starts``.
JOINS_BLANKS = frozenset(map(chr, range(33))) | {"\x7f"} | {c.decode() for c in WIDE_SPACE}


class Aligner:
    """Both tokenizers, and what is known of the chunks seen so far."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # threads of its own keep memory for each of them in each worker; tasks fill the cores already
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = {chr(c): b for b, c in byte_letters().items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.id_to_piece(list(range(self.b.get_piece_size()))))]
        self.blank = self.b.piece_to_id("▁")
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: An id and what follows it: A's within and at the end of a group, B's likewise.
        self.said = [f"{i}{mark}" for mark in ",|,;" for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self._forget()

    def _keep_used(self) -> None:
        """Forgets the chunks that no later slice than their first held."""
        kept = np.flatnonzero(np.frombuffer(self.used, np.uint8))
        words, strings, facts = list(self.known), self.strings, np.frombuffer(self.facts, np.int64).reshape(-1, 5)[kept]
        ends = np.frombuffer(self.ends, np.int64)
        (keys, at), (times, _) = (_gather(np.frombuffer(x, np.int64) if x else ends[:0], ends, kept) for x in (self.keys, self.times))
        del ends
        self._forget()
        if len(kept) < CACHE_CHUNKS // 2 and len(keys) < CACHE_TOKENS // 2:
            self.known = {words[k]: n for n, k in enumerate(kept.tolist())}
            self.strings = [strings[k] for k in kept.tolist()]
            self.used = bytearray(len(kept))
            for pool, values in ((self.facts, facts), (self.keys, keys), (self.times, times), (self.ends, at[1:])):
                pool.frombytes(np.ascontiguousarray(values).tobytes())

    def _forget(self) -> None:
        self.used = bytearray()
        self.known: dict[str, int] = {}
        self.strings: list[bytes] = []
        #: n_a, n_b, n_groups, n_links and whether the bytes differ, of each chunk.
        self.facts = array("q")
        self.keys, self.times, self.ends = array("q"), array("q"), array("q", [0])

    def spans(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Of chunks that stand one behind another: ids, byte ends and chunk numbers of A's tokens, then of B's, and the chunks' begins and end."""
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        chars = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        starts = char_at[chars]
        encoded = self.a.encode_batch(words, add_special_tokens=False)
        lists = [e.ids for e in encoded]
        counts = np.array([len(x) for x in lists], np.int64)
        ids_a = np.array(list(chain.from_iterable(lists)), np.int64)
        offsets = [e.offsets for e in encoded]
        begins, ends = np.fromiter(chain.from_iterable(chain.from_iterable(offsets)), np.int64).reshape(-1, 2).T
        of_a = np.repeat(np.arange(len(words)), counts)
        last = np.append(of_a[1:] != of_a[:-1], True) if len(of_a) else np.zeros(0, bool)
        if len(char_at) <= len(raw):  # else every character is a byte, and no two tokens share one
            exact = last | (np.append(begins[1:], 0) >= ends)
        else:
            exact = np.ones(len(ends), bool)
        firsts = np.repeat(np.cumsum(counts) - counts, counts)
        ends_a = refined(char_at[chars[of_a] + ends], exact, self.sizes_a[ids_a], firsts, starts[of_a])
        found = [[(self.blank, 0)] if w == " " else [(q.id, q.end) for q in p.pieces] for w, p in zip(words, self.b.encode([w[1:] for w in words], return_type="proto"), strict=True)]
        counts = np.array([len(f) for f in found], np.int64)
        spans = np.array(list(chain.from_iterable(chain.from_iterable(found))), np.int64).reshape(-1, 2)
        of_b = np.repeat(np.arange(len(words)), counts)
        coarse = starts[of_b] + spans[:, 1] + 1  # the model's own blank comes first
        first = np.append(True, of_b[1:] != of_b[:-1]) if len(of_b) else np.zeros(0, bool)
        exact = coarse > np.where(first, starts[of_b], np.append(0, coarse[:-1])) if len(of_b) else first
        firsts = np.repeat(np.cumsum(counts) - counts, counts)
        return ids_a, ends_a, of_a, spans[:, 0], refined(coarse, exact, self.sizes_b[spans[:, 0]], firsts, starts[of_b]), of_b, starts

    def _unaltered(self, words: list[str], ids_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, of_b: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word whether the bytes of its tokens are its own, for both tokenizers."""
        raw = "".join(words).encode()
        same = np.ones(len(words), bool)
        for ids, of, table, sizes in ((ids_a, of_a, self.bytes_a, self.sizes_a), (ids_b, of_b, self.bytes_b, self.sizes_b)):
            joined = b"".join(map(table.__getitem__, ids.tolist()))
            at = np.concatenate([[0], np.cumsum(sizes[ids])])[np.searchsorted(of, np.arange(len(words) + 1))].tolist()
            same &= np.fromiter((joined[a:b] == raw[c:d] for a, b, c, d in zip(at, at[1:], starts.tolist(), starts[1:].tolist())), bool, len(words))
        return same

    def _learn(self, words: list[str]) -> None:
        """Chunks are tokenised many in one call where a blank splits them; those of a call whose tokens differ from its
        bytes or go over a chunk's end are tokenised again in smaller calls, at last each alone."""
        alone = [w for w in words if w[-1] in JOINS_BLANKS]
        if alone:
            words = [w for w in words if w[-1] not in JOINS_BLANKS]
        for size in JOINED:
            if not words:
                break
            calls = ["".join(words[k : k + size]) for k in range(0, len(words), size)]
            ids_a, ends_a, of_a, ids_b, ends_b, of_b, starts = self.spans(calls)
            good = self._unaltered(calls, ids_a, of_a, ids_b, of_b, starts)
            call = np.arange(len(words)) // size
            raw = np.frombuffer("".join(calls).encode(), np.uint8)
            char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
            ends = char_at[np.cumsum([len(w) for w in words])]
            for found in (ends_a, ends_b):
                good[call[~np.isin(ends, found)]] = False
            kept = good[call]
            number = np.cumsum(kept) - 1
            tokens = []
            for ids, at, of in ((ids_a, ends_a, of_a), (ids_b, ends_b, of_b)):
                held = good[of]
                tokens += [ids[held], at[held], number[np.searchsorted(ends, at[held])]]
            self._store(words if kept.all() else [w for w, k in zip(words, kept.tolist()) if k], *tokens)
            words = [] if kept.all() else [w for w, k in zip(words, kept.tolist()) if not k]
        alone += words
        if alone:
            ids_a, ends_a, of_a, ids_b, ends_b, of_b, starts = self.spans(alone)
            self._store(alone, ids_a, ends_a, of_a, ids_b, ends_b, of_b, self._unaltered(alone, ids_a, of_a, ids_b, of_b, starts))

    def _store(self, words: list[str], ids_a: np.ndarray, ends_a: np.ndarray, of_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, of_b: np.ndarray, same: np.ndarray | None = None) -> None:
        """Remembers the chunks with their tokens, groups and links; ``same``: which chunks' bytes are kept (else all)."""
        if not words:
            return
        same = np.ones(len(words), bool) if same is None else same
        counts = [np.bincount(of, minlength=len(words)) for of in (of_a, of_b)]
        keep_a, keep_b = same[of_a], same[of_b]
        ids_a, ends_a, of_a, ids_b, ends_b = ids_a[keep_a], ends_a[keep_a], of_a[keep_a], ids_b[keep_b], ends_b[keep_b]
        # groups: both end at the same places
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(common, ends_a), np.searchsorted(common, ends_b)
        n_a, n_b = np.bincount(group_a, minlength=len(common)), np.bincount(group_b, minlength=len(common))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        of = of_a[first_a] if len(common) else of_a[:0]
        groups = np.bincount(of, minlength=len(words))
        links = np.bincount(of, weights=n_a * n_b, minlength=len(words)).astype(np.int64)
        # linked pairs: each A token of a usual group with each B token; ids of a large group are counted first
        usual = n_a * n_b <= LARGE
        mine = np.flatnonzero(usual[group_a]) if len(common) else group_a
        times = n_b[group_a[mine]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        keys, owner, much = [np.repeat(ids_a[mine], times) * B_IDS + ids_b[np.repeat(first_b[group_a[mine]], times) + within]], [np.repeat(of_a[mine], times)], [np.ones(len(within), np.int64)]
        for g in np.flatnonzero(~usual):
            (x, n), (y, m) = (np.unique(ids[f : f + c], return_counts=True) for ids, f, c in ((ids_a, first_a[g], n_a[g]), (ids_b, first_b[g], n_b[g])))
            keys.append((x[:, None] * B_IDS + y).ravel())
            owner.append(np.full(len(keys[-1]), of[g]))
            much.append((n[:, None] * m).ravel())
        keys, owner, much = np.concatenate(keys), np.concatenate(owner), np.concatenate(much)
        order = np.argsort(owner, kind="stable")
        # the groups as text: A's ids, then B's, each with the mark that follows it
        said = np.zeros(len(ids_a) + len(ids_b), np.int64)
        kinds = len(self.said) // 4
        end_a, end_b = np.append(group_a[1:] != group_a[:-1], True)[: len(ids_a)], np.append(group_b[1:] != group_b[:-1], True)[: len(ids_b)]
        said[np.arange(len(ids_a)) + first_b[group_a]] = ids_a + kinds * end_a
        said[np.arange(len(ids_b)) + (first_a + n_a)[group_b]] = ids_b + kinds * (2 + end_b)
        words_said = list(map(self.said.__getitem__, said.tolist()))
        at = np.concatenate([[0], np.cumsum(same * (counts[0] + counts[1]))]).tolist()
        number = len(self.strings)
        self.known.update(zip(words, range(number, number + len(words)), strict=True))
        self.strings += ["".join(words_said[a:b])[:-1].encode() for a, b in zip(at, at[1:])]
        self.facts.frombytes(np.stack([counts[0], counts[1], groups, links, ~same], 1).astype(np.int64).tobytes())
        self.ends.frombytes((len(self.keys) + np.cumsum(np.bincount(owner, minlength=len(words)))).astype(np.int64).tobytes())
        self.keys.frombytes(keys[order].tobytes())
        self.times.frombytes(much[order].tobytes())

    def codes(self, chunks: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_CHUNKS or len(self.keys) > CACHE_TOKENS:
            self._keep_used()
        before = len(self.strings)
        fresh = [c for c in chunks if c not in self.known]
        for at in range(0, len(fresh), 2000):
            self._learn(fresh[at : at + 2000])
        out = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        self.used.extend(bytes(len(self.strings) - before))
        np.frombuffer(self.used, np.uint8)[out[out < before]] = 1
        return out

    def slice(self, texts: pa.Array) -> dict:
        """What is written of a slice of texts; see ``SLICES``."""
        some = pc.fill_null(pc.not_equal(texts, ""), False).to_numpy(zero_copy_only=False)
        data, rows = raw_bytes(pc.binary_join_element_wise(pc.if_else(pa.array(some), " ", ""), pc.fill_null(texts, ""), ""))
        starts = chunk_starts(data, rows)
        ends = np.append(starts, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        place = coded.indices.to_numpy()
        code = self.codes(coded.dictionary.to_pylist())
        row_at = np.searchsorted(starts, rows)  # chunks before each row
        facts = np.frombuffer(self.facts, np.int64).reshape(-1, 5)[code] if len(code) else np.zeros((0, 5), np.int64)
        running = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(facts[place], axis=0)])
        numbers = running[row_at[1:]] - running[row_at[:-1]]
        good = some & (numbers[:, 4] == 0)
        numbers[~good] = 0
        strings = [self.strings[c] for c in code[place].tolist()]
        digests = [hashlib.sha256(b";".join(strings[a:b])).hexdigest() if ok else "" for a, b, ok in zip(row_at[:-1].tolist(), row_at[1:].tolist(), good.tolist(), strict=True)]
        # the pairs of the slice's distinct chunks, then of its texts
        pool_at = np.frombuffer(self.ends, np.int64)
        keys, at = _gather(np.frombuffer(self.keys, np.int64) if self.keys else np.zeros(0, np.int64), pool_at, code)
        times, _ = _gather(np.frombuffer(self.times, np.int64) if self.times else np.zeros(0, np.int64), pool_at, code)
        distinct, keys = np.unique(keys, return_inverse=True)
        row = np.repeat(np.arange(len(texts)), np.diff(row_at))
        held = good[row]
        place, row = place[held], row[held]
        pair, pair_at = _gather(keys, at, place)
        much, _ = _gather(times, at, place)
        whole = np.repeat(row, np.diff(pair_at)) * max(1, len(distinct)) + pair
        order = np.argsort(whole)
        whole = whole[order]
        begins = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, np.int64)
        much = np.add.reduceat(much[order], begins) if len(begins) else much[:0]
        row, pair = np.divmod(whole[begins], max(1, len(distinct)))
        holders = np.bincount(pair, minlength=len(distinct))
        seen = holders > 0
        dense = np.cumsum(seen) - 1
        return {"numbers": numbers[:, :4], "digests": digests, "keys": distinct[seen], "holders": holders[seen], "ends": np.searchsorted(row, np.arange(len(texts) + 1)), "pairs": dense[pair], "times": much}


def _gather(pool: np.ndarray, pool_at: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pool's runs ``items`` in a row, and their offsets."""
    sizes = np.diff(pool_at)[items]
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pool[np.arange(ends[-1]) + np.repeat(pool_at[items] - ends[:-1], sizes)], ends


#: A row for each slice. Of its texts: ids, digests, ``numbers`` (four each), ``ends`` of their runs in ``pairs`` (places in
#: ``keys``, steps upwards within a run) and ``times`` (links). Of its pairs: ``keys`` and how many texts hold each.
SLICES = "slice long, doc_ids array<long>, digests array<string>, numbers binary, keys array<long>, holders array<long>, ends binary, pairs binary, times binary"


def sliced(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    def build():
        from pyspark import TaskContext

        aligner, context = Aligner(path_a, path_b), TaskContext.get()
        numbers = iter(range((context.partitionId() if context else 0) << 32, 1 << 62))

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            out = aligner.slice(part.column("text"))
            steps = np.diff(out["pairs"], prepend=0)
            begins = out["ends"][:-1][np.diff(out["ends"]) > 0]
            steps[begins] = out["pairs"][begins]
            lists = [pa.array([v], k) for v, k in ((part.column("doc_id").to_pylist(), pa.list_(pa.int64())), (out["digests"], pa.list_(pa.string())))]
            blob = lambda v, kind: pa.array([np.ascontiguousarray(v).astype(kind).tobytes()], pa.binary())
            columns = [pa.array([next(numbers)], pa.int64()), *lists, blob(out["numbers"], "<i8"), pa.array([out["keys"]], pa.list_(pa.int64())), pa.array([out["holders"]], pa.list_(pa.int64())), blob(out["ends"], "<i8"), blob(steps, "<u4"), blob(out["times"], "<i8")]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SLICES.split(", ")])

        return work

    return map_texts(docs, SLICES, build, limit=SLICE)


def pair_counts(slices: DataFrame) -> DataFrame:
    """key, count (texts that hold the pair linked), best (whether no pair of the A id has a higher one)."""
    held = slices.select(F.explode(F.arrays_zip("keys", "holders")).alias("p")).select(F.col("p.keys").alias("key"), F.col("p.holders").alias("holders"))
    counts = held.groupBy("key").agg(F.sum("holders").alias("count"))
    a = F.shiftright("key", B_IDS.bit_length() - 1)
    counts = counts.select("key", "count", a.alias("a"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("key", "count", (F.col("count") == F.col("most")).alias("best"))


class Slice:
    """A written slice, read back."""

    def __init__(self, row: dict):
        self.numbers = np.frombuffer(row["numbers"], "<i8").reshape(-1, 4)
        self.keys = np.array(row["keys"], np.int64)
        self.ends, self.times = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["times"], "<i8")
        steps = np.cumsum(np.frombuffer(row["pairs"], "<u4").astype(np.int64))
        before = np.concatenate([[0], steps])[self.ends[:-1]]
        self.rows = np.repeat(np.arange(len(self.numbers)), np.diff(self.ends))
        self.pairs = steps - before[self.rows]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """For each text the sum of ``values`` of its pairs, each as often as it is linked."""
        running = np.concatenate([[0], np.cumsum(values[self.pairs] * self.times)])
        return running[self.ends[1:]] - running[self.ends[:-1]]


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the ascending ``keys``, and whether the wanted ones are there."""
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return place, keys[place] == wanted if len(keys) else np.zeros(len(wanted), bool)


ROWS = "slice long, row int, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot: int = HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every row of ``docs``."""
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path("byte_bpe_50k.json"), path_b or public_tokenizers.path("piece_bpe_32k.model")
    slices = materialize(sliced(documents_only(docs), path_a, path_b), "slices")
    counts = materialize(pair_counts(slices), "pairs")
    top = counts.orderBy(F.desc("count"), "key").limit(hot).toArrow()  # ``hot`` rows of three numbers
    order = np.argsort(top.column("key").to_numpy())
    keys, count, best = (top.column(c).to_numpy()[order].astype(np.int64) for c in ("key", "count", "best"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Slice(row)
                place, there = _found(keys, s.keys)
                sums = [s.sums(np.where(there, v[place] if len(v) else 0, 0)) for v in (best, count)]
                n = len(s.numbers)
                columns = [np.full(n, row["slice"]), np.arange(n), row["doc_ids"], *s.numbers.T, *sums, row["digests"]]
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 7, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in ROWS.split(", ")])

    done = slices.drop("holders").mapInArrow(tidy(near), ROWS)
    if len(keys) < hot:  # those were all
        return done.select(*RESULT)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Slice(row)
                left = ~_found(keys, s.keys)[1][s.pairs]
                columns = [pa.array(np.full(int(left.sum()), row["slice"]), pa.int64()), pa.array(s.rows[left], pa.int32()), pa.array(s.keys[s.pairs[left]], pa.int64()), pa.array(s.times[left], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["slice", "row", "key", "times"])

    far = slices.select("slice", "numbers", "keys", "ends", "pairs", "times").mapInArrow(tidy(rare), "slice long, row int, key long, times long").join(counts, "key")
    more = far.groupBy("slice", "row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("count")).alias("more_count"))
    added = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more_count", F.lit(0))}
    return done.join(more, ["slice", "row"], "left").withColumns(added).select(*RESULT)


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
