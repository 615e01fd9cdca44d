"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups.

Documents are tokenised where they are read. Each becomes full pieces of 2048 ids and one remainder. Full
pieces are sequences by themselves. Only the remainders' numbers (never ids or texts) are shuffled, to groups
chosen by hash. A group is packed on its own, so its size, not the table's, bounds a task.

Defined cases: a null or empty text is the single end id; the tokenizer is used as it is, so special tokens
written out in a text become their ids; repeated rows are packed once each (the group also hashes a row's
place, so copies and null ids spread over groups); an empty table gives no rows; other columns are ignored.
One text with its ids must fit a task's memory (about 30 bytes for each of its bytes).
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, materialize, table, text_slices, tidy

SEQUENCE, END_ID = 2048, 1
GROUP_DOCS = 16_384
#: Distinct words whose ids a worker remembers.
CACHE_WORDS = 400_000
TOKEN_SLICE = 2 << 20

#: Chunks made of these only are split into letter runs and other runs; the rest go to the tokenizer whole.
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-;=-@\[-`{-~]*$"
OTHER_RUN = r"([^A-Za-zÀ-ÖØ-öø-ÿ]+)"


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's printable stand-in for every byte (by its public rule)."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: b for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = 256 + n
    return out


class WordTokenizer:
    """Token ids of texts, tokenising each distinct white-space chunk once.

    The vocabulary's pre-tokeniser never joins text over white space, so chunks are independent; inside
    a plain chunk (no apostrophe, Latin letters only) letter runs and other runs are independent too.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.is_letters = re.compile(r"[a-zß-öø-ÿ]+").fullmatch
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, int] = {}
        self.pool, self.ends = array("I"), array("q", [0])

    def _keep(self, word: str, ids: list[int]) -> None:
        self.words[word] = len(self.ends) - 1
        self.pool.extend(ids)
        self.ends.append(len(self.pool))

    def _known(self, words: list[str]) -> np.ndarray:
        """The words' places in the pool; new words are tokenised first."""
        known, slow, tokenize = self.words, [], self.tokenizer.model.tokenize
        for w in words:
            if w not in known:
                if self.is_letters(w):
                    self._keep(w, [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))])
                else:
                    slow.append(w)
        for at in range(0, len(slow), 2000):
            part = slow[at : at + 2000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self._keep(w, e.ids)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and the row offsets into them."""
        lists = pc.ascii_split_whitespace(texts)
        row_ends = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        chunks, codes = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(chunks, PLAIN).to_numpy(zero_copy_only=False) if len(chunks) else np.zeros(0, bool)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(chunks.filter(pa.array(plain))), OTHER_RUN, r" \1 "))
        words = parts.flatten().dictionary_encode()
        if len(self.words) > CACHE_WORDS:
            self._forget()
        simple = self._known(words.dictionary.to_pylist())
        odd = self._known(chunks.filter(pa.array(~plain)).to_pylist())
        # each distinct chunk as a run of pool places: the plain ones' words, then one place for each odd chunk
        places = np.concatenate([simple[words.indices.to_numpy()], odd])
        ends = parts.offsets.to_numpy()
        ends = np.concatenate([ends - ends[0], len(words) + np.arange(1, len(odd) + 1)]).astype(np.int64)
        chunk = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        # views, gone when this returns: the arrays may grow again
        pool, pool_at = np.frombuffer(self.pool, np.uint32) if self.pool else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        ids, at = _gather(pool, pool_at, places, ends)
        return _gather(ids, at, chunk[codes], row_ends - row_ends[0])


def _gather(pool: np.ndarray, pool_at: np.ndarray, items: np.ndarray, row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins the pool's runs ``items`` in order; ``row_at`` groups the items, and so the ids, by row."""
    if not len(items):
        return pool[:0].copy(), np.zeros(len(row_at), np.int64)
    sizes = np.diff(pool_at)[items]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    index = np.arange(ends[-1]) + np.repeat(pool_at[items] - ends[:-1], sizes)
    return pool[index], ends[row_at]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, place long"


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of a document: full pieces first, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, context = WordTokenizer(vocabulary), TaskContext.get()
        place = (context.partitionId() if context else 0) << 36
        for batch in batches:
            for part in text_slices(batch, limit=TOKEN_SLICE):
                ids, at = words.encode(part.column("text"))
                n, out = part.num_rows, []
                keys = part.column("doc_id").to_pylist()
                for i in range(n):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END_ID)).astype("<u4")
                    for s in range(0, len(own), sequence):
                        place += 1
                        out.append((keys[i], s, min(sequence, len(own) - s), zlib.crc32(own[s : s + sequence].tobytes()), len(own), place))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "place"])

    return docs.mapInArrow(tidy(run), PIECES)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length. ``lengths`` must be in falling order.

    The tournament tree holds the largest free capacity below each node; the leftmost leaf that fits is
    found by going down from the root.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins = np.empty(n, np.int64)
    for i, need in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i] = node - leaves
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(made: DataFrame, group_pieces: int = GROUP_DOCS, sequence: int = SEQUENCE) -> DataFrame:
    """Packs pieces into sequences: full ones by themselves, the others in random groups of about ``group_pieces``.

    ``sequence_id`` holds the group in its upper bits and the group's own bin in the lower 32; those of full
    pieces are negative.
    """
    parts = made.where(F.col("length") < sequence)
    groups = max(1, math.ceil(parts.count() / group_pieces))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "place"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        lengths = rows["length"].to_numpy()
        rows["sequence_id"] = (int(key[0]) << 32) + first_fit_decreasing(lengths, sequence)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - lengths
        return rows[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    dealt = parts.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "place"), F.lit(groups)))
    full = made.where(F.col("length") >= sequence).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (-F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("pack_group").applyInPandas(one, PACKED).unionByName(full)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, sequence: int = SEQUENCE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Packs every document; groups hold about ``group_docs`` remainders whatever the table's size. The pieces'
    numbers are written to the shared folder once, so that texts are tokenised once."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    made = materialize(pieces(documents_only(docs), vocabulary, sequence), "pieces")
    return pack(made, group_docs, sequence)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
