"""Toxicity: character n-gram embeddings averaged into a linear softmax, trained jointly in numpy.

A text is its byte n-grams (3 to 5 bytes inside a word, word ends included), hashed into a table of
embeddings; a word that repeats the one before it adds nothing new. The average of the embeddings goes through a linear softmax. Embeddings and softmax are
trained together, so misspelt words score by the n-grams they share with known ones. For scoring, the
softmax is folded into one number for each bucket, which is exact because everything is linear.

A long text is scored in overlapping windows that cover it whole, and its score is the largest window's,
so that a few toxic words are not averaged away.

Defined cases: null and empty texts (no n-gram) get the score of the bias alone, as all-punctuation
texts do; without labels every score is 0.5; repeated rows get equal scores; a null doc_id is kept; an empty
table gives no rows; other columns are ignored; texts of any length are read whole, and one must fit a task's memory
(about 75 bytes for each of its bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, documents_only, map_texts, raw_bytes, table, word_hashes
from .sampling import held_out, labelled_sample

BUCKETS, DIM, SIZES = 1 << 18, 8, (3, 4, 5)
WINDOW, STRIDE = 1024, 512
#: Zero vectors that every average also holds, so that a handful of n-grams decides nothing alone.
PRIOR = 200
#: The training sample's bound: documents of each class, and code points of one (longer texts in windows spread over them).
PER_CLASS, MAX_CHARS = (5000, 2500), 4000
EPOCHS, BATCH, RATE = 6, 64, 0.5
#: Small samples are gone through more often, so that there are at least so many updates.
LEAST_UPDATES = 400

#: Letters, digits and all bytes of non-ASCII characters are word bytes; the rest ends a word.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
FOLD = np.where(WORD, LOWER, 32).astype(np.uint8)


def ngrams(data: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each n: the buckets of the n-grams that begin at each byte, and which of them are inside one word.

    ``data`` must begin and end with a word end. The first and last byte of an n-gram may be one.
    """
    x = FOLD[data]
    inner = x != 32
    fresh = inner & ~_repeats(x, inner)
    wide = x.astype(np.uint32)
    buckets, valid = [], []
    for n in SIZES:
        m = max(0, len(x) - n + 1)
        h = np.full(m, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        ok = fresh[1 : m + 1].copy()
        for k in range(n):
            h = (h ^ wide[k : k + m]) * np.uint32(16777619)
            if 1 < k < n - 1:
                ok &= inner[k : k + m]
        h ^= h >> np.uint32(15)
        buckets.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 18))
        valid.append(ok)
    return buckets, valid


def _repeats(x: np.ndarray, inner: np.ndarray) -> np.ndarray:
    """Which bytes belong to a word that equals the word before it."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inner, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    out = np.zeros(len(x) + 1, np.int8)
    if len(starts) > 1:
        h = word_hashes(x, starts, ends)
        again = np.flatnonzero(h[1:] == h[:-1]) + 1
        out[starts[again]] += 1
        out[ends[again]] -= 1
    return np.cumsum(out[:-1], dtype=np.int8).astype(bool)


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a word end before, between and after them, and where each begins."""
    data = b"\n" + b"\n".join(texts) + b"\n"
    return np.frombuffer(data, np.uint8), np.concatenate([[1], 1 + np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def train(texts: list[str], labels: list[int], seed: int = 7) -> tuple[np.ndarray, float]:
    """The weight of each bucket and the bias, both of the folded softmax (class 1 minus class 0)."""
    if not texts:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    raw, y = [t.encode() for t in texts], np.array(labels, np.float64)
    # a rare class 1 counts as if it were half as frequent as class 0
    rare = max(1.0, 0.5 * (y == 0).sum() / max(1, (y == 1).sum()))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    soft, bias = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2)
    seen, seen_soft, seen_bias = np.full(BUCKETS, 1e-8), np.full((DIM, 2), 1e-8), np.full(2, 1e-8)
    epochs = max(EPOCHS, -(-LEAST_UPDATES * BATCH // len(raw)))
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            data, starts = padded([raw[i] for i in pick])
            first = np.concatenate([[0], starts[1:-1] - 1])
            ids, docs, total, count = [], [], np.zeros((len(pick), DIM)), np.zeros(len(pick), np.int64)
            for b, ok in zip(*ngrams(data), strict=True):
                where = np.flatnonzero(ok)
                at_doc = np.searchsorted(where, first)
                of = np.repeat(np.arange(len(pick)), np.diff(np.append(at_doc, len(where))))
                count += np.bincount(of, minlength=len(pick))
                some = np.flatnonzero(np.diff(np.append(at_doc, len(where))))
                if len(some):
                    total[some] += np.add.reduceat(emb[b[where]], at_doc[some], axis=0)
                ids.append(b[where])
                docs.append(of)
            share = 1 / (count + PRIOR)
            mean = total * share[:, None]
            z = mean @ soft + bias
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick].astype(int)] -= 1
            p *= np.where(y[pick] == 1, rare, 1.0)[:, None]
            # of two classes: every n-gram of a text has the gradient error * (soft[1] - soft[0]), by its share
            way = soft[:, 1] - soft[:, 0]
            grad = np.bincount(np.concatenate(ids), (p[:, 1] * share)[np.concatenate(docs)], BUCKETS)
            touched = np.flatnonzero(grad)
            grad = grad[touched]
            seen[touched] += grad**2 * float(way @ way) / DIM
            emb[touched] -= (rate * grad / np.sqrt(seen[touched])).astype(np.float32)[:, None] * way
            for value, g, acc in ((soft, mean.T @ p / len(pick), seen_soft), (bias, p.mean(0), seen_bias)):
                acc += g**2
                value -= (rate * 0.2 * g / np.sqrt(acc)).astype(value.dtype)
    return (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """The score of each row: the largest over its windows, which overlap and cover the whole text."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    # one word end is set before every row and one behind the last
    spread = np.full(len(data) + rows + 1, 10, np.uint8)
    row_of = np.repeat(np.arange(rows), size)
    spread[np.arange(len(data)) + row_of + 1] = data
    starts = offsets[:-1] + np.arange(rows) + 1
    total, count = np.zeros(len(spread) + 1), np.zeros(len(spread) + 1, np.int64)
    value, number = np.zeros(len(spread), np.float32), np.zeros(len(spread), np.int8)
    for b, ok in zip(*ngrams(spread), strict=True):
        value[: len(b)] += weights[b] * ok
        number[: len(b)] += ok
    np.cumsum(value, out=total[1:], dtype=np.float64)
    np.cumsum(number, out=count[1:])
    windows = np.maximum(1, -(-(size - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(rows), windows)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    # n-grams may begin at the word end before a row
    begin = starts[row] - 1 + nth * STRIDE
    end = np.minimum(begin + WINDOW + 1, starts[row] + size[row])
    logit = (total[end] - total[begin]) / (count[end] - count[begin] + PRIOR) + bias
    best = np.maximum.reduceat(logit, np.cumsum(windows) - windows) if rows else logit
    return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def toxicity(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """doc_id, score of every whole text."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(*raw_bytes(part.column("text")), weights, bias))], ["doc_id", "score"])

        return work

    return map_texts(documents_only(docs), "doc_id long, score double", build)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> tuple[np.ndarray, float]:
    sample = labelled_sample(docs, labels, label, ~held_out(5, 0), per_class, MAX_CHARS)
    return train([t for t, _ in sample], [y for _, y in sample])


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, *fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
