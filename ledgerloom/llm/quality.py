"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of width ``WIDTH`` slide over the bytes of overlapping chunks that cover the whole document;
each filter is max-pooled within a chunk, and the chunk maxima are combined by their mean and their maximum
over the document into one probability. Responses are worked out for ``TOGETHER`` chunks at a time.

Training works on a bounded labelled sample with Adam; the gradient of a max-pool goes to one place of
each chunk only, so it is sparse.

Defined cases: null and empty texts are one chunk of padding and get that chunk's score; without
labels every score is 0.5; repeated rows get equal scores; an empty table gives no rows; other columns are
ignored (``accepted`` carries them along); texts of any length are read whole, in memory of about five bytes for
each of theirs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, map_texts, raw_bytes, table, text_slices, tidy
from .sampling import held_out, labelled_sample

FILTERS, WIDTH, SYMBOLS = 16, 5, 256
CHUNK, STEP = 512, 480
#: Chunks whose responses are held at once.
TOGETHER = 256
#: The training sample's bound: documents of each class, and code points of one (longer texts in windows spread over them).
PER_CLASS, MAX_CHARS = (2000, 2000), 4000
EPOCHS, BATCH, RATE = 6, 32, 0.01
#: Small samples are gone through more often, so that there are at least so many updates.
LEAST_UPDATES = 400


def spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with ``WIDTH`` zero bytes before each and behind the last, and where each begins, so that
    no filter reaches from one row into another."""
    rows = len(offsets) - 1
    out = np.zeros(len(data) + (rows + 1) * WIDTH, np.uint8)
    starts = offsets[:-1] + WIDTH * (np.arange(rows) + 1)
    for a, b, at in zip(offsets[:-1].tolist(), offsets[1:].tolist(), starts.tolist(), strict=True):
        out[at : at + b - a] = data[a:b]
    return out, starts


def chunks(starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and row of the overlapping chunks that cover every row."""
    number = np.maximum(1, -(-(size - CHUNK) // STEP) + 1)
    row = np.repeat(np.arange(len(size)), number)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
    begin = starts[row] + nth * STEP
    return begin, np.minimum(begin + CHUNK, (starts + size)[row]), row


class Network:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.table = rng.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.head = rng.normal(0, 0.1, 2 * FILTERS)
        self.shift = np.zeros(1)

    def pooled(self, sym: np.ndarray, begin: np.ndarray, end: np.ndarray, where: bool = False):
        """The largest response of each filter in each chunk, and where it was (responses begin inside the chunk)."""
        out = np.zeros((len(begin), FILTERS), np.float32)
        at = np.zeros((len(begin), FILTERS), np.int64) if where else None
        for c in range(0, len(begin), TOGETHER):
            low = int(begin[c])
            # chunks come in order, and zero bytes follow the last
            high = max(low + 1, int(end[c : c + TOGETHER].max()))
            part = sym[low : high + WIDTH - 1]
            act = self.table[0][part[: high - low]] + self.bias
            for k in range(1, WIDTH):
                act += self.table[k][part[k : k + high - low]]
            for i, (a, b) in enumerate(zip((begin[c : c + TOGETHER] - low).tolist(), (end[c : c + TOGETHER] - low).tolist(), strict=True), c):
                if b > a:
                    if where:
                        at[i] = low + a + act[a:b].argmax(0)
                    out[i] = act[a:b].max(0)
        np.maximum(out, 0, out=out)
        return (out, at) if where else out

    def combine(self, out: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        starts = np.searchsorted(row, np.arange(rows))
        mean = np.add.reduceat(out, starts, axis=0) / np.bincount(row, minlength=rows)[:, None]
        most = np.maximum.reduceat(out, starts, axis=0)
        both = np.concatenate([mean, most], 1)
        return both, both @ self.head + self.shift

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows = len(offsets) - 1
        if not rows:
            return np.zeros(0)
        wide, starts = spread(data, offsets)
        begin, end, row = chunks(starts, np.diff(offsets))
        _, z = self.combine(self.pooled(wide, begin, end), row, rows)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(texts: list[str], labels: list[int], seed: int = 3) -> Network:
    net = Network(seed)
    if not texts:
        net.head[:] = 0
        return net
    rng = np.random.default_rng(seed)
    raw, y = [t.encode() for t in texts], np.array(labels, np.float64)
    parts = [net.table, net.bias, net.head, net.shift]
    first, second = [np.zeros_like(p, dtype=np.float32) for p in parts], [np.zeros_like(p, dtype=np.float32) for p in parts]
    step = 0
    epochs = max(EPOCHS, -(-LEAST_UPDATES * BATCH // len(raw)))
    for epoch in range(epochs):
        order = rng.permutation(len(raw))
        rate = RATE * (1 - 0.9 * epoch / epochs)
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            data = np.frombuffer(b"".join(raw[i] for i in pick), np.uint8)
            offsets = np.concatenate([[0], np.cumsum([len(raw[i]) for i in pick])])
            wide, starts = spread(data, offsets)
            begin, end, row = chunks(starts, np.diff(offsets))
            out, at = net.pooled(wide, begin, end, True)
            both, z = net.combine(out, row, len(pick))
            error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
            grads = [np.zeros_like(net.table), None, both.T @ error + 1e-4 * net.head, np.array([error.sum()])]
            back = error[row, None] * net.head[None, :FILTERS] / np.bincount(row)[row, None]
            back = back + error[row, None] * net.head[None, FILTERS:] * (out == both[row, FILTERS:])
            back *= out > 0
            grads[1] = back.sum(0)
            for k in range(WIDTH):
                np.add.at(grads[0][k], (wide[np.minimum(at + k, len(wide) - 1)], np.arange(FILTERS)[None, :]), back)
            step += 1
            for p, g, m, v in zip(parts, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * np.square(g)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(p.dtype)
    return net


def quality(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, score of every whole text."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(net.scores(*raw_bytes(part.column("text"))))], ["doc_id", "score"])

        return work

    return map_texts(documents_only(docs), "doc_id long, score double", build)


def accepted(docs: DataFrame, net: Network, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text's score reaches the threshold."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                keep = net.scores(*raw_bytes(part.column("text").fill_null(""))) >= threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: tuple[int, int] = PER_CLASS) -> Network:
    sample = labelled_sample(docs, labels, label, ~held_out(5, 0), per_class, MAX_CHARS)
    return train([t for t, _ in sample], [y for _, y in sample])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
