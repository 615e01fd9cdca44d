"""Line dedup with a log-template tree: fixed-depth parsing generalises variable fields of lines.

A line goes down a tree of fixed depth: its token count, then its first ``LEADING`` tokens (a token with
a digit counts as ``<*>``), then ``SEGMENTS`` runs of its tokens. Besides the branch of all segments as
they stand, a line of at least ``SEGMENTS`` tokens takes those with one segment left open, so lines that
differ in one variable field meet in a template. Every branch end is a 64-bit key.

A template recurs if enough documents hold it (fewer for long lines, see ``LEAST``). Lines of recurring
templates are dropped, but for the document with the smallest doc_id that holds the template, so of copies
of a document the first alone keeps its lines.

Defined cases: null and empty texts have no line; blank lines are never dropped; lines repeated inside a
document count once for it and are dropped or kept together; rows with a null doc_id count for templates and are
left as they are; rows that share a doc_id are judged by the same set of templates; an empty table gives no
rows; other columns are carried along. One text with its templates must fit a task's memory (about 200 bytes
for each of its lines and 40 for each of its bytes).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_only, map_texts, materialize, mix64, raw_bytes, table, text_slices, tidy, word_hashes, word_spans
from .similarity_join import sketch

LEADING, SEGMENTS = 3, 8
#: Fewest documents with a template, by its lines' tokens: at least so many tokens, so many documents.
LEAST = ((40, 2), (16, 3), (8, 5), (0, 10))
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_ANY = mix64(np.array([0x2A], np.uint64))[0]
BITS = 22


def line_offsets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all lines (a line holds its line feed) and the row of each; every row has one line at least."""
    ends = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    rows = np.searchsorted(offsets, ends[:-1], side="right") - 1
    return ends, rows


def template_keys(data: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """keys (lines x 1 + SEGMENTS; the first is the line as it stands) and token counts. Keys of lines
    without tokens, and of open segments of short lines, are 0."""
    n_lines = len(lines) - 1
    starts, ends, line = word_spans(data, lines)
    count = np.bincount(line, minlength=n_lines)
    keys = np.zeros((n_lines, 1 + SEGMENTS), np.uint64)
    if not len(starts):
        return keys, count
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    words = np.where(digits[ends] > digits[starts], _ANY, word_hashes(data, starts, ends))
    place = np.arange(len(words)) - (np.cumsum(count) - count)[line]
    value = mix64(words + place.astype(np.uint64) * _PLACE)
    leaf = mix64(count.astype(np.uint64) + np.uint64(77))
    lead = place < LEADING
    np.add.at(leaf, line[lead], mix64(value[lead]))
    segment = place * SEGMENTS // count[line]
    run = line * SEGMENTS + segment
    begin = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    parts = np.zeros((n_lines, SEGMENTS), np.uint64)
    parts.reshape(-1)[run[begin]] = mix64(np.add.reduceat(value, begin) + (run[begin] % SEGMENTS).astype(np.uint64))
    some = count > 0
    total = leaf + parts.sum(1, dtype=np.uint64)
    keys[some, 0] = mix64(total[some]) | np.uint64(1)
    wide = count >= SEGMENTS
    keys[wide, 1:] = mix64(total[wide, None] - parts[wide] + np.arange(1, SEGMENTS + 1).astype(np.uint64) * _PLACE) | np.uint64(1)
    return keys, count


def _keys_of(part: pa.RecordBatch):
    data, offsets = raw_bytes(part.column("text"))
    lines, rows = line_offsets(data, offsets)
    keys, count = template_keys(data, lines)
    return data, lines, rows, keys, count


def line_keys(docs: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """key, tokens, doc_id: one row per template of a document; with a bitmap, only keys that it holds."""

    def build():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            _, _, rows, keys, count = _keys_of(part)
            n = keys.shape[1]
            key, row, tokens = keys.reshape(-1), np.repeat(rows, n), np.repeat(count, n)
            some = key != 0
            if bitmap is not None:
                at = (key >> np.uint64(64 - BITS)).astype(np.int64)
                some &= (bitmap[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)
            key, row, tokens = key[some], row[some], tokens[some]
            order = np.lexsort((key, row))
            key, row, tokens = key[order], row[order], tokens[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
            return pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), pa.array(tokens[first], pa.int32()), part.column("doc_id").take(pa.array(row[first]))], ["key", "tokens", "doc_id"])

        return work

    return map_texts(docs, "key long, tokens int, doc_id long", build)


def recurring_templates(docs: DataFrame, least=LEAST) -> DataFrame:
    """key, first: the templates that enough documents hold and the smallest doc_id with each."""
    counted = line_keys(docs).groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"), F.max("tokens").alias("tokens"))
    fewest = F.lit(None)
    for tokens, number in reversed(least):
        fewest = F.when(F.col("tokens") >= tokens, F.lit(number)).otherwise(fewest)
    return counted.where(F.col("docs") >= fewest).select("key", "first")


def drops(docs: DataFrame, least=LEAST) -> DataFrame:
    """doc_id, found: for each document the recurring templates in it whose first document is another."""
    recurring = materialize(recurring_templates(docs, least), "templates")
    bitmap = np.packbits(sketch(recurring.select("key"), lambda b: [b.column("key").to_numpy().view(np.uint64)], BITS) > 0)
    met = line_keys(docs.where(F.col("doc_id").isNotNull()), bitmap).join(recurring, "key").where(F.col("first") != F.col("doc_id"))
    return met.groupBy("doc_id").agg(F.collect_set("key").alias("found"))


def dedup_lines(docs: DataFrame, least=LEAST) -> DataFrame:
    """The rows of ``docs`` with ``text`` cut to the kept lines, plus n_lines, n_dropped (both long).

    All other columns are carried along; a document that loses no line keeps its text to the byte.
    """
    base = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = drops(documents_only(docs), least).select(F.col("doc_id").alias("__key"), F.col("found").alias("__found"))
    joined = base.join(found, base["doc_id"] == found["__key"], "left").drop("__key").select("*", F.lit(0).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    schema = joined.drop("__found").schema

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                data, lines, rows, keys, _ = _keys_of(part)
                raw = data.tobytes()
                gone = _dropped(part.column("__found"), rows, keys)
                edges = np.searchsorted(rows, np.arange(part.num_rows + 1))
                n_dropped = np.bincount(rows[gone], minlength=part.num_rows)
                texts = part.column("text").to_pylist()
                for i in np.flatnonzero(n_dropped).tolist():
                    a, b = int(edges[i]), int(edges[i + 1])
                    kept = b"".join(raw[lines[k] : lines[k + 1]] for k in range(a, b) if not gone[k]).decode()
                    texts[i] = kept.rstrip("\n") if gone[b - 1] else kept
                columns = {n: part.column(n) for n in part.schema.names if n != "__found"} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(np.diff(edges), pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return joined.mapInArrow(tidy(run), schema)


def _dropped(found: pa.Array, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which lines have a template that is among those found for their row."""
    lists = found.fill_null([])
    owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    gone = np.zeros(len(rows), bool)
    if len(owner):
        # (row, key) as one sorted list of pairs
        held = np.sort(mix64(lists.flatten().to_numpy().view(np.uint64) + owner.astype(np.uint64) * _PLACE))
        asked = mix64(keys + rows.astype(np.uint64)[:, None] * _PLACE)
        gone = ((held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked) & (keys != 0)).any(1)
    return gone


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup_lines(documents_only(table(spark, sf_dir, "documents")))
    return done.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


#: Templates as texts: the open segment (0: none), the token count, the leading tokens and those outside the segment.
OP3_SQL = rf"""WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS piece FROM documents
), line AS MATERIALIZED (
  SELECT r, doc_id, nth, last, line || CASE WHEN nth < last THEN chr(10) ELSE '' END AS line,
    [CASE WHEN regexp_matches(t, '[0-9]') THEN ' ' ELSE t END FOR t IN regexp_extract_all(line, '[^\x20\x09-\x0D]+')] AS tokens
  FROM (SELECT r, doc_id, len(piece) AS last, unnest(piece) AS line, unnest(range(1, len(piece) + 1)) AS nth FROM pieces)
  WHERE nth < last OR line <> ''
), key AS MATERIALIZED (
  SELECT r, doc_id, nth, n, concat_ws(' ', s, n) || chr(10) || array_to_string(list_concat(tokens[1:{LEADING}], tokens[1:lo], tokens[hi + 1:n]), chr(10)) AS key
  FROM (SELECT *, CASE s WHEN 0 THEN n ELSE ((s - 1) * n + {SEGMENTS - 1}) // {SEGMENTS} END AS lo, CASE s WHEN 0 THEN n ELSE (s * n + {SEGMENTS - 1}) // {SEGMENTS} END AS hi
    FROM (SELECT *, len(tokens) AS n, unnest(CASE WHEN len(tokens) >= {SEGMENTS} THEN range(0, {SEGMENTS + 1}) ELSE [0] END) AS s FROM line WHERE len(tokens) > 0))
), recurring AS MATERIALIZED (
  SELECT key, min(doc_id) AS first FROM key GROUP BY key, n
  HAVING count(DISTINCT r) >= CASE {" ".join(f"WHEN n >= {tokens} THEN {documents}" for tokens, documents in LEAST)} END
), gone AS (
  SELECT DISTINCT r, nth FROM key JOIN recurring USING (key) WHERE first <> doc_id
), done AS (
  SELECT r, count(*) AS n_lines, count(gone.r) AS n_dropped, coalesce(string_agg(line, '' ORDER BY nth) FILTER (gone.r IS NULL), '') AS kept, max_by(gone.r IS NOT NULL, nth) AS cut
  FROM line LEFT JOIN gone USING (r, nth) GROUP BY line.r
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, length(result) AS kept_chars, sha256(result) AS kept_sha256
FROM (SELECT *, CASE WHEN coalesce(n_dropped, 0) = 0 THEN text WHEN cut THEN rtrim(kept, chr(10)) ELSE kept END AS result FROM pieces LEFT JOIN done USING (r))"""
