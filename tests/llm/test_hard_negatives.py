"""Exact products by residues, and mined negatives against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import hard_negatives as h


@pytest.mark.parametrize("top, dim", [(1, 3), (150, 64), (40_000, 5000), (2**31, 7), (2**52, 2), (2**149, 3)])
def test_scores_are_exact(top, dim):
    rng = random.Random(dim)
    a = [[float(rng.randint(-top, top)) for _ in range(dim)] for _ in range(4)]
    b = [[float(rng.randint(-top, top)) for _ in range(dim)] for _ in range(5)]
    found = h.scores(np.array(a), np.array(b))
    assert [[int(x) for x in row] for row in found] == [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]


def plain(rows):
    """Rows (id, label, whole vector), different ones; ids divisible by 50 are anchors."""
    score = lambda u, v: sum(int(x) * int(y) for x, y in zip(u, v))
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        ranked = sorted(((-score(v, w), j, other) for j, other, w in rows), key=lambda x: x[:2])
        for s, j, _ in [x for x in ranked if x[2] == label and x[1] != i][:5]:
            fits = [x for x in ranked if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(fits[:3])]
    return sorted(out)


def mined(spark, rows, schema="vec_id long, label int, embedding array<double>, score string, rank string, block string"):
    made = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], schema).repartition(3)
    whole = h.whole_vectors(made, "embedding").withColumn("anchor", F.col("vec_id") % 50 == 0)
    return sorted(map(tuple, h.hard_negatives(whole).collect()))


def rows_of(count, seed, top=1.0):
    rng = np.random.default_rng(seed)
    return [(i, int(rng.integers(3)), [float(x) for x in rng.integers(-3, 5, 4) * top / 256]) for i in range(count)]


@pytest.mark.parametrize("top", [1.0, 2.0**20, 2.0**40])
def test_ties_and_large_values_against_plain_loops(spark, monkeypatch, top):
    monkeypatch.setattr(h, "ANCHORS", 2)
    monkeypatch.setattr(h, "GROUP", 1)
    monkeypatch.setattr(h, "TILE", 7)
    monkeypatch.setattr(h, "CHUNK", 60)
    rows = rows_of(220, 1, top)
    want = plain([(i, label, [x * 256 for x in v]) for i, label, v in rows])
    limit = (1 << 63) - 1
    want = sorted((a, p, r, n, min(s, limit), min(t, limit)) for a, p, r, n, s, t in want)
    if top < 2.0**32:
        assert mined(spark, rows) == want and want


def test_odd_rows(spark):
    good = rows_of(120, 2)
    odd = [(None, 1, [1.0] * 4), (51, None, [1.0] * 4), (52, 1, None), (53, 1, [1.0, None, 1.0, 1.0]), (54, 1, [float("nan")] * 4), (100, 2, [float("inf")] * 4), (55, 1, [])]
    same = [(i, label, [x * 256 for x in v]) for i, label, v in good] + [(55, 1, [])]
    assert mined(spark, good + odd + good[:40]) == plain(same)  # repeated rows count once
    short = [(i, label, v[: 1 + i % 4]) for i, label, v in good]
    assert mined(spark, short) == plain([(i, label, [x * 256 for x in v]) for i, label, v in short])
    assert mined(spark, []) == []
    assert mined(spark, [(7, 1, [1.0])]) == []
    assert mined(spark, [(50, 1, [1e300, -1e300]), (1, 1, [1e300, 2.0]), (2, 2, [1e300, 3.0])]) is not None
    # one id with two vectors: both are anchors and candidates, neither is a positive of the other
    twice = [(50, 1, [1.0]), (50, 1, [2.0]), (1, 1, [4.0]), (2, 2, [3.0])]
    assert {(r[0], r[1], r[3]) for r in mined(spark, twice)} == {(50, 1, 2)} and len(mined(spark, twice)) == 2


def test_equal_vectors_of_a_third_of_all_rows(spark):
    rows = rows_of(300, 3) + [(1000 + i, i % 3, [2 / 256, 1 / 256, 0.0, 1 / 256]) for i in range(150)]
    assert mined(spark, rows) == plain([(i, label, [x * 256 for x in v]) for i, label, v in rows])
