"""Sketches against their definition, near duplicates against brute force."""

import random

import numpy as np
import pytest

from ledgerloom.llm import minhash as m
from tests.llm.brute import jaccard_components
from tests.llm.test_similarity_join import hot_rows


def result(rows):
    found = rows.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found}


def plain_sketch(members, size):
    """The rounds one by one."""
    out = [None] * size
    for i in range(2 * size):
        if None not in out:
            break
        before = list(out)
        for x in members:
            v = int(m.round_hashes(np.array([x], np.uint64), np.array([i]))[0, 0])
            at = v >> (64 - (size.bit_length() - 1)) if i < size else i - size
            value = i << 48 | v & ((1 << 48) - 1)
            if before[at] is None:
                out[at] = value if out[at] is None else min(out[at], value)
    return out


@pytest.mark.parametrize("at_once", [1, 1 << 17])
def test_sketches_are_those_of_the_rounds(monkeypatch, at_once):
    monkeypatch.setattr(m, "AT_ONCE", at_once)
    rnd = random.Random(1)
    sets = [[rnd.getrandbits(64) for _ in range(k)] for k in (1, 2, 3, 7, 40, 300)]
    got = m.sketches(np.array(sum(sets, []), np.uint64), np.array([len(s) for s in sets]), 16)
    assert [[int(x) for x in row] for row in got] == [plain_sketch(s, 16) for s in sets]


@pytest.mark.parametrize("n, shared", [(20, 16), (400, 300), (3000, 1000)])
def test_agreement_estimates_similarity(n, shared):
    rng = np.random.default_rng(n)
    errors = []
    for _ in range(12):
        h = rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64)
        s = m.sketches(np.concatenate([h[:n], h[n - shared :]]), np.array([n, n]))
        errors.append((s[0] == s[1]).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02 and np.abs(errors).max() < 0.1


def test_no_coordinate_stays_empty():
    s = m.sketches(np.arange(1, 1001, dtype=np.uint64), np.array([1] * 10 + [10] * 99))
    assert (s != m.EMPTY).all()


def test_whole_table_against_brute_force(spark, medium, texts):
    assert result(m.op12_minhash(spark, medium)) == jaccard_components(texts.items(), 2, 80, 100)


@pytest.mark.parametrize("small, rounds, block", [(16, 2, 4096), (3, 1, 4), (2, 1, 7)])
def test_hot_groups_against_brute_force(spark, small, rounds, block):
    rows = hot_rows(90, 3)
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(m.near_duplicates(made, 2, 80, 100, small=small, rounds=rounds, block=block)) == jaccard_components(rows, 2, 80, 100)


def test_small_sets_and_other_thresholds(spark):
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 9)))) for i in range(150)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for num, den in ((80, 100), (90, 100), (1, 1)):
        assert result(m.near_duplicates(made, 2, num, den)) == jaccard_components(rows, 2, num, den)


def test_odd_rows(odd, empty):
    rows = m.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 7, True)} <= found
    assert {(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None} == {(None, True)}
    assert m.near_duplicates(empty).collect() == []


def test_bitmaps_never_overstate_a_difference():
    rng = np.random.default_rng(6)
    pool = rng.integers(0, 1 << 63, 6000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, k)) for k in (4, 30, 31, 200, 900, 1000, 5000)] * 2
    n = np.array([len(x) for x in sets])
    f = m.folds(m.parity_bitmaps(np.concatenate(sets), n).to_pylist())
    u, v = (x.ravel() for x in np.indices((len(sets), len(sets))))
    found = m.least_difference(f, f, u, v)
    assert all(d <= len(np.setxor1d(sets[i], sets[j])) for i, j, d in zip(u, v, found)) and (found[u == v] == 0).all() and found.max() > 100
