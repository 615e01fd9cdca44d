import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import similarity_join as j
from ledgerloom.llm.graph import components
from tests.llm.brute import jaccard_components


def result(rows):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows.collect()}


def test_whole_table_against_brute_force(spark, medium, texts):
    assert result(j.op9_jaccard(spark, medium)) == jaccard_components(texts.items(), 4, 85, 100)


def hot_rows(copies=150, seed=1):
    """Near copies of one text whose similarities lie on both sides of the threshold, plus exact copies and strangers."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    base = rnd.sample(words, 120)
    rows = []
    for i in range(copies):
        t = list(base)
        for _ in range(rnd.randint(0, 5)):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((1000 + i, " ".join(t)))
    rows += [(5000 + i, " ".join(base)) for i in range(30)]
    rows += [(7000 + i, " ".join(base[:60] + rnd.sample(words, 60))) for i in range(40)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("small, levels, hot, whole", [(16, 4, 512, 1024), (3, 1, 512, 4), (4, 2, 16, 4)])
def test_hot_groups_against_brute_force(spark, monkeypatch, small, levels, hot, whole):
    monkeypatch.setattr(j, "HOT", hot)
    rows = hot_rows()
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(j.jaccard_components(made, 4, 85, 100, small=small, levels=levels, whole=whole)) == jaccard_components(rows, 4, 85, 100)


def test_prefix_groups_are_expanded(spark, monkeypatch):
    """Sets that share size and prefix are one group; all pairs of its members are still judged."""
    monkeypatch.setattr(j, "mix64", j.mix64)
    common = [f"c{i}" for i in range(200)]
    rows = [(i, " ".join(common[: 100 + i % 7] + [f"x{i // 2}"] * 3)) for i in range(60)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(j.jaccard_components(made, 2, 80, 100, small=2)) == jaccard_components(rows, 2, 80, 100)


def test_odd_rows(odd, empty):
    rows = j.jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    found = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (5, 1, 5), (6, 1, 5), (7, 1, 7)} <= found
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert j.jaccard_components(empty).collect() == []
    kept = j.one_per_component(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, None, 7, 8], key=str)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 63, rng.integers(1, 300)).astype(np.uint64)
        b = np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, rng.integers(1, 40)).astype(np.uint64)])
        a, b = np.unique(a), np.unique(b)
        maps = j.parity_bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)])).to_pylist()
        size = min(map(len, maps))
        assert (j.folded(maps[0], size) ^ j.folded(maps[1], size)).bit_count() <= len(np.setxor1d(a, b))


def test_shingle_sets_are_distinct_and_case_blind():
    h, n = j.shingle_sets(pa.array(["A b c D", "a B\tc\vd", "a b", "", "a b c d e a b c d"]), 4)
    assert n.tolist() == [1, 1, 1, 0, 5] and h[0] == h[1]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(5, i) for i in range(6, 60)] + [(7, 7)]
    random.Random(0).shuffle(edges)
    found = {r["v"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 100 for i in range(100, 141)}, **{i: 5 for i in range(5, 60)}}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_sketch_counts_are_exact(spark):
    hashes = np.random.default_rng(5).integers(0, 1 << 63, 5000).astype(np.uint64) << np.uint64(1)
    rows = spark.createDataFrame([(int(h) - (1 << 64) if h >= 1 << 63 else int(h),) for h in hashes], "h long").repartition(9)
    found = j.sketch(rows, lambda b: [b.column("h").to_numpy().view(np.uint64)], 16)
    assert np.array_equal(found, np.bincount((hashes >> np.uint64(48)).astype(np.int64), minlength=1 << 16))
    assert not j.sketch(rows.where("false"), lambda b: [b.column("h").to_numpy().view(np.uint64)], 4).any()


def test_many_groups_without_links_in_one_bucket(spark, monkeypatch):
    """2,000 pairs of near copies that all hold one rare-looking shingle: the shingles are ordered by hash alone."""
    monkeypatch.setattr(j, "order_ranks", lambda docs, width: (np.zeros(2, np.uint8), 36))
    rnd = random.Random(4)
    rows, made = [], []
    words = [f"v{i}" for i in range(20_000)]
    # of many shingles the one with the smallest hash is in every prefix
    first = min((w for w in words), key=lambda w: int(j.shingle_sets(pa.array([w]), 1)[0][0]))
    for i in range(2000):
        own = [first, *rnd.sample(words, 14)]
        rows += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own, rnd.choice(words)]))]
    calls = []
    pairs_of = j.compared
    monkeypatch.setattr(j, "compared", lambda pairs, *a: pairs_of(made.append(pairs) or pairs, *a))
    out = result(j.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100))
    assert out == jaccard_components(rows, 1, 85, 100)
    # candidates stay far below the eight million pairs of the bucket
    calls = [p.count() for p in made]
    assert sum(calls) < 200_000, calls


def test_rows_that_share_an_id_tie_their_texts(spark):
    a, b, c = ("one two three four five six seven", "other words in another text here now", "eight nine ten eleven twelve")
    rows = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b), (5, ""), (8, c)], "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in j.jaccard_components(rows, 4, 85, 100).collect())
    assert found == [(3, 3, 4), (5, 3, 4), (5, 3, 4), (5, 5, 0), (8, 8, 2), (9, 3, 4)]
