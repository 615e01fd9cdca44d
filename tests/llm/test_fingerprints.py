import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import fingerprints as f


def test_entropies_against_counts():
    x = np.random.default_rng(1).integers(97, 110, 400).astype(np.uint8)
    levels = f.entropy_levels(x)
    for i, level in enumerate(levels):
        c = np.unique(x[i : i + f.WINDOW], return_counts=True)[1] / f.WINDOW
        assert abs(level - -(c * np.log2(c)).sum() / np.log2(f.WINDOW) * f.LEVELS) < 1


def test_selection_against_a_scan():
    levels = np.random.default_rng(2).integers(500, 900, 300)
    rank, n = f.RANKS[levels], len(levels)
    votes = np.zeros(n, int)
    for a in range(n - f.WINDOW + 1):
        best = min((r, a + k) for k, r in enumerate(rank[a : a + f.WINDOW]) if r > 0)
        votes[best[1]] += 1
    assert f.selected(levels).tolist() == np.flatnonzero(votes >= f.POPULAR).tolist()


def test_texts_read_together_or_after_a_cut_are_as_alone(texts):
    some = [t for t in texts.values()][:120]
    raws = [t.encode() for t in some]
    for raw, (at, h) in zip(raws, f.features(raws)):
        alone = f.features([raw])[0]
        assert np.array_equal(at, alone[0]) and np.array_equal(h, alone[1])
    changed = [f.edited(a, b).encode() for a, b in zip(some, some[1:])]
    cuts = [len(t[: len(t) - len(t) // 3].encode()) for t in some[:-1]]
    for raw, (at, h) in zip(changed, f.features_after_cut(changed, cuts, f.features(raws)[:-1])):
        alone = f.features([raw])[0]
        assert np.array_equal(at, alone[0]) and np.array_equal(h, alone[1])


@pytest.mark.parametrize("rows_per_part", [60, 100_000])
def test_whole_table_against_a_loop(spark, docs, texts, rows_per_part, monkeypatch):
    monkeypatch.setattr(f.with_next, "__defaults__", (rows_per_part, 1 << 15))
    rows = {r["doc_id"]: r for r in f.fingerprints(docs.select("doc_id", "text")).collect()}
    assert len(rows) == len(texts)
    order = sorted(texts, reverse=True)
    near, far = [], []
    for k, key in enumerate(order):
        text, follows = texts[key], texts[order[(k + 1) % len(order)]]
        n = len(text) // 3
        want = text[: len(text) - n] + follows[:n]
        r = rows[key]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        if k % 10 == 0:
            one, two, three = (f.fingerprint(t.encode()) for t in (text, want, follows))
            assert r["fingerprint"] == f.as_text(one) and r["edited_fingerprint"] == f.as_text(two)
            assert r["near_edited"] == pytest.approx(f.likeness(one, two)) and r["near_next"] == pytest.approx(f.likeness(one, three))
        if text != follows and len(text) > 100:
            near.append(r["near_edited"])
            far.append(r["near_next"])
    assert np.percentile(near, 5) > 0.45 and np.percentile(far, 90) < 0.3
    same = {}
    for key, r in rows.items():
        assert same.setdefault(texts[key], r["fingerprint"]) == r["fingerprint"]


def test_odd_rows(odd, empty):
    from ledgerloom.llm.common import documents_only

    rows = f.fingerprints(documents_only(odd)).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert {r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)} == {""}
    assert f.fingerprints(documents_only(empty)).collect() == []
    one = f.fingerprints(documents_only(odd).where("doc_id = 8")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_hot_ids_are_split_and_nothing_is_lost(spark):
    texts = [f"row {i} of a hot id, with some words to tell it apart {i * i}" for i in range(700)]
    rows = [(None, t) for t in texts] + [(7, "the same text each time")] * 600 + [(7, t) for t in texts[:100]] + [(i, t) for i, t in enumerate(texts[:300], 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["n"] for r in f.with_next(docs, 50).where("not last").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == len(rows) and len(sizes) > 20 and max(sizes) < 200
    few = {r["part"]: r["count"] for r in f.with_next(docs, 50).where("last").groupBy("part").count().collect()}
    assert set(few.values()) == {1} and len(few) == len(sizes)
    # ids in order, every row of a repeated text but its last followed by itself
    out = f.fingerprints(docs)
    assert out.count() == len(rows)
    same = out.where("doc_id = 7 and n_chars = 23").groupBy("near_next").count().collect()
    assert sum(r["count"] for r in same) == 600 and {r["near_next"]: r["count"] for r in same}[1.0] >= 599
    by_id = {r["doc_id"]: r["edited_sha256"] for r in out.where("doc_id > 100").collect()}
    for i in range(101, 400):
        assert by_id[i] == hashlib.sha256(f.edited(texts[i - 100], texts[i - 101]).encode()).hexdigest()


def test_long_chains_in_blocks(monkeypatch):
    rng = np.random.default_rng(5)
    a, b = (f.fingerprint(bytes(rng.integers(32, 120, 40_000).astype(np.uint8))) for _ in range(2))
    c = (np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))
    want = f.likeness(a, c)
    monkeypatch.setattr(f, "TILE", 7)
    assert f.likeness(a, c) == pytest.approx(want) and want > 0.5
