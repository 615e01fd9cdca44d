"""Samples of an exact size, whatever the partitioning."""

import pytest

from ledgerloom.operators.sampling import exact_sample, hash32, smallest, weighted_sample


@pytest.mark.parametrize("rate", [0.0, 0.013, 0.5, 1.0])
def test_exact_size_and_no_partitioning(spark, rate):
    rows = spark.range(3000).selectExpr("id", "id % 7 as rows", "'x' as __key_")
    got = [sorted(map(tuple, exact_sample(rows.repartition(n), "id", rate).collect())) for n in (1, 5)]
    assert got[0] == got[1] and len(got[0]) == int(3000 * rate) == len(set(got[0]))
    want = sorted(tuple(r) for r in rows.orderBy(hash32(42, "sample", rows["id"]), "id").limit(int(3000 * rate)).collect())
    assert got[0] == want


def test_ties_on_the_cut(spark):
    rows = spark.range(100).selectExpr("id", "id % 3 as k")
    assert sorted(r["id"] for r in smallest(rows, rows["k"], ["id"], 40).collect()) == sorted([*range(0, 100, 3), *range(1, 18, 3)])
    assert smallest(rows, rows["k"], ["id"], 500).count() == 100 and smallest(rows.where("false"), rows["k"], ["id"], 5).count() == 0


def test_weights(spark):
    odd = "case when id % 10 = 0 then null when id % 10 = 1 then 0 when id % 10 = 2 then -1 when id % 10 = 3 then double('NaN') when id % 10 = 4 then double('inf') when id % 10 = 5 then 9 else 1 end"
    rows = spark.range(0, 40_000, 1, 3).selectExpr("id", f"{odd} as w")
    got = [r["id"] % 10 for r in weighted_sample(rows, "id", "w", 1000).collect()]
    assert len(got) == 1000 and min(got) == 5
    assert 0.62 < got.count(5) / 1000 < 0.76  # 9 of 13 at first, less as they are used up
    again = [r["id"] % 10 for r in weighted_sample(rows.repartition(7), "id", "w", 1000).collect()]
    assert sorted(got) == sorted(again)
    assert weighted_sample(rows, "id", "w", 10**6).count() == 20_000
    assert weighted_sample(rows.where("w < 0"), "id", "w", 5).count() == 0
