"""Seeded draws against the shuffle itself, at any partitioning."""

import pytest

from pyspark.sql import functions as F

from tidewell.operators import stats as S
from tidewell.plans import registry

SF = "/root/testdata/sf0.001"


def shuffled(total, n, seed):
    if n >= total:
        return list(range(total))
    items, state = list(range(total)), seed % 2**64
    for i in range(total - 1, 0, -1):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        j = (state >> 33) % (i + 1)
        items[i], items[j] = items[j], items[i]
    return items[:n]


@pytest.mark.parametrize("seed", [0, 7, 42, -3, 2**63 - 1])
def test_draws_are_the_shuffles(seed, monkeypatch):
    for total, n in ((1, 1), (2, 1), (3, 2), (50, 7), (50, 49), (50, 50), (50, 60), (50, 0), (3000, 25), (70_000, 40)):
        assert S.drawn(total, n, seed) == shuffled(total, n, seed)
    monkeypatch.setattr(S, "_BLOCK", 64)  # blocks are entered anywhere
    for total, n in ((65, 5), (1000, 30), (4097, 64)):
        assert S.drawn(total, n, seed) == shuffled(total, n, seed)


def test_sample_at_any_partitioning(spark):
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, "x").otherwise(None).alias("c"))
    takes = spark.createDataFrame([("hot", 1333, 20), ("x", 334, 3), ("none", 0, 0)], "category string, n long, take long")
    found = [sorted(map(tuple, S.seeded_sample(rows.repartition(p), "c", "k", takes, 9).collect())) for p in (1, 3, 11)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 23
    for c, total, n in (("hot", 1333, 20), ("x", 334, 3)):
        keys = [r.k for r in rows.where(F.col("c") == c).orderBy("k").collect()]
        assert [k for _, k, _ in sorted((x for x in found[0] if x[0] == c), key=lambda x: x[2])] == [keys[i] for i in shuffled(total, n, 9)]
    assert S.seeded_sample(rows.limit(0), "c", "k", takes.limit(0), 9).count() == 0


def test_queries(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = registry.QUERIES["a8_sample"](spark, SF)
    assert got.count() == 101 and got.groupBy("category").count().join(S.allocate(events.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")), 101), "category").where("count <> take").isEmpty()
    assert registry.QUERIES["a9_draws"](spark, SF).groupBy("category").count().where("count <> 5").isEmpty()
