"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from pyspark.sql import functions as F

from tidewell.operators import stats
from tidewell.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    if isinstance(v, list | tuple):
        return "[" + ",".join(map(norm, v)) + "]"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted([norm(row[names.index(c)]) for c in columns] for row in found.fetchall())
    assert sorted([norm(row[c]) for c in columns] for row in df.collect()) == want


def test_bootstrap_interval(spark):
    row = registry.QUERIES["a5_bootstrap"](spark, SF).first()
    assert row["lo"] <= row["mean"] <= row["hi"] and 0 < row["hi"] - row["lo"] < 0.5


def test_bootstrap_by_category(spark):
    """About as wide as the normal approximation says, and the same at any partitioning."""
    rows = registry.QUERIES["a6_bootstrap_by_category"](spark, SF).collect()
    counts = {r.event_type: (r["count"], r.m) for r in spark.read.parquet(f"{SF}/events.parquet").where("value is not null").groupBy("event_type").agg(F.count("*").alias("count"), F.avg((F.col("value") > 50).cast("int")).alias("m")).collect()}
    assert {r.category for r in rows} == set(counts)
    for r in rows:
        n, mean = counts[r.category]
        half = 1.96 * math.sqrt(mean * (1 - mean) / n)
        assert abs(r["mean"] - mean) < 1e-9 and abs(mean - half - r.lo) < 0.3 * half + 0.01 and abs(mean + half - r.hi) < 0.3 * half + 0.01
    values = spark.range(300).select("id", (F.col("id") % 7).alias("v"))
    assert stats.bootstrap(values, "v").collect() == stats.bootstrap(values.repartition(5), "v").collect()
    assert stats.bootstrap(values.limit(0), "v").count() == 0
