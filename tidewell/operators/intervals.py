"""Validity windows with closed, possibly open-ended bounds, and supersession between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def valid(lo: Column, hi: Column) -> Column:
    return F.coalesce(lo <= hi, F.lit(True))


def contains(lo: Column, hi: Column, at: Column) -> Column:
    """A null bound is open; a null point is in no window, nor is any point in an invalid one."""
    return at.isNotNull() & valid(lo, hi) & F.coalesce(at >= lo, F.lit(True)) & F.coalesce(at <= hi, F.lit(True))


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    return valid(a_lo, a_hi) & valid(b_lo, b_hi) & F.coalesce(a_lo <= b_hi, F.lit(True)) & F.coalesce(b_lo <= a_hi, F.lit(True))


def supersession(claims: DataFrame, slices: int = 256) -> DataFrame:
    """Each claim (id, key, value, lo, hi, seq) against its predecessor with the same key, and why it does or does not replace it.

    The predecessor is the last earlier claim whose window is valid and whose value is not empty, else the last earlier one. A key's claims
    are cut into ``slices`` of the sequence numbers: windows see a slice of a key, and what its earlier slices end with, so that a
    key with very many claims is dealt to many tasks.
    """
    c = F.col
    ends = claims.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()  # one row
    width = max(1, -(-((ends["hi"] or 0) - (ends["lo"] or 0) + 1) // slices))
    rows = claims.withColumn("_s", F.floor((c("seq") - F.lit(ends["lo"] or 0)) / width)).withColumn("_me", F.struct("id", "value", "lo", "hi"))
    rows = rows.withColumn("_good", F.when(valid(c("lo"), c("hi")) & (F.trim(F.coalesce("value", F.lit(""))) != ""), c("_me")))
    own = Window.partitionBy("key", "_s").orderBy("seq", "id").rowsBetween(Window.unboundedPreceding, -1)
    order = F.struct("seq", "id")
    last = rows.groupBy("key", "_s").agg(F.max_by("_me", order).alias("_any"), F.max_by("_good", F.when(c("_good").isNotNull(), order)).alias("_last"))
    earlier = Window.partitionBy("key").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # slices at most
    carried = last.select("key", "_s", F.last("_last", True).over(earlier).alias("_carried"), F.last("_any").over(earlier).alias("_before"))
    seen = rows.withColumns({"_own": F.last("_good", True).over(own), "_one": F.last("_me").over(own)}).join(carried, ["key", "_s"])
    p = seen.withColumn("p", F.coalesce("_own", "_carried", "_one", "_before")).where("p is not null")
    reason = (
        F.when(~valid(c("lo"), c("hi")) | ~valid(c("p.lo"), c("p.hi")), "invalid-window")
        .when(~overlaps(c("lo"), c("hi"), c("p.lo"), c("p.hi")), "disjoint-validity")
        .when((F.trim(F.coalesce("value", F.lit(""))) == "") | (F.trim(F.coalesce("p.value", F.lit(""))) == ""), "empty-value")
        .when(F.lower(F.trim(c("value"))) == F.lower(F.trim(c("p.value"))), "same-value")
        .otherwise("same-key-different-value")
    )
    return p.select("id", c("p.id").alias("old_id"), reason.alias("reason"))


def stamp(rows: DataFrame, newer: DataFrame) -> DataFrame:
    """(path, superseded_by): rows whose path is in ``newer`` (path, by) point to what replaces them, unless they point already."""
    by = newer.groupBy("path").agg(F.min("by").alias("by"))
    own = F.when(F.col("superseded_by") != "", F.col("superseded_by"))
    return rows.join(by, "path", "left").select("path", F.coalesce(own, "by", F.lit("")).alias("superseded_by"))
