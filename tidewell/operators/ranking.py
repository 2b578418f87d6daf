"""Reweighting, duplicate removal, evidence amounts and session expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

#: Amounts of money and counted things in running text.
MONEY = r"([$£€])\s?(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)"
QUANTITY = r"(?i)\b(\d{1,6}(?:\.\d+)?)\s+(hours?|hrs?|days?|weeks?|months?|items?|books?|issues?|sessions?|classes?|lessons?|rides?|trips?|events?|songs?|recipes?|gifts?|donations?)\b"


def temporal(scored: DataFrame, day: str, hint: str, key: str = "chunk_id") -> DataFrame:
    """Rows modified after ``day`` go; the others' scores are multiplied by how near they are to ``hint``
    (1, 7 or 30 days) and by up to a quarter for recency; undated rows count 0.95."""
    at = lambda x: F.lit(x).cast("date")
    rows = cut(scored.where(F.col("modified").isNull() | (F.col("modified") <= at(day))))  # read twice, scored once
    span = rows.agg(F.min("modified").alias("lo"), F.max("modified").alias("hi"))  # one row
    days = F.abs(F.datediff("modified", at(hint)))
    # fixed values: the factors
    near = F.when(days <= 1, 1.35).when(days <= 7, 1.20).when(days <= 30, 1.08).otherwise(0.92)
    recent = F.when(F.col("hi") > F.col("lo"), F.datediff("modified", "lo") / F.datediff("hi", "lo")).otherwise(0.0)
    weight = F.when(F.col("modified").isNull(), F.lit(0.95)).otherwise(near * (1 + 0.25 * recent))
    return rows.join(F.broadcast(span)).select(key, F.round(F.col("score") * weight, 9).alias("score"))


def exact_repeats(rows: DataFrame, session: str, text: str, order: str) -> DataFrame:
    """The first row of each normalised text in its session."""
    same = F.sha2(F.lower(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))), 256)
    return rows.groupBy(session, same.alias("same")).agg(F.min(order).alias(order)).drop("same")


def amounts(text: Column) -> Column:
    """Array of money amounts in hundredths."""
    raw = F.regexp_extract_all(text, F.lit(MONEY), F.lit(2))
    return F.transform(raw, lambda x: F.round(F.replace(x, F.lit(","), F.lit("")).cast("double") * 100).cast("long"))


def quantities(text: Column) -> Column:
    """Array of counts as written."""
    return F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(1)), lambda x: x.cast("double"))


def session_neighbours(rows: DataFrame, seeds: DataFrame, per_session: int = 3, total: int = 12) -> DataFrame:
    """Other rows of the seeds' sessions: the first of each session, and no more than ``total``."""
    others = rows.join(seeds.select("session_id").distinct(), "session_id", "left_semi").join(seeds.select("chunk_id"), "chunk_id", "left_anti")
    n = F.row_number().over(Window.partitionBy("session_id").orderBy("chunk_id"))
    return others.withColumn("_n", n).where(F.col("_n") <= per_session).orderBy("session_id", "chunk_id").limit(total).select("session_id", "chunk_id")


def cluster_by_session(hits: DataFrame) -> DataFrame:
    """Hits (chunk_id, session_id, rank) regrouped: sessions as they first appear, hits in their order."""
    first = F.min("rank").over(Window.partitionBy("session_id"))
    return hits.withColumn("_first", first).select("chunk_id", F.row_number().over(Window.orderBy("_first", "rank")).alias("pos"))  # a query's hits


def neighbour_scores(rows: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk_id, score) of the other rows of the seeds' sessions: the best of 0.72 of a seed's score (0.55 for rows
    after it), a little more for the same role and day, and no more than 0.95 of it."""
    s = seeds.select("session_id", F.col("chunk_id").alias("s_id"), F.col("score").alias("s_score"), F.col("source_role").alias("s_role"), F.col("modified").alias("s_day"))
    others = rows.join(seeds.select("chunk_id"), "chunk_id", "left_anti").join(s, "session_id")
    # fixed values: the factors
    factor = F.when(F.col("chunk_id") > F.col("s_id"), 0.55).otherwise(0.72) * F.when(F.col("source_role") == F.col("s_role"), 1.05).otherwise(1.0)
    factor = factor * F.when(F.col("modified") == F.col("s_day"), 1.08).otherwise(1.0)
    return others.groupBy("chunk_id").agg(F.round(F.max(F.least(0.95 * F.col("s_score"), F.col("s_score") * factor)), 9).alias("score"))
