"""Evaluation statistics: exact match, recall, percentiles, bootstrap intervals, stratified samples, costs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut


def normalise(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def exact_match(answer: Column, truth: Column) -> Column:
    """The normalised answer contains the normalised truth; blanks match nothing."""
    a, t = normalise(answer), normalise(truth)
    return (a != "") & (t != "") & a.contains(t)


def scores(rows: DataFrame) -> DataFrame:
    """(category, run, correct, score) of (category, hit) rows, with 'overall' (micro) and 'average' (macro) rows."""
    per = rows.groupBy("category").agg(F.count("*").alias("run"), F.count_if("hit").alias("correct")).withColumn("score", F.round(F.col("correct") / F.col("run"), 9))
    overall = per.agg(F.lit("overall").alias("category"), F.sum("run").alias("run"), F.sum("correct").alias("correct"), F.round(F.sum("correct") / F.sum("run"), 9).alias("score"))
    average = per.agg(F.lit("average").alias("category"), F.sum("run").alias("run"), F.sum("correct").alias("correct"), F.round(F.avg(F.col("correct") / F.col("run")), 9).alias("score"))
    return per.union(overall).union(average)


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[float]) -> DataFrame:
    """Percentiles by nearest rank: counts of distinct values, not rows, are ordered, so that a large group stays small."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(group).orderBy(value)
    total = F.sum("n").over(Window.partitionBy(group))
    ranked = counts.withColumns({"upto": F.sum("n").over(w), "total": total})
    at = lambda p: F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * p / 100), F.col(value)))
    return ranked.groupBy(group).agg(*[at(p).alias(f"p{p:g}") for p in percents])


def _poisson(ids: np.ndarray, resample: np.ndarray, seed: int) -> np.ndarray:
    """Poisson draws with mean 1, one for each id (rows) and resample (columns), from a hash of both."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + resample.astype(np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53
    steps = np.exp(-1.0) * np.cumsum([1.0 / math.factorial(k) for k in range(20)])
    return np.searchsorted(steps, u, side="right")


def bootstrap(rows: DataFrame, value: str, resamples: int = 1000, seed: int = 42, group: str | None = None, key: str = "id") -> DataFrame:
    """Mean and 95% interval (lo, hi) by the Poisson bootstrap, of all rows or of each ``group``.

    A row counts in a resample as often as a Poisson draw of its key's hash says, at any
    partitioning. Each batch gives its sums of all resamples, so that what is shuffled is a
    thousand numbers a batch. Rows with a null value take no part.
    """
    named = rows.where(F.col(value).isNotNull()).select((F.col(group) if group else F.lit("all")).cast("string").alias("g"), F.xxhash64(key).alias("k"), F.col(value).cast("double").alias("v"))
    every = np.arange(resamples)

    def sums(batches):
        for pdf in batches:
            for name, part in pdf.groupby("g", sort=False, dropna=False):
                w, wv = np.zeros(resamples), np.zeros(resamples)
                for a in range(0, len(part), 512):
                    draws = _poisson(part["k"].to_numpy()[a : a + 512].view(np.uint64), every, seed)
                    w += draws.sum(axis=0)
                    wv += part["v"].to_numpy()[a : a + 512] @ draws
                yield pd.DataFrame({"g": name, "r": every, "w": w, "wv": wv})

    means = named.mapInPandas(sums, "g string, r int, w double, wv double").groupBy("g", "r").agg((F.sum("wv") / F.sum("w")).alias("m")).where("m is not null")
    interval = means.groupBy("g").agg(F.expr("percentile_disc(0.025) within group (order by m)").alias("lo"), F.expr("percentile_disc(0.975) within group (order by m)").alias("hi"))
    out = named.groupBy("g").agg(F.avg("v").alias("mean")).join(interval, "g")
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def allocate(counts: DataFrame, size: int) -> DataFrame:
    """(category, n, take): floors of proportional shares, the rest by largest remainder, ties by name."""
    every = Window.partitionBy()  # one row for each category
    share = F.col("n") * size / F.sum("n").over(every)
    x = counts.withColumns({"floor": F.floor(share), "left": F.round(share - F.floor(share), 12)})
    place = F.row_number().over(Window.orderBy(F.desc("left"), "category"))
    rest = F.lit(size) - F.sum("floor").over(every)
    return x.select("category", "n", (F.col("floor") + F.when(place <= rest, 1).otherwise(0)).alias("take"))


def allocate_equal(counts: DataFrame, size: int) -> DataFrame:
    """Equal shares, the remainder to the first categories by name; no category gives more than it has."""
    every = Window.partitionBy()
    k = F.count("*").over(every)
    share = F.floor(F.lit(size) / k) + F.when(F.row_number().over(Window.orderBy("category")) <= F.lit(size) % k, 1).otherwise(0)
    return counts.select("category", "n", F.least("n", share).alias("take"))


def recall_at(hits: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(question, passed): any of the wanted ids among the first k hits."""
    found = wanted.join(hits.where(F.col("rank") <= k).withColumn("found", F.lit(True)), ["question", "id"], "left")
    return found.groupBy("question").agg(F.bool_or(F.coalesce("found", F.lit(False))).alias("passed"))


def recall_of(hits: DataFrame, wanted: DataFrame, k: int = 10) -> DataFrame:
    """(query_no, wanted, found, passed_any, passed_all) of every question in ``wanted`` (query_no, chunk_id, must): how many of its rows, and how many of the best ``k``
    hits are among them; whether any is, and whether all that must be are (true where none must)."""
    best = hits.where(F.col("rank") <= k).select("query_no", "chunk_id").distinct().withColumn("_hit", F.lit(True))
    rows = wanted.join(best, ["query_no", "chunk_id"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    return rows.groupBy("query_no").agg(F.count("*").alias("wanted"), F.count_if("_hit").alias("found"), F.bool_or("_hit").alias("passed_any"), F.bool_and(F.col("_hit") | ~F.col("must")).alias("passed_all"))


def select_some(rows: DataFrame, group: str, key: str, k: int, seed: int) -> DataFrame:
    """The ``k`` rows of each group that a hash of seed and key puts first: the same at any partitioning; Spark keeps k rows a group before the shuffle."""
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    order = Window.partitionBy(group).orderBy("_draw", key)
    return rows.withColumn("_draw", draw).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).select(group, key)


def tool_calls(rows: DataFrame, group: str, tool: str, order: str) -> DataFrame:
    """(group, tool, n, first): uses of each tool and where it came first."""
    return rows.groupBy(group, F.col(tool).alias("tool")).agg(F.count("*").alias("n"), F.min(order).alias("first"))


# The generator's factor and increment.
_FACTOR, _STEP, _WORD = 6364136223846793005, 1442695040888963407, 1 << 64
_BLOCK = 1 << 15


def _state(seed: int, t: int) -> int:
    """The generator's state after ``t`` steps, by doubling."""
    a, c, factor, step = 1, 0, _FACTOR, _STEP
    while t:
        if t & 1:
            a, c = a * factor % _WORD, (c * factor + step) % _WORD
        factor, step, t = factor * factor % _WORD, (factor + 1) * step % _WORD, t >> 1
    return (a * seed + c) % _WORD


def drawn(total: int, n: int, seed: int) -> list[int]:
    """Which of ``total`` items a seeded shuffle puts first, ``n`` of them in order; all, in their order, if there are no more.

    The shuffle swaps places from the last down, each with one that the generator draws; what ends at the first places is
    followed back through the swaps, so that only ``n`` places are held, and the generator is entered anywhere.
    """
    if n >= total:
        return list(range(total))
    places = np.arange(n, dtype=np.int64)
    power = np.full(_BLOCK, _FACTOR, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(power, dtype=np.uint64)[:-1]])
    for first in range(1, total, _BLOCK):
        size = min(_BLOCK, total - first)
        start = _state(seed % _WORD, total - (first + size - 1))  # the swap of the block's last place is drawn first
        states = power[:size] * np.uint64(start) + sums[:size] * np.uint64(_STEP)
        i = np.arange(first, first + size, dtype=np.int64)
        j = (states >> np.uint64(33)).astype(np.int64)[::-1] % (i + 1)
        at = 0
        while at < size:
            hits = np.flatnonzero(np.isin(j[at:], places) | (i[at:] < n))
            if not len(hits):
                break
            at += int(hits[0])
            with_i, with_j = places == i[at], places == j[at]
            places[with_i], places[with_j] = j[at], i[at]
            at += 1
    return places.tolist()


def numbered(rows: DataFrame, category: str, key: str) -> DataFrame:
    """``rows`` with place, from 0 in the order of ``key`` within each category, however large one is: ranges of the order are numbered apart, and each
    begins where those before it end."""
    ranged = cut(rows.repartitionByRange(category, key).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(category, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(category).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    begins = counts.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(category, "_p").orderBy(key))
    return ranged.withColumn("_i", own).join(begins, [category, "_p"]).withColumn("place", F.col("_b") + F.col("_i") - 1).drop("_p", "_b", "_i")


def seeded_sample(rows: DataFrame, category: str, key: str, takes: DataFrame, seed: int) -> DataFrame:
    """(category, key, pos): of each category as many rows as ``takes`` (category, n, take) says, drawn by a seeded shuffle of its rows in the order of ``key``; pos is the
    order in which they are drawn. The same rows come at any partitioning. Only numbers of places reach a category's task; categories without a row to take give none.
    """

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = drawn(int(pdf["n"].iloc[0]), int(pdf["take"].iloc[0]), seed)
        return pd.DataFrame({"category": pdf["category"].iloc[0], "place": chosen, "pos": range(len(chosen))})

    kind = takes.schema["category"].dataType.simpleString()
    places = takes.where("take > 0").groupBy("category").applyInPandas(draw, f"category {kind}, place long, pos int")
    return numbered(rows.select(F.col(category).alias("category"), F.col(key).alias("key")), "category", "key").join(places, ["category", "place"]).select("category", "key", "pos")
