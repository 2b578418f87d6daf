"""Rules over conversations and stored notes."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_words

#: What a user says to confirm or to correct a note.
POSITIVE = [
    r"(?i)\b(perfect|exactly|great|thanks|correct|right|yes)\b",
    r"(?i)\bthat('s| is| was) (right|correct|helpful|useful|what i needed)\b",
    r"(?i)\b(good|nice) (memory|recall|find)\b",
    r"(?i)\byou remembered\b",
    r"(?i)\bthat helps\b",
    r"(?i)\bspot on\b",
]
NEGATIVE = [
    r"(?i)\b(wrong|incorrect|no|nope|not right)\b",
    r"(?i)\bthat('s| is| was) (wrong|incorrect|outdated|old|stale)\b",
    r"(?i)\b(forget|remove|delete) (that|this|it)\b",
    r"(?i)\bnot what i (meant|asked|wanted)\b",
    r"(?i)\btry again\b",
    r"(?i)\bthat('s| is) (not|no longer) (true|accurate|relevant)\b",
    r"(?i)\bactually[,.]?\s",
]
#: Days and levels of confidence.
DEEP_STALE, STALE, STRONG, REINFORCED = 180, 90, 45, 14


def reaction(text: Column) -> tuple[Column, Column]:
    """(reaction, confidence): the side with more matching patterns, 0.3 for each; ties are neutral with 0.2, none with 0."""
    count = lambda ps: functools.reduce(operator.add, [text.rlike(ascii_words(p)).cast("int") for p in ps])
    up, down = count(POSITIVE), count(NEGATIVE)
    kind = F.when(up > down, "reinforced").when(down > up, "corrected").otherwise("neutral")
    sure = F.when(up == down, F.when(up > 0, 0.2).otherwise(0.0)).otherwise(F.round(F.least(F.lit(1.0), 0.3 * F.greatest(up, down)), 9))
    return kind, sure


def confidence(current: Column, created: Column, observed: Column, now: Column) -> Column:
    age, span = F.datediff(now, observed), F.greatest(F.lit(0), F.datediff(observed, created))
    old = F.when(age >= DEEP_STALE, "low").when(age >= STALE, F.when(current == "high", "medium").otherwise("low"))
    return F.coalesce(old, F.when(span >= STRONG, "high").when(span >= REINFORCED, F.when(current == "high", "high").otherwise("medium")).otherwise(current))


def stem(token: Column) -> Column:
    """Plural endings off: ies to y, es, s after other than s."""
    n = F.length(token)
    cut = lambda k: F.substring(token, F.lit(1), n - k)
    return (
        F.when((n > 5) & token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & token.endswith("es"), cut(2))
        .when((n > 4) & token.endswith("s") & ~token.endswith("ss"), cut(1))
        .otherwise(token)
    )


def sentences(text: Column) -> Column:
    """Sentences: split at line ends and after . ! ? before white space, but not after a title."""
    parts = F.split(text, r"\n|(?<=[.!?])(?<!\b(?:Dr|Mr|Mrs|Ms|Prof)\.)[ \t]+")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def wikilinks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, target, is_global) of each distinct [[link]], its display text off, in kebab case."""
    links = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(r"\[\[([^\]\[]+)\]\]"), F.lit(1))).alias("raw"))
    name = F.trim(F.substring_index("raw", "|", 1))
    plain = F.regexp_replace(name, "^global:", "")
    kebab = F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9]+", "-"), "^-+|-+$", "")
    return links.select(key, kebab.alias("target"), name.startswith("global:").alias("is_global")).distinct()


def resolve(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links (key, project, target, is_global) to pages (project or null, slug, path): the project's page first, then the global one."""
    own = pages.where("project is not null").select("project", F.col("slug").alias("target"), F.col("path").alias("own"))
    shared = pages.where("project is null").select(F.col("slug").alias("target"), F.col("path").alias("shared"))
    found = links.join(own, ["project", "target"], "left").join(shared, "target", "left")
    return found.withColumn("path", F.when(F.col("is_global"), F.col("shared")).otherwise(F.coalesce("own", "shared"))).drop("own", "shared")


def newest_half(rows: DataFrame, group: str, order: str) -> DataFrame:
    """The newest half (rounded up) of each group's rows."""
    w = Window.partitionBy(group)
    return rows.withColumns({"_i": F.row_number().over(w.orderBy(F.desc(order))), "_n": F.count("*").over(w)}).where("_i <= ceil(_n / 2)").drop("_i", "_n")


def index_lines(rows: DataFrame, group: str, path: str) -> DataFrame:
    """(group, line, pos): an index line for each path, numbered within its group in the order of paths.

    Positions come from a sort by range and counts of the ranges before, so that no group
    is gathered in one task.
    """
    placed = rows.select(group, path).repartitionByRange(F.col(group), F.col(path)).sortWithinPartitions(group, path)
    placed = placed.select(group, path, F.spark_partition_id().alias("_part"))
    within = placed.withColumn("_i", F.row_number().over(Window.partitionBy(group, "_part").orderBy(path)))
    counts = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    lines = within.join(before, [group, "_part"])
    return lines.select(group, F.concat(F.lit("- "), path).alias("line"), (F.col("_before") + F.col("_i")).alias("pos"))


def similar_names(rows: DataFrame, key: str, words: Column, least: float = 0.3) -> DataFrame:
    """(id, class_id, n_links) of each row: the smallest id with the same set of name words, and the number of
    other rows whose sets are alike by Jaccard similarity. Rows without a word have no links.

    Only distinct sets are compared. Candidates share a word among each side's rarest, by
    prefix filtering, so that a word of very many sets makes no pairs.
    """
    named = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_sort(F.array_distinct(words)).alias("set"))
    sets = named.where(F.size("set") > 0).groupBy("set").agg(F.min("id").alias("class_id"), F.count("*").alias("rows"))
    each = sets.select("class_id", F.size("set").alias("n"), F.explode("set").alias("w"))
    rarity = each.groupBy("w").agg(F.count("*").alias("df"))
    order = Window.partitionBy("class_id").orderBy("df", "w")  # a set's own words
    placed = each.join(rarity, "w").withColumn("place", F.row_number().over(order))
    rare = placed.where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("class_id", "n", "w")
    x, y = (rare.select("w", F.col("class_id").alias(s), F.col("n").alias(f"n_{s}")) for s in "ab")
    near = (F.col("a") < F.col("b")) & (F.col("n_a") >= least * F.col("n_b")) & (F.col("n_b") >= least * F.col("n_a"))
    pairs = x.join(y, "w").where(near).select("a", "b").distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("class_id").alias(side), F.col("set").alias(f"set_{side}"), F.col("rows").alias(f"rows_{side}")), side)
    alike = pairs.where(F.size(F.array_intersect("set_a", "set_b")) >= least * F.size(F.array_union("set_a", "set_b")) - 1e-9)
    links = alike.select(F.inline(F.array(*[F.struct(F.col(s).alias("class_id"), F.col(f"rows_{o}").alias("rows")) for s, o in ("ab", "ba")]))).groupBy("class_id").agg(F.sum("rows").alias("links"))
    counted = sets.join(links, "class_id", "left").select("set", "class_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    return named.join(counted, "set", "left").select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


# Tokens of a buffer that call for compaction, and the share of its newest observations that stays.
BUDGET, KEPT_PERCENT = 8192, 50


def buffered(turns: DataFrame, key: str, order: str, text: str, budget: int = BUDGET, percent: int = KEPT_PERCENT) -> DataFrame:
    """(key, order) of the observations that a rolling buffer of each key holds after the last one: each is appended in order, and
    where the buffer's bytes make ``budget`` tokens (four bytes each) only its newest ``percent`` stay, one at least. A session's turns are all that a group holds; null texts are empty.
    """
    size = F.octet_length(F.coalesce(text, F.lit("")))
    rows = turns.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), size.cast("long").alias("b")))).alias("x"))

    def append(a: Column, y: Column) -> Column:
        more = F.concat(a, F.array(y))
        total = F.aggregate(more, F.lit(0).cast("long"), lambda s, z: s + z["b"])
        keep = F.greatest(F.floor(F.size(more) * percent / 100).cast("int"), F.lit(1))
        return F.when((F.floor(total / 4) >= budget) & (F.size(more) > 1), F.slice(more, F.size(more) - keep + 1, keep)).otherwise(more)

    none = F.slice("x", 1, 0)
    return rows.select(key, F.explode(F.aggregate("x", none, append)).alias("e")).select(key, F.col("e.o").alias(order))


def observed_confidence(sections: Column) -> Column:
    """From the number of observations: four make it high, two medium."""
    return F.when(sections >= 4, "high").when(sections >= 2, "medium").otherwise("low")


def section_count(body: Column) -> Column:
    """Lines of a body that begin a section of the second level."""
    return F.coalesce(F.regexp_count(body, F.lit(r"(?m)^[ \t]*## ")), F.lit(0))


def reinforced(notes: DataFrame, now: Column) -> DataFrame:
    """(id, was, confidence, updated) of the heuristic notes (id, tags, body, confidence, created, observed): the confidence that their observations
    make, by how long ago the last one was and how long they went on; notes without the tag 'heuristic' are left out."""
    own = notes.where(F.exists("tags", lambda t: F.lower(t) == "heuristic"))
    now_is = confidence(observed_confidence(section_count(F.col("body"))), F.col("created"), F.col("observed"), now)
    return own.select("id", F.col("confidence").alias("was"), now_is.alias("confidence")).withColumn("updated", ~F.col("confidence").eqNullSafe(F.col("was")))


# Points of a record's fields for the whole query and for each of its words: name, tags, context, tool calls, tier or outcome.
PHRASE_POINTS, WORD_POINTS = (12, 10, 8, 8, 4), (5, 4, 2, 3, 2)


def procedural_score(query: str, name: Column, tags: Column, context: Column, calls: Column, tier: Column, outcome: Column) -> Column:
    """How well a procedural record answers a query: points for its fields that hold the query, and each of its words; nothing for an empty query."""
    plain = lambda x: F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " ")))
    phrase = " ".join(query.split()).lower()
    words = list(dict.fromkeys(w for w in re.split(r"[^a-z0-9._-]+", phrase) if w))

    def points(what: str, each: tuple[int, ...]) -> Column:
        among = lambda xs: F.exists(F.coalesce(xs, F.array().cast("array<string>")), lambda x: plain(x).contains(what))
        tests = [plain(name).contains(what), among(tags), plain(context).contains(what), among(calls), (tier == what) | (outcome == what)]
        return functools.reduce(operator.add, [F.when(t, p).otherwise(0) for t, p in zip(tests, each)])

    return functools.reduce(operator.add, [points(phrase, PHRASE_POINTS), *[points(w, WORD_POINTS) for w in words]]) if phrase else F.lit(0)
