"""Rules over questions: operators, stop words, cleaning, date phrases and facets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import tokens
from ..functions import words as W
from .intent import focuses

#: Numbers in words and units of date phrases.
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12}
AGO = r"(?i)\b(\d+|an?|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(days?|weeks?|months?)\s+ago\b"
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()


def has_operators(question: Column) -> Column:
    """Whether a question holds a quote or an upper-case AND, OR or NOT."""
    return question.contains('"') | question.rlike(r"(^|\s)(AND|OR|NOT)(\s|$)")


def normalised(question: Column) -> Column:
    """Without zero-width marks, no-break spaces as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.regexp_replace(question, "[\u200b\u200c\u200d\ufeff]", ""), "[\\s\u00a0]+", " "))


def significant(question: Column) -> Column:
    """Words of three bytes or more that are no stop words, in order."""
    return F.filter(tokens(question), lambda t: (F.octet_length(t) > 2) & ~t.isin(W.STOP_EN + W.STOP_NL))


def sanitised(question: Column) -> Column:
    """The significant words, else all words, without punctuation and symbols."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(question, r"[\p{P}\p{S}]+", " "), r"\s+", " "))
    keep = significant(question)
    return F.when(F.size(keep) > 0, F.array_join(keep, " ")).otherwise(bare)


def date_hints(question: Column, day: Column) -> Column:
    """Distinct days that a question's phrases mean on ``day``: N units ago, today, yesterday, last week, last weekday."""
    phrases = F.regexp_extract_all(question, F.lit(AGO), F.lit(0))
    words = F.create_map(*[x for k, v in NUMBERS.items() for x in (F.lit(k), F.lit(v))])

    def ago(p: Column) -> Column:
        n = F.lower(F.regexp_extract(p, AGO, 1))
        count = F.coalesce(F.try_element_at(words, n), n.try_cast("int"))
        unit = F.lower(F.regexp_extract(p, AGO, 2))
        return F.when(unit.startswith("day"), F.date_sub(day, count)).when(unit.startswith("week"), F.date_sub(day, count * 7)).otherwise(F.add_months(day, -count))

    weekday = F.array_position(F.array(*[F.lit(w) for w in WEEKDAYS]), F.lower(F.regexp_extract(question, r"(?i)\blast\s+(" + "|".join(WEEKDAYS) + r")\b", 1))).cast("int")
    back = F.pmod(F.weekday(day) - (weekday - 1) + 6, F.lit(7)) + 1  # one to seven days before
    one = F.array(
        F.when(question.rlike(r"(?i)\btoday\b"), day),
        F.when(question.rlike(r"(?i)\byesterday\b"), F.date_sub(day, 1)),
        F.when(question.rlike(r"(?i)\blast\s+week\b"), F.date_sub(day, 7)),
        F.when(weekday > 0, F.date_sub(day, back)),
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.transform(phrases, ago), one))))


def augmented(question: Column, hints: Column) -> Column:
    """The question followed by each hint, quoted, with slashes and with dashes."""
    both = F.flatten(F.transform(hints, lambda h: F.array(F.date_format(h, "yyyy/MM/dd"), F.date_format(h, "yyyy-MM-dd"))))
    return F.concat_ws(" ", F.array(question), F.transform(both, lambda d: F.concat(F.lit('"'), d, F.lit('"'))))


def facets(question: Column) -> Column:
    """Up to four distinct facets: quoted phrases, then runs of capitalised words after the first word."""
    quoted = F.regexp_extract_all(question, F.lit('"([^"]+)"'), F.lit(1))
    names = F.regexp_extract_all(F.regexp_replace(question, r"^\S+\s*", ""), F.lit(r"\b([A-Z][\p{L}]+(?: [A-Z][\p{L}]+)*)"), F.lit(1))
    return F.slice(F.array_distinct(F.concat(quoted, names)), 1, 4)


def until(question_day: Column, date_to: Column) -> Column:
    """The last day that may be searched: the question's day if that is earlier than the filter's."""
    return F.least(question_day, date_to)


def focus_probes(question: Column) -> Column:
    """Each focus group as one probe."""
    return F.transform(focuses(question), lambda w: F.array_join(w, " "))


def probes(question: Column, hints: Column, most: int = 8) -> Column:
    """What is searched for a question: itself, with its dates, its facets and its focus groups, distinct, ``most`` at most."""
    dated = F.when(F.size(hints) > 0, augmented(question, hints))
    every = F.array_compact(F.concat(F.array(question, dated), facets(question), focus_probes(question)))
    return F.slice(F.array_distinct(F.filter(every, lambda p: F.trim(p) != "")), 1, most)


def alias_text(text: Column) -> Column:
    """An alternative as it is searched: letters and digits in lower case, other characters as spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]+", " "))


def expand_aliases(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_no, pos, kind, text): what is searched for each question once its words and phrases that are triggers of ``aliases``
    (trigger, alternative) give way to their alternatives.

    Triggers of several words are taken before shorter ones, from left to right. An alternative of one word is a term, one of several a phrase; what
    a question holds twice by kind and text counts once, where it comes first. Empty triggers and alternatives say nothing. Grams of
    the questions meet the triggers by a join, all questions at once; a question's own words are all that a group holds.
    """
    known = aliases.select(F.trim(F.lower("trigger")).alias("trigger"), alias_text(F.col("alternative")).alias("text")).where("trigger <> '' and text <> ''").distinct()
    longest = known.agg(F.max(F.size(F.split("trigger", " ")))).first()[0] or 0
    toks = questions.select("query_no", tokens(F.col("question")).alias("toks"))
    grams = toks.select("query_no", "toks", F.explode(F.sequence(F.lit(1), F.lit(max(1, longest)))).alias("n")).select(
        "query_no", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("toks") - F.col("n") + 1)), lambda i: F.array_join(F.slice("toks", i, F.col("n")), " "))).alias("at", "gram")
    )
    found = grams.join(known.select(F.col("trigger").alias("gram")).distinct(), "gram")
    by_place = found.groupBy("query_no").agg(F.array_sort(F.collect_list(F.struct("at", (-F.col("n")).alias("n"), "gram"))).alias("m"))  # a question's words
    start = F.struct(F.lit(0).alias("next"), F.expr("cast(array() as array<struct<at: int, n: int, gram: string>>)").alias("taken"))
    step = lambda a, m: F.when(m["at"] >= a["next"], F.struct((m["at"] - m["n"]).alias("next"), F.concat(a["taken"], F.array(m)).alias("taken"))).otherwise(a)
    taken = by_place.select("query_no", F.aggregate("m", start, step)["taken"].alias("taken"))
    rows = toks.join(taken, "query_no", "left").withColumn("taken", F.coalesce("taken", F.expr("cast(array() as array<struct<at: int, n: int, gram: string>>)")))
    covered = lambda i: F.exists("taken", lambda m: (i >= m["at"]) & (i < m["at"] - m["n"]))
    own = F.filter(F.transform("toks", lambda t, i: F.struct(i.alias("at"), F.when(covered(i), F.lit(None).cast("string")).otherwise(t).alias("text"))), lambda x: x["text"].isNotNull())
    kept = rows.select("query_no", F.inline(own))
    given = rows.select("query_no", F.inline("taken")).join(known.withColumnRenamed("trigger", "gram"), "gram").select("query_no", "at", "text")
    every = kept.unionByName(given).withColumn("kind", F.when(F.col("text").contains(" "), "phrase").otherwise("term"))
    first = every.groupBy("query_no", "kind", "text").agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_no").orderBy("at", "text", "kind")  # a question's words and their alternatives
    return first.select("query_no", F.row_number().over(order).alias("pos"), "kind", "text")
