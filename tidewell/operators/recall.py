"""Recall: candidates by scope weights and quotas, and a gated second search over raw transcripts."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import words as W
from ..session import cut
from . import probes as P
from . import search
from .intent import diverse
from .retry import first_terms

# Fewer global notes than PLENTY let project notes in, PROJECT_CAP at most; most candidates, and most notes that are recalled.
PLENTY, PROJECT_CAP, SCANNED, RECALLED = 5, 10, 200, 5


def recall_candidates(requests: DataFrame, topics: DataFrame, surfaced: DataFrame) -> DataFrame:
    """(request, path, pos): the notes that a request (request, grp, w_global, w_project) chooses from, in order.

    ``topics`` (grp, scope, path): notes of scopes 'global_notes' and 'project_notes', each listed by path; ``surfaced``
    (request, path) are left out. Where global notes weigh more they come first, and project notes, PROJECT_CAP at most, follow only if
    fewer than PLENTY are global; else project notes come first and global ones follow. SCANNED at most in all. Each scope of a group gives
    no more than SCANNED and what is surfaced, so that lists are bounded before they meet.
    """
    most = SCANNED + (surfaced.groupBy("request").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
    listed = Window.partitionBy("grp", "scope").orderBy("path")
    first = topics.select("grp", "scope", "path").distinct().withColumn("_n", F.row_number().over(listed)).where(F.col("_n") <= most).drop("_n")
    mine = requests.join(first, "grp").join(surfaced.select("request", "path").distinct(), ["request", "path"], "left_anti")
    place = Window.partitionBy("request", "scope").orderBy("path")  # a request's notes of a scope
    mine = mine.withColumn("n", F.row_number().over(place)).withColumn("globals", F.count_if(F.col("scope") == "global_notes").over(Window.partitionBy("request")))
    own = F.col("scope") == "project_notes"
    leaning = F.col("w_global") > F.col("w_project")
    kept = mine.where(~(leaning & own) | ((F.col("globals") < PLENTY) & (F.col("n") <= PROJECT_CAP)))
    second = F.when(leaning, own).otherwise(~own)
    order = Window.partitionBy("request").orderBy(second, "path")
    return kept.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= SCANNED).select("request", "path", "pos")


def recall(requests: DataFrame, topics: DataFrame, surfaced: DataFrame, k: int = RECALLED) -> DataFrame:
    """(query_no, pos, chunk_id): the ``k`` notes recalled for each request, chosen among its candidates by worth and diversity.

    requests also have question; topics the columns of hits (chunk_id, title, summary, tag_text, content, modified).
    """
    chosen = cut(recall_candidates(requests, topics, surfaced))  # SCANNED rows a request
    own = topics.join(chosen.select("path").distinct(), "path", "left_semi").dropDuplicates(["path"])
    rows = chosen.join(own, "path").join(requests.select("request", "question"), "request")
    return diverse(rows.withColumnsRenamed({"request": "query_no", "pos": "rank"}), k)


# -- a second search over transcripts -------------------------------------------

# The words that call for a transcript, and what it is to hold.
CUES = ["previous chat", "previous conversation", "last conversation", "our last chat", "last time", "looking back", "going through our previous", "we talked about", "we discussed", "follow up on our previous"]
MADE = ["you created", "you generated", "you wrote", "you drafted", "you gave me", "you made"]
SECTIONS = "chorus verse bridge outro chapter section ingredients instructions steps code subject table row option".split()
ARTEFACTS = "song songs poem poems lyrics chord chords progression progressions notes recipe recipes itinerary schedule outline email letter draft table code answer response option".split()
ORDINALS = [("first", "1st"), ("second", "2nd"), ("third", "3rd"), ("fourth", "4th")]
DESCRIPTOR_SKIP = "back chat conversation created create drafted earlier generated gave looking made previous remind remember said two wrote".split()
HEADING = r"(?i)^\s*(verse|chorus|bridge|outro|chapter|section|ingredients|instructions|steps?|code|subject|table|row|option)\b(?:\s+\d+)?\s*:"
MARKER = r"^\s*\[([A-Za-z][A-Za-z0-9_-]*)\]\s*:\s*(.*)$"
# Sizes, and the scores of what is added.
SEARCHED, TRIED, ADDED, SNIPPET, SHORT, DECAY, FLOOR = 32, 8, 3, 1600, 1200, 0.08, 0.72


def _any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(text, t))


def _held(text: Column, terms: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(t), F.lit(t)) for t in terms]))


def ordinal_marker(text: Column, ordinal: Column) -> Column:
    """Whether a text says the ordinal (1 to 4) in words or as a number."""
    of = lambda i: functools.reduce(operator.or_, [text.contains(x) for x in (*ORDINALS[i - 1], f"artefact {i}", f"artifact {i}", f"option {i}")])
    return functools.reduce(lambda rest, i: F.when(ordinal == i, of(i)).otherwise(rest), range(1, 5), F.lit(False))


def profile(questions: DataFrame) -> DataFrame:
    """Adds what a question asks of a transcript: enabled, reason, ordinal (0 if none), sections, artefacts and descriptors (three at most)."""
    q = F.lower(F.coalesce("question", F.lit("")))
    some = lambda xs: functools.reduce(operator.or_, [q.contains(x) for x in xs])
    cue = some(CUES) | (q.contains("remind me") & some(["previous", "last", "earlier"]))
    padded = F.concat(F.lit(" "), F.trim(q), F.lit(" "))
    ordinal = functools.reduce(lambda rest, i: F.when(padded.contains(f" {ORDINALS[i - 1][0]} ") | padded.contains(f" {ORDINALS[i - 1][1]} "), i).otherwise(rest), range(4, 0, -1), F.lit(0))
    out = questions.withColumns({"ordinal": ordinal, "sections": F.slice(_held(q, SECTIONS), 1, len(SECTIONS)), "artefacts": F.array_distinct(F.transform(_held(q, ARTEFACTS), lambda t: F.regexp_replace(t, "s$", "")))})
    plain = lambda t: (F.octet_length(t) >= 3) & ~t.isin(W.QUESTION_STOP) & ~t.isin(W.BOUNDARY) & ~t.isin(W.FACET_SKIP) & ~t.isin(DESCRIPTOR_SKIP) & ~t.rlike(r"\p{Nd}")
    own = F.filter(P.phrase_tokens(q), lambda t: plain(t) & ~_any(t, F.col("artefacts")) & ~_any(t, F.col("sections")) & ~ordinal_marker(t, F.col("ordinal")))
    has = F.size("sections") > 0
    enabled = cue & ((F.size("artefacts") > 0) | some(MADE) | has)
    reason = F.when((F.col("ordinal") > 0) & has, "ordinal_section_artifact").when(F.col("ordinal") > 0, "ordinal_artifact").when(has, "section_artifact").otherwise("artifact")
    return out.withColumns({"descriptors": F.array_distinct(F.slice(own, 1, 3)), "enabled": enabled, "reason": F.when(enabled, reason)})


def satisfied(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_no) of the profiled questions whose best eight hits hold one that says all they ask for."""
    rows = hits.where(F.col("rank") <= 8).select("query_no", "text").join(questions, "query_no").where("text <> ''")
    asks = lambda terms: (F.size(terms) == 0) | _any(F.col("text"), F.col(terms))
    fits = ((F.col("ordinal") == 0) | ordinal_marker(F.col("text"), F.col("ordinal"))) & asks("sections") & asks("artefacts")
    return rows.where(fits).select("query_no").distinct()


def recall_queries(questions: DataFrame) -> DataFrame:
    """(query_no, list_no, text): what is searched for profiled questions (with probes): these, and joins of their terms."""
    first = lambda terms, n: F.array_join(F.slice(terms, 1, n), " ")
    a, s, d = F.col("artefacts"), F.col("sections"), F.col("descriptors")
    both, known = P.distinct(F.concat(a, s)), (F.size("artefacts") > 0) | (F.size("sections") > 0)
    described = (F.size("descriptors") > 0) & known
    more = F.array(F.when(known, first(both, 4)), F.when(described, first(P.distinct(F.concat(d, both)), 4)), F.when(described, first(P.distinct(F.concat(d, a)), 4)), F.when(F.size("sections") > 0, first(s, 2)))
    return questions.select("query_no", F.posexplode(P.distinct(F.concat("probes", more))).alias("list_no", "text"))


def labelled_section(text: Column, sections: Column) -> Column:
    """The lines from the first that names a section of ``sections`` on, up to the next heading or message; null without one."""
    lines = F.split(text, "\n")
    low = lambda x: F.trim(F.lower(x))
    named = lambda x: F.exists(sections, lambda t: low(x).startswith(F.concat(t, F.lit(":"))) | low(x).startswith(F.concat(t, F.lit(" "))) | F.contains(low(x), F.concat(t, F.lit(":"))))
    at = F.array_position(F.transform(lines, named), True).cast("int")
    rest = F.slice(lines, at + 1, F.size(lines))
    stop = F.array_position(F.transform(rest, lambda x, i: ((i > 0) & x.rlike(HEADING)) | x.rlike(MARKER)), True).cast("int")
    some = F.slice(lines, at, F.when(stop > 0, stop).otherwise(F.size(rest) + 1))
    return F.when(at > 0, _limited(F.array_join(some, "\n")))


def _limited(text: Column) -> Column:
    """SNIPPET characters of a trimmed text."""
    trim = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return trim(F.substring(trim(text), 1, SNIPPET))


def snippet(text: Column, ordinal: Column, sections: Column, artefacts: Column) -> Column:
    """What a transcript ('[role]: ...' blocks) holds of what is asked: the n-th fitting block of the assistant (the first without an ordinal), or its section; else a
    section of the whole, else four lines before to eleven after the line that says most. Null without any."""
    parts = F.filter(F.split(text, r"(?m)(?=^\s*\[[A-Za-z][A-Za-z0-9_-]*\]\s*:)"), lambda p: p.rlike(r"(?i)^\s*\[assistant\]\s*:"))
    said = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"(?i)^\s*\[assistant\]\s*:\s*", ""), r"\s+$", ""))
    fits = F.filter(said, lambda b: (b != "") & ((F.size(artefacts) == 0) | _any(F.lower(b), artefacts) | _any(F.lower(b), sections)))
    block = F.try_element_at(fits, F.greatest(F.lit(1), ordinal))
    own = F.coalesce(labelled_section(block, sections), _limited(block))
    labelled = F.when(ordinal > 0, F.concat(F.lit("Assistant artefact "), ordinal.cast("string"), F.lit(":\n"), own)).otherwise(own)
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    worth = lambda x: F.when(_any(F.lower(x), sections), 5).otherwise(0) + F.when(_any(F.lower(x), artefacts), 3).otherwise(0) + F.when(ordinal_marker(F.lower(x), ordinal), 4).otherwise(0)
    points = F.transform(lines, worth)
    best = F.array_position(points, F.array_max(points)).cast("int")
    about = F.slice(lines, F.greatest(F.lit(1), best - 4), F.least(F.size(lines), best + 11) - F.greatest(F.lit(1), best - 4) + 1)
    return F.coalesce(F.when(block.isNotNull(), labelled), labelled_section(text, sections), F.when(F.array_max(points) > 0, _limited(F.array_join(about, "\n"))))


def episodic(questions: DataFrame, hits: DataFrame, transcripts: DataFrame, probes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(query_no, chunk_id, path, score, rank, expanded, text): the hits of all questions, and for those that ask for an earlier conversation and whose hits do not
    hold it up to ADDED snippets of ``transcripts`` (chunk_id, path, content).

    probes(questions) adds what is searched; SEARCHED rows of each of these lists are fused, the first TRIED with a snippet are ordered by how well they
    fit. An addition's score is a share of the best hit's (of 1/61 without hits), less for each further one. Paths among the hits are not added.
    """
    asked = profile(questions).where("enabled")
    asked = asked.join(satisfied(asked, hits), "query_no", "left_anti")
    lists = recall_queries(probes(asked))
    number = lists.withColumn("q", F.xxhash64("query_no", "list_no"))
    found = search.best_of_each(search.bm25_table(transcripts, number.select(F.col("q").alias("query_no"), F.explode(first_terms(F.col("text"))).alias("term"))), SEARCHED)
    ranks = found.select(F.col("query_no").alias("q"), "chunk_id", "rank").join(number.select("q", F.col("query_no").alias("n")), "q")
    fused = ranks.groupBy("n", "chunk_id").agg(F.round(F.sum(1.0 / (search.RRF_K + F.col("rank"))), 9).alias("score")).withColumnRenamed("n", "query_no")
    fused = search.best_of_each(fused, SEARCHED * 16)
    rows = fused.select("query_no", "chunk_id", F.col("rank").alias("at")).join(transcripts.select("chunk_id", "path", "content"), "chunk_id").join(asked.select("query_no", "ordinal", "sections", "artefacts", "descriptors"), "query_no")
    rows = rows.join(hits.select("query_no", "path").distinct(), ["query_no", "path"], "left_anti")
    rows = rows.withColumn("said", snippet(F.col("content"), F.col("ordinal"), F.col("sections"), F.col("artefacts"))).where("said is not null and said <> ''")
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_no").orderBy("at"))).where(F.col("_n") <= TRIED)
    raw, said = F.lower("content"), F.lower("said")
    some = lambda test, points: F.when(test, points).otherwise(0)
    blocks = F.size(F.regexp_extract_all("content", F.lit(r"(?m)^\s*\[[A-Za-z][A-Za-z0-9_-]*\]\s*:"), F.lit(0)))
    quality = some(_any(said, F.col("sections")), 10) + some(_any(raw, F.col("descriptors")), 7) + some(_any(raw, F.col("artefacts")), 3) + some((F.col("ordinal") > 0) & (blocks >= F.col("ordinal") * 2), 4) + some(F.length("said") <= SHORT, 2)
    place = Window.partitionBy("query_no").orderBy(F.desc("quality"), "at")  # TRIED rows
    added = rows.withColumn("quality", quality).withColumn("i", F.row_number().over(place) - 1).where(F.col("i") < ADDED)
    top = hits.groupBy("query_no").agg(F.max_by("score", -F.col("rank")).alias("top"))
    has = F.size("sections") > 0
    base = F.when((F.col("ordinal") > 0) & has, 0.985).when((F.col("ordinal") > 0) | has, 0.96).otherwise(0.94)
    share = F.when(F.col("i") == 0, base).otherwise(F.greatest(F.lit(FLOOR), base - DECAY * F.col("i")))
    best = F.when(F.coalesce("top", F.lit(0.0)) > 0, F.col("top")).otherwise(1.0 / (search.RRF_K + 1))
    added = added.join(top, "query_no", "left").select("query_no", "chunk_id", "path", F.round(best * share, 9).alias("score"), F.lit(True).alias("expanded"), F.col("said").alias("text"))
    every = hits.select("query_no", "chunk_id", "path", "score", F.lit(False).alias("expanded"), "text").unionByName(added)
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "path")  # a question's hits
    return every.withColumn("rank", F.row_number().over(order)).select("query_no", "chunk_id", "path", "score", "rank", "expanded", "text")
