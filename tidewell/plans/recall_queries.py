"""Queries of recall: candidates by scope, and the second search over transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import probes as P
from ..operators import questions, recall
from ..sources.hits import ASKED_SQL, HITS_SQL, any_word, asked, hits, posed, searched, transcripts
from .probe_queries import keep, match, ordered, words
from .registry import query

#: Groups of requests and notes: a request chooses among the notes of the customers of its group.
GROUPS = 97


def _requests(spark, d):
    n = F.col("query_no")
    return posed(spark, d).select(n.alias("request"), (n % GROUPS).cast("int").alias("grp"), (n % 3).alias("w_global"), (n % 2 + 0.5).alias("w_project"), "question")


def _topics(spark, d):
    rows = searched(spark, d).where("scope in ('global_notes', 'project_notes') and chunk_id < 0 and state_kind = ''")
    return rows.withColumn("grp", (F.regexp_extract("session_id", r"^c(\d+)$", 1).cast("long") % GROUPS).cast("int"))


def _surfaced(spark, d):
    return hits(spark, d).where("rank <= 3").select(F.col("query_no").alias("request"), "path")


@query("m26_candidates", f"""WITH {HITS_SQL}, req AS (SELECT query_no AS request, query_no % {GROUPS} AS grp, query_no % 3 AS wg, query_no % 2 + 0.5 AS wp FROM asked), tp AS (SELECT DISTINCT CAST(substr(session_id, 2) AS BIGINT) % {GROUPS} AS grp, scope, path FROM notes WHERE state_kind = ''),
mine AS (SELECT request, wg > wp AS leaning, scope = 'project_notes' AS own, path FROM req JOIN tp USING (grp) WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.query_no = request AND h.path = tp.path AND rank <= 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY request, own ORDER BY path) AS n, count(*) FILTER (NOT own) OVER (PARTITION BY request) AS globals FROM mine)
SELECT request, path, CAST(row_number() OVER (PARTITION BY request ORDER BY CASE WHEN leaning THEN own ELSE NOT own END, path) AS INT) AS pos FROM num WHERE NOT (leaning AND own) OR (globals < 5 AND n <= 10) QUALIFY pos <= 200""")
def m26(spark, d):
    return recall.recall_candidates(_requests(spark, d), _topics(spark, d), _surfaced(spark, d))


@query("m26_recalled")
def m26_recalled(spark, d):
    """Five notes for each request. No SQL, as each choice depends on those before: its parts have SQL or are tested by brute force."""
    return recall.recall(_requests(spark, d), _topics(spark, d), _surfaced(spark, d))


def _has(terms: list[str], by: str = " OR ") -> str:
    return "(" + by.join(f"contains(q, '{t}')" for t in terms) + ")"


def _list(terms: list[str]) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def _marker(text: str) -> str:
    return "CASE ordinal " + " ".join(f"WHEN {i} THEN " + " OR ".join(f"contains({text}, '{x}')" for x in (*recall.ORDINALS[i - 1], f"artefact {i}", f"artifact {i}", f"option {i}")) for i in range(1, 5)) + " ELSE false END"


def _token(t: str) -> str:
    lists = " AND ".join(f"{t} NOT IN {any_word(w)}" for w in (W.QUESTION_STOP, W.BOUNDARY, W.FACET_SKIP, recall.DESCRIPTOR_SKIP))
    return f"strlen({t}) >= 3 AND {lists} AND NOT {match(t, r'\p{Nd}')} AND len(list_filter(list_concat(artefacts, sections), lambda x: contains({t}, x))) = 0 AND NOT ({_marker(t)})"


ORDINAL = "CASE " + " ".join(f"WHEN contains(' ' || trim(q) || ' ', ' {a} ') OR contains(' ' || trim(q) || ' ', ' {b} ') THEN {i + 1}" for i, (a, b) in enumerate(recall.ORDINALS)) + " ELSE 0 END"


@query("i10_profile", f"""WITH {ASKED_SQL}, l AS (SELECT query_no, lower(question) AS q FROM asked), t AS (SELECT *, CAST({ORDINAL} AS INT) AS ordinal, list_filter({_list(recall.SECTIONS)}, lambda x: contains(q, x)) AS sections,
  {ordered(f"list_transform(list_filter({_list(recall.ARTEFACTS)}, lambda x: contains(q, x)), lambda x: regexp_replace(x, 's$', ''))")} AS artefacts FROM l),
e AS (SELECT *, ({_has(recall.CUES)} OR (contains(q, 'remind me') AND {_has(['previous', 'last', 'earlier'])})) AND (len(artefacts) > 0 OR {_has(recall.MADE)} OR len(sections) > 0) AS enabled FROM t)
SELECT query_no, ordinal, sections, artefacts, {ordered(f"({keep(words('q'), _token)})[1:3]")} AS descriptors, enabled, CASE WHEN enabled THEN CASE WHEN ordinal > 0 AND len(sections) > 0 THEN 'ordinal_section_artifact' WHEN ordinal > 0 THEN 'ordinal_artifact' WHEN len(sections) > 0 THEN 'section_artifact' ELSE 'artifact' END END AS reason FROM e""")
def i10_profile(spark, d):
    return recall.profile(asked(spark, d)).select("query_no", "ordinal", "sections", "artefacts", "descriptors", "enabled", "reason")


@query("i10_episodic_recall")
def i10(spark, d):
    """Hits and snippets of transcripts. No SQL: its profile has SQL, the snippets and their scores are tested against plain Python."""
    hint = lambda rows: P.bm25_probes(rows, questions.date_hints(F.col("question"), F.col("day")))
    return recall.episodic(posed(spark, d), hits(spark, d), transcripts(spark, d), hint).select("query_no", "chunk_id", "path", "score", "rank", "expanded", F.sha2("text", 256).alias("text_sha256"))
