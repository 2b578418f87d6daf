"""Queries of the cascade of further searches: its SQL runs every rung for all questions and picks the first that is accepted."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import questions, retry
from ..sources.hits import K, POSED_SQL, SEARCHED_SQL, TOK, TERMS_SQL, any_word, bm25_table_sql, posed, searched
from .intent_queries import STRONGEST, WORDS_SQL, quality_sql
from .registry import query
from .search_queries import GRAMS

#: The rows of an index that was last built on this day; the refreshed one holds all.
BUILT = "1996-06-30"


def _cascade(spark, d):
    built = F.col("modified") <= F.lit(BUILT).cast("date")
    return retry.cascade(posed(spark, d), searched(spark, d), built, lambda: questions.date_hints(F.col("question"), F.col("day")), lambda ids: searched(spark, d, ids))


def _found(name: str, rows: str, terms: str, bounded: bool = True) -> str:
    """Hits ``name`` of the best K rows of each question by BM25 over its terms."""
    later = "JOIN asked USING (query_no) WHERE s.modified <= day" if bounded else ""
    return f"""{name}_w AS (SELECT query_no, unnest({terms}) AS term FROM asked), {bm25_table_sql(rows, f"{name}_w", f"{name}_b")},
{name}_k AS (SELECT query_no, chunk_id, b.score, lower(concat_ws(chr(10), path, title, summary, content)) AS text FROM {name}_b b JOIN {rows} s USING (chunk_id) {later}),
{name} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM {name}_k QUALIFY rank <= {K})"""


WORD = f"list_distinct({WORDS_SQL})"
ONE = f"CASE WHEN {STRONGEST} IS NOT NULL THEN [{STRONGEST}] END"
OTHER = f"CASE WHEN {STRONGEST} IS NOT NULL AND {STRONGEST} <> trim(lower(question)) THEN [{STRONGEST}] END"
ALIKE = f"""h5_a AS (SELECT query_no, day, unnest({WORD}) AS word FROM asked), h5_g AS (SELECT *, {GRAMS.format('word')} AS w FROM h5_a), h5_q AS (SELECT query_no, day, word, len(w) AS m, unnest(w) AS gram FROM h5_g),
h5_r AS (SELECT chunk_id, modified, {GRAMS.format("regexp_extract(path, '([^/]*?)(?:\\.md)?$', 1)")} AS g FROM searched), h5_s AS (SELECT chunk_id, modified, len(g) AS n, unnest(g) AS gram FROM h5_r),
h5_c AS (SELECT query_no, chunk_id, round(count(*) / (n + m - count(*)), 9) AS score FROM h5_q JOIN h5_s USING (gram) WHERE modified <= day GROUP BY query_no, chunk_id, word, n, m),
h5_b AS (SELECT query_no, chunk_id, max(score) AS score FROM h5_c WHERE score >= 0.3 GROUP BY ALL),
h5 AS MATERIALIZED (SELECT query_no, chunk_id, score, lower(concat_ws(chr(10), path, title, summary, content)) AS text, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM h5_b JOIN searched USING (chunk_id) QUALIFY rank <= {K})"""
HAS = {0: "true", 1: f"{OTHER} IS NOT NULL", 3: f"len({WORD}) > 0", 4: f"{STRONGEST} IS NOT NULL", 5: f"len({WORD}) > 0", 6: "true"}
CASCADE = f"""WITH {SEARCHED_SQL}, {POSED_SQL}, built AS (SELECT * FROM searched WHERE modified <= DATE '{BUILT}'), {_found("h0", "built", TERMS_SQL)}, {_found("h1", "built", OTHER)}, {_found("h3", "searched", WORD)},
{_found("h4", "searched", ONE)}, {ALIKE}, {_found("h6", "built", TERMS_SQL, False)}, {", ".join(quality_sql(f"h{r}", f"q{r}") for r in HAS)},
tried AS ({" UNION ALL ".join(f"SELECT q{r}.query_no, {r} AS rung, '{retry.REASONS[r]}' AS reason, coalesce(n, 0) AS n_hits, label, q{r}.score, retry FROM q{r} JOIN asked USING (query_no) LEFT JOIN (SELECT query_no, count(*) AS n FROM h{r} GROUP BY ALL) USING (query_no) WHERE {has}" for r, has in HAS.items())}),
base AS (SELECT query_no, label AS b_label, score AS b_score, n_hits AS b_hits FROM tried WHERE rung = 0),
fits AS (SELECT *, CASE WHEN rung = 0 THEN NOT retry WHEN n_hits = 0 THEN false ELSE b_hits = 0 OR (label = 'good' AND b_label <> 'good' AND score >= b_score) OR score >= b_score + 0.2 END AS accepted FROM tried JOIN base USING (query_no)),
ran AS (SELECT *, coalesce(bool_or(accepted) OVER (PARTITION BY query_no ORDER BY rung ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS closed FROM fits),
attempts AS (SELECT query_no, rung, reason, CAST(n_hits AS INT) AS n_hits, label, score, accepted FROM ran WHERE NOT closed AND (rung < 6 OR b_hits = 0))"""


@query("r27_retry_attempts", f"{CASCADE} SELECT * FROM attempts")
def r27(spark, d):
    return _cascade(spark, d)[0]


@query("r27_retry_hits", f"""{CASCADE}, every AS ({" UNION ALL ".join(f"SELECT query_no, chunk_id, rank, {r} AS rung FROM h{r}" for r in HAS)}),
used AS (SELECT e.* FROM every e WHERE rung = 0 OR EXISTS (SELECT 1 FROM attempts a WHERE a.query_no = e.query_no AND a.rung = e.rung AND accepted)),
one AS (SELECT query_no, chunk_id, min((rung = 0, rank, rung)) AS m FROM used GROUP BY ALL)
SELECT query_no, chunk_id, CAST(row_number() OVER (PARTITION BY query_no ORDER BY m, chunk_id) AS INT) AS rank, m[3] AS rung FROM one""")
def r27_hits(spark, d):
    return _cascade(spark, d)[1]
