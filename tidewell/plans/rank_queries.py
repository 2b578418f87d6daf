"""Queries of reweighting, evidence, validity and session expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals, ranking, search
from ..session import table
from ..sources.corpus import corpus, messages
from .registry import query
from .search_queries import C, TERMS, bm25_sql


@query("r13_temporal", bm25_sql(TERMS) + """, h AS (SELECT chunk_id, score, modified FROM bm JOIN corpus USING (chunk_id) WHERE modified IS NULL OR modified <= DATE '2024-09-30'),
s AS (SELECT min(modified) AS lo, max(modified) AS hi FROM h)
SELECT chunk_id, round(score * CASE WHEN modified IS NULL THEN 0.95 ELSE (CASE WHEN abs(date_diff('day', modified, DATE '2024-06-01')) <= 1 THEN 1.35
  WHEN abs(date_diff('day', modified, DATE '2024-06-01')) <= 7 THEN 1.2 WHEN abs(date_diff('day', modified, DATE '2024-06-01')) <= 30 THEN 1.08 ELSE 0.92 END)
  * (1 + 0.25 * date_diff('day', lo, modified) / date_diff('day', lo, hi)) END, 9) AS score FROM h, s""")
def r13(spark, d):
    rows = corpus(spark, d)
    return ranking.temporal(search.bm25(rows, TERMS).join(rows.select("chunk_id", "modified"), "chunk_id"), "2024-09-30", "2024-06-01")


@query("r16_exact_repeats", "SELECT conv_id AS session_id, min(turn) AS turn FROM conversations GROUP BY conv_id, lower(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')))")
def r16(spark, d):
    return ranking.exact_repeats(messages(spark, d), "session_id", "content", "turn")


@query("r19_amounts", f"SELECT doc_id, list_transform(regexp_extract_all(text, '{ranking.MONEY}', 2), lambda x: CAST(round(CAST(replace(x, ',', '') AS DOUBLE) * 100) AS BIGINT)) AS cents, list_transform(regexp_extract_all(text, '{ranking.QUANTITY}', 1), lambda x: CAST(x AS DOUBLE)) AS counts FROM documents WHERE text IS NOT NULL")
def r19(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", ranking.amounts(t).alias("cents"), ranking.quantities(t).alias("counts"))


@query("r25_rerank_text", C + " SELECT chunk_id, CASE WHEN trim(title) <> '' AND array_to_string(tags, ' ') <> '' THEN title || chr(10) || array_to_string(tags, ' ') WHEN trim(title) <> '' THEN title WHEN array_to_string(tags, ' ') <> '' THEN array_to_string(tags, ' ') ELSE left(content, 280) END AS text FROM corpus")
def r25(spark, d):
    title, summary = F.col("title"), F.array_join("tags", " ")
    text = F.when((F.trim(title) != "") & (summary != ""), F.concat_ws("\n", title, summary)).when(F.trim(title) != "", title).when(summary != "", summary).otherwise(F.substring("content", 1, 280))
    return corpus(spark, d).select("chunk_id", text.alias("text"))


CLAIMS_SQL = """claims AS (SELECT event_id AS id, user_id || '.' || event_type AS key, CASE WHEN event_id % 17 = 0 THEN '' ELSE props END AS value,
  CASE WHEN event_id % 5 <> 0 THEN CAST(ts AS DATE) END AS lo, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) + CAST(event_id % 9 - 1 AS INT) END AS hi, event_id AS seq FROM events)"""


def claims(spark, d):
    """Events as claims of a user's state, with windows of some days, some of them open or invalid."""
    day, n = F.to_date("ts"), F.col("event_id")
    return table(spark, d, "events").select(
        n.alias("id"), F.concat_ws(".", "user_id", "event_type").alias("key"), F.when(n % 17 == 0, "").otherwise(F.col("props")).alias("value"),
        F.when(n % 5 != 0, day).alias("lo"), F.when(n % 7 != 0, F.date_add(day, (n % 9 - 1).cast("int"))).alias("hi"), n.alias("seq"),
    )


@query("i1_contains", f"WITH {CLAIMS_SQL} SELECT id FROM claims WHERE coalesce(lo <= hi, true) AND coalesce(DATE '2024-01-15' >= lo, true) AND coalesce(DATE '2024-01-15' <= hi, true)")
def i1(spark, d):
    return claims(spark, d).where(intervals.contains(F.col("lo"), F.col("hi"), F.lit("2024-01-15").cast("date"))).select("id")


@query("i2_overlaps", f"WITH {CLAIMS_SQL} SELECT id FROM claims WHERE coalesce(lo <= hi, true) AND coalesce(lo <= DATE '2024-01-20', true) AND coalesce(DATE '2024-01-10' <= hi, true)")
def i2(spark, d):
    lo, hi = (F.lit(x).cast("date") for x in ("2024-01-10", "2024-01-20"))
    return claims(spark, d).where(intervals.overlaps(F.col("lo"), F.col("hi"), lo, hi)).select("id")


@query("i3_supersession", f"""WITH {CLAIMS_SQL}, g AS (SELECT *, CASE WHEN coalesce(lo <= hi, true) AND trim(value) <> '' THEN id END AS ok FROM claims), b AS (SELECT *, coalesce(last_value(ok IGNORE NULLS) OVER w, lag(id) OVER (PARTITION BY key ORDER BY seq)) AS p_id FROM g WINDOW w AS (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT b.*, c.value AS p_value, c.lo AS p_lo, c.hi AS p_hi FROM b JOIN claims c ON c.id = b.p_id)
SELECT id, p_id AS old_id, CASE WHEN NOT coalesce(lo <= hi, true) OR NOT coalesce(p_lo <= p_hi, true) THEN 'invalid-window' WHEN NOT (coalesce(lo <= p_hi, true) AND coalesce(p_lo <= hi, true)) THEN 'disjoint-validity'
  WHEN trim(value) = '' OR trim(p_value) = '' THEN 'empty-value' WHEN lower(trim(value)) = lower(trim(p_value)) THEN 'same-value' ELSE 'same-key-different-value' END AS reason FROM p WHERE p_id IS NOT NULL""")
def i3(spark, d):
    return intervals.supersession(claims(spark, d))


@query("i5_metadata_key", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^\\p{L}\\p{N}]+', '.', 'g'), '.') AS key FROM part")
def i5(spark, d):
    from ..functions.text import metadata_key

    return table(spark, d, "part").select("p_partkey", metadata_key(F.concat_ws(" / ", "p_name", "p_type")).alias("key"))


@query("i8_session_neighbours", C + """, s AS (SELECT chunk_id, session_id FROM corpus WHERE chunk_id IN (3, 57, 104)),
n AS (SELECT session_id, chunk_id FROM corpus WHERE session_id IN (SELECT session_id FROM s) AND chunk_id NOT IN (SELECT chunk_id FROM s) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY chunk_id) <= 3)
SELECT * FROM n ORDER BY session_id, chunk_id LIMIT 12""")
def i8(spark, d):
    rows = corpus(spark, d)
    return ranking.session_neighbours(rows, rows.where(F.col("chunk_id").isin(3, 57, 104)).select("chunk_id", "session_id"))


@query("i11_cluster_sessions", bm25_sql(TERMS) + """, h AS (SELECT chunk_id, session_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank FROM bm JOIN corpus USING (chunk_id) QUALIFY rank <= 40)
SELECT chunk_id, row_number() OVER (ORDER BY f, rank) AS pos FROM (SELECT *, min(rank) OVER (PARTITION BY session_id) AS f FROM h)""")
def i11(spark, d):
    rows = corpus(spark, d)
    hits = search.ranked(search.bm25(rows, TERMS), 40).join(rows.select("chunk_id", "session_id"), "chunk_id")
    return ranking.cluster_by_session(hits)


@query("i15_distinct_sessions", "SELECT 's' || (conv_id % 60) AS session_id, min(conv_id) AS conv_id FROM conversations GROUP BY 1")
def i15(spark, d):
    return table(spark, d, "conversations").groupBy(F.concat(F.lit("s"), F.col("conv_id") % 60).alias("session_id")).agg(F.min("conv_id").alias("conv_id"))
