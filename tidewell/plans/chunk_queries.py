"""Queries of chunks, transcripts, joins of ranked lists and index upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import chunks, filters, knowledge, search, stats
from ..session import table
from ..sources.corpus import corpus, vectors
from ..sources.hits import HITS_SQL, TALK_SQL, hits, talk
from .registry import query
from .search_queries import COS, C, TERMS, bm25_sql

MARKDOWN = "CASE WHEN text IS NULL THEN NULL ELSE '# Doc ' || doc_id || chr(10) || replace(text, '. ', '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '## Part' ELSE '### Deep' END || chr(10)) END"


def markdown(spark, d):
    mark = F.when(F.col("doc_id") % 2 == 0, "## Part").otherwise("### Deep")
    text = F.concat(F.lit("# Doc "), F.col("doc_id"), F.lit("\n"), F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), mark, F.lit("\n"))))
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


@query("t8_sections", f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ordinal, s AS section FROM (SELECT doc_id, i, s FROM (SELECT doc_id, string_split(regexp_replace({MARKDOWN}, '(?m)^(#{{1,6}} )', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents), unnest(p) WITH ORDINALITY AS u(s, i)) WHERE trim(s) <> ''")
def t8(spark, d):
    return knowledge.sections(markdown(spark, d).where("text is not null"), "doc_id", "text")


@query("t11_segments")
def t11(spark, d):
    """Sentence-bounded chunks of every document. No SQL: tested by what chunks must keep."""
    return chunks.segments(markdown(spark, d), "doc_id", "text")


@query("t12_heading_paths", f"""SELECT doc_id, CASE WHEN k = 1 THEN 'Doc ' || doc_id ELSE 'Doc ' || doc_id || ' > ' || CASE WHEN doc_id % 2 = 0 THEN 'Part' ELSE 'Deep' END END AS path, count(*) AS n
FROM (SELECT doc_id, CASE WHEN i = 2 THEN 1 ELSE 2 END AS k, s FROM (SELECT doc_id, string_split(regexp_replace({MARKDOWN}, '(?m)^(#{{1,6}} )', chr(1) || '\\1', 'g'), chr(1)) AS p FROM documents), unnest(p) WITH ORDINALITY AS u(s, i)) WHERE trim(s) <> '' GROUP BY ALL""")
def t12(spark, d):
    return chunks.heading_paths(markdown(spark, d), "doc_id", "text").groupBy("doc_id", "path").agg(F.count("*").alias("n"))


@query("t4_collapsed", "SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\\n[ \\t]*\\n'), lambda p: trim(regexp_replace(p, '[ \\t\\r\\n]+', ' ', 'g'))), lambda p: p <> ''), chr(10) || chr(10)) AS text FROM documents")
def t4(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse_paragraphs(F.coalesce("text", F.lit(""))).alias("text"))


@query("t7_url", "SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/?#\\s]+') THEN u END AS url FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN trim(url) ELSE 'https://' || trim(url) END AS u FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^[a-zA-Z]+://', '') WHEN page_id % 7 = 0 THEN 'ftp://x/' ELSE url END AS url FROM pages))")
def t7(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^[a-zA-Z]+://", "")).when(F.col("page_id") % 7 == 0, "ftp://x/").otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.web_url(url).alias("url"))


@query("t22_plain_text")
def t22(spark, d):
    """NFKC without format characters. No SQL: tested on small texts."""
    return table(spark, d, "documents").select("doc_id", T.plain(F.col("text")).alias("text"))


@query("t18_session_date", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2024-02-03' WHEN p_partkey % 3 = 1 THEN '2024-01-02' ELSE '2023-12-31' END AS day FROM part")
def t18(spark, d):
    n = F.col("p_partkey")
    own = F.when(n % 3 == 0, "session_date: 2024-02-03\nobserved_on: 2024-01-02\n").when(n % 3 == 1, "observed_on: '2024-01-02'\n").otherwise("")
    m = knowledge.frontmatter(F.concat(F.lit("---\nmodified: 2023-12-31\n"), own, F.lit("name: x\n---\nbody")))
    return table(spark, d, "part").select("p_partkey", knowledge.session_date(m).alias("day"))


@query("t26_rendered", f"WITH {HITS_SQL} SELECT query_no, string_agg(rank || '. [' || coalesce(CAST(modified AS VARCHAR), 'undated') || '] (' || session_id || ', ' || source_role || ') ' || text, chr(10) ORDER BY rank) AS passages FROM hits WHERE rank <= 20 GROUP BY query_no")
def t26(spark, d):
    return knowledge.render(hits(spark, d), 20)


@query("i12_blocks", f"WITH {TALK_SQL} SELECT conv_id, turn - min(turn) OVER (PARTITION BY conv_id) AS pos, role, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS said FROM talk")
def i12(spark, d):
    t = talk(spark, d)
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("["), x["role"], F.lit("]: "), x["text"]))
    whole = t.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("text"))  # a session's turns
    return chunks.message_blocks(whole, "conv_id", "text").withColumn("said", F.regexp_replace("said", r"^\s+|\s+$", ""))


@query("i14_recall_snippet", f"""WITH {TALK_SQL}, l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM talk), b AS (SELECT conv_id, turn, l, list_transform(l, lambda x: CAST(contains(lower(x), 'bike') AS INT) + CAST(contains(lower(x), 'market') AS INT)) AS n FROM l)
SELECT conv_id, turn, CAST(list_position(n, list_max(n)) - 1 AS INT) AS line, array_to_string(l[greatest(1, list_position(n, list_max(n)) - 4) : list_position(n, list_max(n)) + 12], chr(10)) AS snippet FROM b WHERE list_max(n) > 0""")
def i14(spark, d):
    rows = talk(spark, d).withColumn("k", F.struct("conv_id", "turn"))
    return chunks.recall_snippet(rows, "k", "text", ["bike", "market"]).select("k.conv_id", "k.turn", "line", "snippet")


@query("j3_single_list", bm25_sql(TERMS) + " SELECT chunk_id, round(1.0 / (60 + row_number() OVER (ORDER BY score DESC, chunk_id)), 9) AS score FROM bm ORDER BY score DESC LIMIT 30")
def j3(spark, d):
    return search.rrf(search.ranked(search.bm25(corpus(spark, d), TERMS), 30))


@query("j8_hydrated", bm25_sql(TERMS) + " SELECT chunk_id, title, content FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 30) JOIN corpus USING (chunk_id)")
def j8(spark, d):
    rows = corpus(spark, d)
    top = search.ranked(search.bm25(rows, TERMS), 30).select("chunk_id")
    return rows.join(F.broadcast(top), "chunk_id").select("chunk_id", "title", "content")  # thirty ids


@query("j11_sorted", bm25_sql(TERMS) + " SELECT chunk_id, row_number() OVER (ORDER BY score DESC, modified DESC NULLS LAST, chunk_id) AS pos FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 50) JOIN corpus USING (chunk_id)")
def j11(spark, d):
    rows = corpus(spark, d)
    top = search.ranked(search.bm25(rows, TERMS), 50).join(rows.select("chunk_id", "modified"), "chunk_id")
    return top.select("chunk_id", F.row_number().over(Window.orderBy(F.desc("score"), F.desc_nulls_last("modified"), "chunk_id")).alias("pos"))  # fifty rows


@query("j13_vector_rows", "SELECT v.vec_id AS chunk_id, path, label FROM embeddings v JOIN (" + C + " SELECT * FROM corpus) c ON c.chunk_id = v.vec_id")
def j13(spark, d):
    return vectors(spark, d).join(corpus(spark, d).select(F.col("chunk_id").alias("id"), "path"), "id").select(F.col("id").alias("chunk_id"), "path", "label")


@query("j14_has_vectors", "SELECT CAST(label AS INT) AS label, count(*) > 0 AS has FROM embeddings WHERE len(embedding) = 64 GROUP BY label")
def j14(spark, d):
    return vectors(spark, d).where("dim = 64").groupBy(F.col("label").cast("int").alias("label")).agg((F.count("*") > 0).alias("has"))


@query("s7_indexed_rows", C + " SELECT chunk_id, path, scope, lower(title) AS title_key, sha256(coalesce(content, '')) AS checksum, CASE WHEN modified IS NULL THEN [] ELSE [CAST(modified AS VARCHAR), strftime(modified, '%Y/%m/%d'), strftime(modified, '%Y'), lower(dayname(modified)), lower(monthname(modified))] END AS date_tokens FROM corpus")
def s7(spark, d):
    return filters.index_rows(corpus(spark, d))


@query("s17_chunk_upsert", C + ", u AS (SELECT chunk_id, path, 1 AS version FROM corpus UNION ALL SELECT chunk_id, path || '.new', 2 FROM corpus WHERE chunk_id % 4 = 0 UNION ALL SELECT chunk_id + 1000000, path, 1 FROM corpus WHERE chunk_id % 9 = 0) SELECT chunk_id, path FROM u QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY version DESC) = 1")
def s17(spark, d):
    rows = corpus(spark, d).select("chunk_id", "path")
    new = rows.where("chunk_id % 4 = 0").select("chunk_id", F.concat("path", F.lit(".new")).alias("path"))
    more = rows.where("chunk_id % 9 = 0").select((F.col("chunk_id") + 1000000).alias("chunk_id"), "path")
    every = rows.withColumn("version", F.lit(1)).union(new.withColumn("version", F.lit(2))).union(more.withColumn("version", F.lit(1)))
    return filters.upsert_latest(every, ["chunk_id"], "version").drop("version")


@query("s14_model_vectors", "SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings WHERE len(embedding) = 64")
def s14(spark, d):
    return vectors(spark, d).where("model = 'm' and dim = 64").select("id", "label", "dim")


@query("a9_selection", "SELECT event_type AS category, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5('7:' || event_id), event_id) <= 5")
def a9(spark, d):
    return stats.select_some(table(spark, d, "events").select(F.col("event_type").alias("category"), "event_id"), "category", "event_id", 5, 7)


@query("a15_tool_calls", "SELECT user_id, event_type AS tool, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL")
def a15(spark, d):
    return stats.tool_calls(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("a19_run_stats", """WITH x AS (SELECT event_type AS category, CAST(value > 50 AS INT) AS hit, value FROM events WHERE value IS NOT NULL)
SELECT category, count(*) AS run, round(avg(hit), 9) AS score, round(quantile_disc(value, 0.5), 9) AS p50, round(quantile_disc(value, 0.95), 9) AS p95 FROM x GROUP BY category""")
def a19(spark, d):
    rows = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("category"), (F.col("value") > 50).cast("int").alias("hit"), "value")
    marks = stats.nearest_rank(rows, "category", "value", [50, 95])
    runs = rows.groupBy("category").agg(F.count("*").alias("run"), F.round(F.avg("hit"), 9).alias("score"))
    return runs.join(marks, "category").select("category", "run", "score", F.round("p50", 9).alias("p50"), F.round("p95", 9).alias("p95"))


@query("i9_neighbours", C + f""", s AS (SELECT chunk_id, session_id, source_role, modified, 1.0::DOUBLE / (1 + chunk_id) AS score FROM corpus WHERE chunk_id % 53 = 0)
SELECT chunk_id, round(max(least(0.95 * s_score, s_score * CASE WHEN chunk_id > s_id THEN 0.55 ELSE 0.72 END * CASE WHEN role = s_role THEN 1.05 ELSE 1 END * CASE WHEN day = s_day THEN 1.08 ELSE 1 END)), 9) AS score
FROM (SELECT c.chunk_id, c.source_role AS role, c.modified AS day, s.chunk_id AS s_id, s.score AS s_score, s.source_role AS s_role, s.modified AS s_day FROM corpus c JOIN s ON c.session_id = s.session_id AND c.chunk_id NOT IN (SELECT chunk_id FROM s)) GROUP BY chunk_id""")
def i9(spark, d):
    from ..operators import ranking

    rows = corpus(spark, d).select("chunk_id", "session_id", "source_role", "modified")
    return ranking.neighbour_scores(rows, rows.where("chunk_id % 53 = 0").withColumn("score", 1.0 / (1 + F.col("chunk_id"))))


@query("i7_stamped", C + " SELECT path, CASE WHEN chunk_id % 13 = 0 THEN superseded_by WHEN chunk_id % 10 = 3 THEN 'new/' || chunk_id ELSE '' END AS superseded_by FROM corpus")
def i7(spark, d):
    from ..operators import intervals

    rows = corpus(spark, d)
    new = rows.where("chunk_id % 10 = 3").select("path", F.concat(F.lit("new/"), "chunk_id").alias("by"))
    return intervals.stamp(rows.select("path", "superseded_by"), new)


@query("v2_knn_many", f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS similarity, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format('e.embedding', 'q.embedding')} DESC, e.vec_id) AS INT) AS rank
FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id QUALIFY rank <= 20""")
def v2_many(spark, d):
    v = vectors(spark, d).select("id", "embedding")
    return search.knn_many(v, v.where("id % 100 = 0"), 20)


@query("s20_ingest", """WITH t AS (SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '^(md|markdown)$') THEN 'text/markdown' WHEN regexp_matches(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '^html?$') THEN 'text/html' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'pdf' OR starts_with(html, '%PDF') THEN 'application/pdf'
  WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'json' THEN 'application/json' WHEN regexp_matches(lower(left(html, 400)), '<(!doctype html|html)\\b') THEN 'text/html' ELSE 'text/plain' END AS kind, html FROM pages),
x AS (SELECT page_id, kind, CASE WHEN kind = 'text/html' THEN trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g')) ELSE coalesce(html, '') END AS text FROM t)
SELECT page_id, kind, text, sha256(text) AS checksum, (strlen(text) + 3) // 4 AS tokens FROM x""")
def s20(spark, d):
    return knowledge.ingest(table(spark, d, "pages"))
