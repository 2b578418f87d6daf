"""Queries of index maintenance, matching, vectors, filters and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import filters, search
from ..session import table
from ..sources.corpus import CORPUS_SQL, corpus, messages, vectors
from .registry import query

C = "WITH " + CORPUS_SQL
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"
ALLTOK = "list_distinct(flatten([" + ", ".join(TOK.format(f) for f in search.FIELDS) + "]))"
TERMS = ["the", "that", "licensed"]


@query("s1_discover_files", C + " SELECT path, scope, project FROM corpus")
def s1(spark, d):
    return corpus(spark, d).where("scope is not null").select("path", "scope", "project")


@query("s2_walk_prefix", C + " SELECT path FROM corpus WHERE starts_with(path, 'wiki/') AND ends_with(path, '.md') AND NOT starts_with(regexp_extract(path, '[^/]*$'), '_')")
def s2(spark, d):
    return filters.walk(corpus(spark, d), "wiki/").select("path")


@query("s3_list_flat", C + """, r AS (SELECT substr(path, 7) AS rest FROM corpus WHERE starts_with(path, 'notes/'))
SELECT 'notes/' || split_part(rest, '/', 1) AS path, bool_or(strpos(rest, '/') > 0) AS is_dir, count(*) AS n FROM r GROUP BY 1""")
def s3(spark, d):
    return filters.list_flat(corpus(spark, d), "notes/")


@query("s4_glob", C + " SELECT path FROM corpus WHERE regexp_matches(regexp_extract(path, '[^/]*$'), '^[12].[^/]*\\.md$')")
def s4(spark, d):
    return filters.glob(corpus(spark, d), "[12]?*.md").select("path")


@query("s6_incremental_diff", C + """, old AS (SELECT path, CASE WHEN chunk_id % 5 = 0 THEN 'stale' ELSE sha256(content) END AS checksum FROM corpus WHERE chunk_id % 7 <> 0
  UNION ALL SELECT 'wiki/gone/' || chunk_id || '.md', 'x' FROM corpus WHERE chunk_id % 50 = 0),
new AS (SELECT path, sha256(content) AS checksum FROM corpus)
SELECT coalesce(new.path, old.path) AS path, CASE WHEN new.path IS NULL THEN 'delete' WHEN old.path IS NULL THEN 'insert' ELSE 'update' END AS action
FROM new FULL JOIN old ON new.path = old.path WHERE new.path IS NULL OR old.path IS NULL OR new.checksum <> old.checksum""")
def s6(spark, d):
    rows = corpus(spark, d)
    now = rows.select("path", F.sha2("content", 256).alias("checksum"))
    old = rows.where("chunk_id % 7 <> 0").select("path", F.when(F.col("chunk_id") % 5 == 0, "stale").otherwise(F.sha2("content", 256)).alias("checksum"))
    old = old.union(rows.where("chunk_id % 50 = 0").select(F.concat(F.lit("wiki/gone/"), "chunk_id", F.lit(".md")), F.lit("x")))
    return filters.index_changes(now, old)


@query("s9_stale_index", C + " SELECT count(v.vec_id) AS indexed, count(*) AS on_disk, count(v.vec_id) < 0.5 * count(*) AS stale FROM corpus LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) v ON vec_id = chunk_id WHERE scope = 'wiki'")
def s9(spark, d):
    return filters.staleness(corpus(spark, d).where("scope = 'wiki'").select(F.col("chunk_id").alias("id")), vectors(spark, d).select("id"))


@query("s10_lookup_rows", C + " SELECT c.path, title, session_id FROM corpus c JOIN (SELECT DISTINCT path FROM corpus WHERE chunk_id % 17 = 0) w ON c.path = w.path")
def s10(spark, d):
    rows = corpus(spark, d)
    return rows.join(rows.where("chunk_id % 17 = 0").select("path").distinct(), "path", "left_semi").select("path", "title", "session_id")


@query("s11_session_rows", C + " SELECT session_id, path, CAST(modified AS VARCHAR) AS modified, row_number() OVER (PARTITION BY session_id ORDER BY modified NULLS FIRST, path) AS pos FROM corpus WHERE session_id IN ('s1', 's7', 's12')")
def s11(spark, d):
    order = Window.partitionBy("session_id").orderBy(F.asc_nulls_first("modified"), "path")
    return corpus(spark, d).where(F.col("session_id").isin("s1", "s7", "s12")).select("session_id", "path", F.col("modified").cast("string").alias("modified"), F.row_number().over(order).alias("pos"))


@query("s12_metadata_rows", C + " SELECT path, scope, project, session_id, CAST(modified AS VARCHAR) AS modified FROM corpus")
def s12(spark, d):
    return corpus(spark, d).select("path", "scope", "project", "session_id", F.col("modified").cast("string").alias("modified"))


@query("s13_vector_upsert", "SELECT vec_id AS id, label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings WHERE len(embedding) = 64")
def s13(spark, d):
    v = vectors(spark, d)
    new = v.where("id % 3 = 0").withColumn("version", F.lit(2))
    bad = v.where("id % 10 = 0").withColumn("embedding", F.slice("embedding", 1, 3)).withColumn("version", F.lit(3))
    return filters.upsert_latest(v.withColumn("version", F.lit(1)).union(new).union(bad).where(F.size("embedding") == 64), ["id", "model"], "version").select("id", "label", "version")


@query("s15_vector_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 1")
def s15(spark, d):
    v = vectors(spark, d)
    return v.join(v.where("id % 4 = 1").select("id"), "id", "left_anti").select("id")


@query("s16_vector_drift", """WITH now AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS checksum FROM documents),
old AS (SELECT vec_id AS id, sha256(trim(coalesce(text, ''))) AS checksum FROM embeddings LEFT JOIN documents ON doc_id = vec_id)
SELECT CASE WHEN old.id IS NULL THEN 'missing' WHEN now.id IS NULL THEN 'stale' WHEN now.checksum <> old.checksum THEN 'changed' ELSE 'fresh' END AS status, count(*) AS n FROM now FULL JOIN old ON now.id = old.id GROUP BY 1""")
def s16(spark, d):
    """Vectors that were made from trimmed texts, against the texts as they are."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    stored = vectors(spark, d).select("id").join(docs, "id", "left").select("id", F.sha2(F.trim(F.coalesce("text", F.lit(""))), 256).alias("checksum"))
    return filters.drift(docs.select("id", F.sha2("text", 256).alias("checksum")), stored).groupBy("status").agg(F.count("*").alias("n"))


@query("s19_delete_by_path", C + " SELECT path FROM corpus WHERE chunk_id % 6 <> 0")
def s19(spark, d):
    rows = corpus(spark, d)
    return rows.join(rows.where("chunk_id % 6 = 0").select("path"), "path", "left_anti").select("path")


@query("q11_date_tokens", "SELECT event_id, [strftime(ts, '%Y-%m-%d'), strftime(ts, '%Y/%m/%d'), strftime(ts, '%Y'), lower(dayname(ts)), lower(monthname(ts))] AS tokens FROM events")
def q11(spark, d):
    f = lambda p: F.date_format("ts", p)
    return table(spark, d, "events").select("event_id", F.array(f("yyyy-MM-dd"), f("yyyy/MM/dd"), f("yyyy"), F.lower(f("EEEE")), F.lower(f("MMMM"))).alias("tokens"))


@query("q21_strongest_term", "SELECT item_id, (list_sort(list_transform(t, lambda x, i: {'n': -length(x), 'i': i, 't': x})))[1].t AS term FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) >= 3) AS t FROM benchmark)")
def q21(spark, d):
    long_ones = F.filter(T.tokens(F.col("text")), lambda t: F.length(t) >= 3)
    keyed = F.transform(long_ones, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return table(spark, d, "benchmark").select("item_id", F.array_min(keyed)["t"].alias("term"))


@query("f1_tokenise", "SELECT term, count(*) AS n FROM (SELECT unnest(" + TOK.format("text") + ") AS term FROM documents) GROUP BY term")
def f1(spark, d):
    return table(spark, d, "documents").select(F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query("f2_any_term", C + f" SELECT chunk_id FROM corpus WHERE list_has_any({ALLTOK}, ['mit', 'apache'])")
def f2(spark, d):
    return search.match(corpus(spark, d), any_of=["mit", "apache"]).select("chunk_id")


@query("f3_and_not", C + f" SELECT chunk_id FROM corpus WHERE list_has_all({ALLTOK}, ['licensed', 'under']) AND NOT list_has_any({ALLTOK}, ['apache'])")
def f3(spark, d):
    return search.match(corpus(spark, d), must=["licensed", "under"], must_not=["apache"]).select("chunk_id")


@query("f4_phrase", C + " SELECT chunk_id FROM corpus WHERE strpos(' ' || array_to_string(" + TOK.format("content") + ", ' ') || ' ', ' under the mit license ') > 0")
def f4(spark, d):
    return search.phrase(corpus(spark, d), ["under", "the", "mit", "license"]).select("chunk_id")


@query("f5_prefix", C + f" SELECT chunk_id FROM corpus WHERE len(list_filter({ALLTOK}, lambda t: starts_with(t, 'licen'))) > 0")
def f5(spark, d):
    return search.prefix(corpus(spark, d), "licen").select("chunk_id")


def bm25_sql(terms: list[str], where: str = "true") -> str:
    lists = [f"SELECT chunk_id, unnest({TOK.format(f)}) AS term, {w} AS w FROM rows_" for f, w in search.FIELDS.items()]
    length = " + ".join(f"len({TOK.format(f)})" for f in search.FIELDS)
    return f"""{C}, rows_ AS (SELECT * FROM corpus WHERE {where}), st AS (SELECT count(*) AS n, avg({length}) AS avg_len FROM rows_), ln AS (SELECT chunk_id, {length} AS len FROM rows_),
tf AS (SELECT chunk_id, term, sum(w) AS f FROM ({' UNION ALL '.join(lists)}) WHERE term IN ({', '.join(repr(t) for t in terms) or 'NULL'}) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM tf JOIN df USING (term) JOIN ln USING (chunk_id), st GROUP BY chunk_id)"""


@query("f6_bm25", bm25_sql(TERMS) + " SELECT * FROM bm")
def f6(spark, d):
    return search.bm25(corpus(spark, d), TERMS)


@query("f7_search", bm25_sql(TERMS, "scope = 'wiki' AND superseded_by = ''") + " SELECT chunk_id, score FROM bm ORDER BY score DESC, chunk_id LIMIT 20")
def f7(spark, d):
    rows = corpus(spark, d).where(filters.compile({"scope": "wiki"}) & ~filters.superseded())
    return search.ranked(search.bm25(rows, TERMS), 20).drop("rank")


def occurrence_sql(fields: dict[str, float], terms: list[str]) -> str:
    times = "{w} * ((length(lower(coalesce({f}, ''))) - length(replace(lower(coalesce({f}, '')), '{t}', ''))) // {n})"
    return " + ".join(times.format(w=int(w), f=f, t=t, n=len(t)) for f, w in fields.items() for t in terms)


BODY_FIELDS = {"title": 3.0, "summary": 2.0, "tag_text": 2.0, "content": 1.0}


@query("f12_score_document", C + f" SELECT path, CAST({occurrence_sql(BODY_FIELDS, TERMS)} AS BIGINT) AS score FROM corpus WHERE scope = 'raw_document' AND {occurrence_sql(BODY_FIELDS, TERMS)} > 0")
def f12(spark, d):
    return corpus(spark, d).where("scope = 'raw_document'").select("path", search.occurrence_score(BODY_FIELDS, TERMS).alias("score")).where("score > 0")


@query("f13_in_memory", C + f" SELECT path, CAST({occurrence_sql(BODY_FIELDS, TERMS)} AS BIGINT) AS score, left(content, 140) AS snippet FROM corpus WHERE scope = 'raw_document' AND {occurrence_sql(BODY_FIELDS, TERMS)} > 0 ORDER BY score DESC, path LIMIT 10")
def f13(spark, d):
    rows = corpus(spark, d).where("scope = 'raw_document'").select("path", search.occurrence_score(BODY_FIELDS, TERMS).alias("score"), F.substring("content", 1, 140).alias("snippet"))
    return rows.where("score > 0").orderBy(F.desc("score"), "path").limit(10)


ARTICLE_FIELDS = {"title": 8.0, "summary": 4.0, "content": 1.0}


@query("f14_score_article", C + " SELECT chunk_id, " + " + ".join(f"{int(w)} * CAST(list_contains({TOK.format(f)}, '{t}') AS INT)" for f, w in ARTICLE_FIELDS.items() for t in TERMS) + " AS score FROM corpus")
def f14(spark, d):
    return corpus(spark, d).select("chunk_id", search.presence_score(ARTICLE_FIELDS, TERMS).alias("score"))


@query("f15_fallback", C + ", q AS (SELECT embedding FROM embeddings WHERE vec_id = 7) SELECT chunk_id, round(10 * ((length(lower(content)) - length(replace(lower(content), 'the license', ''))) / 11) + greatest(0, coalesce(round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9), 0)), 9) AS score FROM corpus LEFT JOIN embeddings e ON vec_id = chunk_id, q WHERE content IS NOT NULL")
def f15(spark, d):
    v = vectors(spark, d)
    q = F.array(*[F.lit(float(x)) for x in search.vector_of(v, 7)])
    near = v.select(F.col("id").alias("chunk_id"), F.round(search.cosine(F.col("embedding"), q), 9).alias("similarity"))
    rows = corpus(spark, d).where("content is not null").join(near, "chunk_id", "left")
    return rows.select("chunk_id", search.fallback_score(F.col("content"), "The license", F.coalesce("similarity", F.lit(0.0))).alias("score"))


@query("f1_stemmed")
def f1_stemmed(spark, d):
    """BM25 over Porter stems: tokens whose stem is a query term's stem count for it. Tested against a plain count."""
    rows = corpus(spark, d)
    terms = ["licensing", "copyrights", "licensed"]
    stems = sorted({search.porter_stem(t) for t in terms})
    return search.bm25_many(rows, {0: stems}, variants=search.stem_variants(rows, terms)).drop("query_no")


@query("f9_snippet", C + """, w AS (SELECT chunk_id, regexp_split_to_array(trim(coalesce(content, '')), '\\s+') AS w FROM corpus),
h AS (SELECT chunk_id, w, greatest(1, coalesce(list_position(list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', '', 'g') IN ('licensed', 'mit')), true), 0) - 16) AS s FROM w)
SELECT chunk_id, CASE WHEN s > 1 THEN '… ' ELSE '' END || array_to_string(list_transform(w[s : s + 63], lambda x: regexp_replace(regexp_replace(' ' || x || ' ', '(?i)([^\\p{L}\\p{N}])(licensed|mit)([^\\p{L}\\p{N}])', '\\1<mark>\\2</mark>\\3', 'g'), '^ | $', '', 'g')), ' ') || CASE WHEN len(w) >= s + 64 THEN ' …' ELSE '' END AS snippet FROM h""")
def f9(spark, d):
    return corpus(spark, d).select("chunk_id", search.snippet(F.col("content"), ["licensed", "mit"]).alias("snippet"))


@query("v8_hash_embedding")
def v8(spark, d):
    """Feature-hashed vectors of every document. No SQL: tested against a plain version."""
    return table(spark, d, "documents").select("doc_id", search.hash_embed(T.tokens(F.col("text")), 256).alias("embedding"))


COS = "round(list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 9)"


@query("v2_knn", f"SELECT e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY similarity DESC, id LIMIT 20")
def v2(spark, d):
    v = vectors(spark, d)
    return search.knn(v, search.vector_of(v, 7), 20)


@query("v3_knn_allowed", f"SELECT e.vec_id AS id, {COS.format('e.embedding', 'q.embedding')} AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label = 1 ORDER BY similarity DESC, id LIMIT 20")
def v3(spark, d):
    v = vectors(spark, d)
    return search.knn(v, search.vector_of(v, 7), 20, v.where("label = 1"))


@query("v4_knn_l2", "SELECT e.vec_id AS id, round(1 - power(list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 2) / 2, 7) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY similarity DESC, id LIMIT 20")
def v4(spark, d):
    v = vectors(spark, d)
    q = F.array(*[F.lit(x) for x in search.vector_of(v, 7)])
    square = F.aggregate(F.zip_with("embedding", q, lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return v.select("id", F.round(1 - square / 2, 7).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(20)


GRAMS = "list_distinct(flatten(list_transform(" + TOK + ", lambda w: list_transform(range(1, length(w) + 1), lambda i: substr('$' || w || '$', i, 3)))))"


@query("v9_trigram_jaccard", f"""SELECT item_id, round(CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, 9) AS similarity
FROM (SELECT item_id, {GRAMS.format('text')} AS a, {GRAMS.format("'Then the other license'")} AS b FROM benchmark)""")
def v9(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.round(T.jaccard(T.trigrams(F.col("text")), T.trigrams(F.lit("Then the other license"))), 9).alias("similarity"))


@query("v10_fuzzy", C + f""", g AS (SELECT chunk_id, {GRAMS.format('title')} AS a, {GRAMS.format("'The that'")} AS b FROM corpus),
s AS (SELECT chunk_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS similarity FROM g WHERE list_has_any(a, b))
SELECT * FROM s WHERE similarity >= 0.2 ORDER BY similarity DESC, chunk_id LIMIT 10""")
def v10(spark, d):
    return search.fuzzy(corpus(spark, d), "title", "The that", least=0.2)


@query("v11_trigram_rung", C + f""", g AS (SELECT chunk_id, {GRAMS.format('title')} AS a, {GRAMS.format("'then'")} AS b, {GRAMS.format("'nation'")} AS c FROM corpus),
s AS (SELECT chunk_id, round(greatest(CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END, CASE WHEN len(a) = 0 THEN 0 ELSE len(list_intersect(a, c)) / len(list_distinct(list_concat(a, c))) END), 9) AS similarity FROM g)
SELECT * FROM s WHERE similarity >= 0.05 ORDER BY similarity DESC, chunk_id LIMIT 10""")
def v11(spark, d):
    return search.rung(corpus(spark, d), "title", ["then", "nation"], least=0.05)


@query("v12_word_jaccard", f"SELECT item_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS similarity FROM (SELECT item_id, list_distinct({TOK.format('text')}) AS a, ['the', 'that', 'of', 'and'] AS b FROM benchmark)")
def v12(spark, d):
    words = F.array(*[F.lit(x) for x in ("the", "that", "of", "and")])
    return table(spark, d, "benchmark").select("item_id", F.round(T.jaccard(F.array_distinct(T.tokens(F.col("text"))), words, 1.0), 9).alias("similarity"))


FILTER = {"path_prefix": "notes/", "tags": ["en"], "session_ids": ["s1", "s2", "s4", "s5", "s8"], "scope": "notes", "date_from": "2024-02-01", "date_to": "2024-11-30"}


@query("p_filters", C + """ SELECT chunk_id FROM corpus WHERE starts_with(path, 'notes/') AND list_has_all(tags, ['en']) AND session_id IN ('s1', 's2', 's4', 's5', 's8')
AND scope IN ('global_notes', 'project_notes') AND modified >= DATE '2024-02-01' AND modified <= DATE '2024-11-30'""")
def p_filters(spark, d):
    return corpus(spark, d).where(filters.compile(FILTER)).select("chunk_id")


@query("p1_paths", C + " SELECT chunk_id FROM corpus WHERE starts_with(path, 'wiki/') AND path IN ('wiki/src2/2.md', 'wiki/src6/6.md', 'raw/documents/3.md')")
def p1(spark, d):
    return corpus(spark, d).where(filters.compile({"path_prefix": "wiki/", "paths": ["wiki/src2/2.md", "wiki/src6/6.md", "raw/documents/3.md"]})).select("chunk_id")


@query("p3_project", C + " SELECT chunk_id FROM corpus WHERE scope = 'global_notes' OR project = 'src5'")
def p3(spark, d):
    return corpus(spark, d).where(filters.compile({"project": "src5"})).select("chunk_id")


@query("p4_project_at_index", C + " SELECT chunk_id FROM corpus WHERE project = 'src5'")
def p4(spark, d):
    return corpus(spark, d).where(filters.project_at_index("src5", "wiki")).select("chunk_id")


@query("p8_superseded", C + " SELECT chunk_id FROM corpus WHERE NOT (superseded_by <> '' AND scope IN ('global_notes', 'project_notes'))")
def p8(spark, d):
    return corpus(spark, d).where(~(filters.superseded() & F.col("scope").isin("global_notes", "project_notes"))).select("chunk_id")


@query("p10_metadata_operators", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS INT) >= 20 AND CAST(json_extract(props, '$.k') AS INT) < 60 AND CAST(json_extract(props, '$.k') AS INT) NOT IN (30, 31)")
def p10(spark, d):
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").where(filters.field(k, "gte", 20) & filters.field(k, "lt", 60) & filters.field(k, "nin", [30, 31])).select("event_id")


HYBRID_SQL = bm25_sql(TERMS) + f""", w AS (SELECT chunk_id, row_number() OVER (ORDER BY score DESC, chunk_id) AS bm25_rank FROM bm QUALIFY bm25_rank <= 60),
vs AS (SELECT e.vec_id AS chunk_id, {COS.format('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q),
v AS (SELECT chunk_id, row_number() OVER (ORDER BY s DESC, chunk_id) AS vector_rank FROM vs QUALIFY vector_rank <= 60)
"""


@query("j2_hybrid_search", HYBRID_SQL + """SELECT coalesce(w.chunk_id, v.chunk_id) AS chunk_id, bm25_rank, vector_rank, round(coalesce(1.0 / (60 + bm25_rank), 0) + coalesce(1.0 / (60 + vector_rank), 0), 9) AS score
FROM w FULL JOIN v ON w.chunk_id = v.chunk_id ORDER BY score DESC, chunk_id LIMIT 10""")
def j2(spark, d):
    v = vectors(spark, d)
    return search.hybrid(corpus(spark, d), TERMS, v, search.vector_of(v, 7))


#: Three queries: the first is the primary one.
QUERIES = {0: TERMS, 1: ["the", "that"], 2: ["mit", "license"], 3: ["on", "in", "of", "and", "with"]}


def fanout(spark, d):
    return search.fanout(corpus(spark, d), QUERIES)


FAN_SQL = bm25_sql([]).split("tf AS (")[0] + """q AS (SELECT * FROM (VALUES {values}) AS q(list_no, term)),
tf AS (SELECT chunk_id, term, sum(w) AS f FROM ({lists}) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT list_no, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM tf JOIN df USING (term) JOIN ln USING (chunk_id) JOIN q USING (term), st GROUP BY list_no, chunk_id),
l AS (SELECT *, row_number() OVER (PARTITION BY list_no ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= 10)""".format(
    values=", ".join(f"({n}, '{t}')" for n, q in QUERIES.items() for t in q),
    lists=" UNION ALL ".join(f"SELECT chunk_id, unnest({TOK.format(f)}) AS term, {w} AS w FROM rows_" for f, w in search.FIELDS.items()),
)


def fanout_sql() -> str:
    return FAN_SQL


@query("j5_admitted_lists", FAN_SQL + """, o AS (SELECT b.list_no, count(a.chunk_id) AS overlap FROM l b LEFT JOIN (SELECT chunk_id FROM l WHERE list_no = 0) a USING (chunk_id) GROUP BY b.list_no),
ok AS (SELECT list_no FROM o WHERE list_no IN (0, 1, 2) OR overlap >= 2 OR NOT EXISTS (SELECT 1 FROM l WHERE list_no = 0))
SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l WHERE list_no IN (SELECT list_no FROM ok) GROUP BY chunk_id""")
def j5(spark, d):
    return search.rrf(search.admitted(fanout(spark, d), QUERIES))


@query("j1_rrf_lists", fanout_sql() + " SELECT chunk_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY chunk_id")
def j1(spark, d):
    return search.rrf(fanout(spark, d))


@query("j6_fanout_overlap", fanout_sql() + " SELECT b.list_no, least(2, count(*)) AS overlap FROM l a JOIN l b ON a.chunk_id = b.chunk_id WHERE a.list_no = 0 AND b.list_no > 0 GROUP BY b.list_no")
def j6(spark, d):
    lists = fanout(spark, d)
    first = lists.where("list_no = 0").select("chunk_id")
    return lists.where("list_no > 0").join(first, "chunk_id").groupBy("list_no").agg(F.least(F.lit(2), F.count("*")).cast("long").alias("overlap"))


@query("j7_merge_lists", fanout_sql() + " SELECT chunk_id, row_number() OVER (ORDER BY min(list_no * 1000 + rank), chunk_id) AS rank FROM l WHERE list_no < 2 GROUP BY chunk_id")
def j7(spark, d):
    merged = fanout(spark, d).where("list_no < 2").groupBy("chunk_id").agg(F.min(F.col("list_no") * 1000 + F.col("rank")).alias("at"))
    return merged.withColumn("rank", F.row_number().over(Window.orderBy("at", "chunk_id"))).drop("at")  # a few dozen rows


@query("j9_unanimity", HYBRID_SQL + "SELECT count(*) AS agree, count(*) >= 2 AS skip FROM w JOIN v ON w.chunk_id = v.chunk_id AND bm25_rank = vector_rank WHERE bm25_rank <= 3")
def j9(spark, d):
    v = vectors(spark, d)
    both = search.hybrid(corpus(spark, d), TERMS, v, search.vector_of(v, 7), k=120)
    return both.where("bm25_rank = vector_rank and bm25_rank <= 3").agg(F.count("*").alias("agree")).withColumn("skip", F.col("agree") >= 2)


@query("j10_sort_recency", bm25_sql(TERMS) + " SELECT chunk_id, row_number() OVER (ORDER BY modified DESC NULLS LAST, score DESC, chunk_id) AS pos FROM (SELECT * FROM bm ORDER BY score DESC, chunk_id LIMIT 50) JOIN corpus USING (chunk_id)")
def j10(spark, d):
    rows = corpus(spark, d)
    top = search.ranked(search.bm25(rows, TERMS), 50).join(rows.select("chunk_id", "modified"), "chunk_id")
    return top.select("chunk_id", F.row_number().over(Window.orderBy(F.desc_nulls_last("modified"), "rank")).alias("pos"))  # fifty rows


@query("j15_best_chunk", C + " SELECT project, chunk_id FROM corpus QUALIFY row_number() OVER (PARTITION BY project ORDER BY length(content) DESC, modified DESC NULLS LAST, chunk_id) = 1")
def j15(spark, d):
    best = F.max_by("chunk_id", F.struct(F.length("content"), F.coalesce("modified", F.lit("0001-01-01").cast("date")), -F.col("chunk_id")))
    return corpus(spark, d).groupBy("project").agg(best.alias("chunk_id"))  # partial aggregation instead of a window on a skewed key


@query("j16_distinct_trimmed", "SELECT conv_id, string_agg(t, '|' ORDER BY first) AS roles FROM (SELECT conv_id, trim(role) AS t, min(turn) AS first FROM conversations GROUP BY ALL) GROUP BY conv_id")
def j16(spark, d):
    turns = messages(spark, d).groupBy(F.col("session_id").alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct("turn", F.trim("role").alias("t")))).alias("x"))
    return turns.select("conv_id", F.array_join(F.array_distinct(F.transform("x", lambda s: s["t"])), "|").alias("roles"))
