"""Queries over conversations and stored notes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import conversations
from ..session import table
from ..sources.corpus import corpus
from .registry import query
from .search_queries import C, TOK


def _count(patterns: list[str]) -> str:
    return " + ".join("CAST(regexp_matches(text, '{}') AS INT)".format(p.replace("'", "''")) for p in patterns)


@query("m28_feedback", f"""WITH x AS (SELECT conv_id, turn, {_count(conversations.POSITIVE)} AS up, {_count(conversations.NEGATIVE)} AS down FROM conversations WHERE role = 'user' AND text IS NOT NULL)
SELECT conv_id, turn, CASE WHEN up > down THEN 'reinforced' WHEN down > up THEN 'corrected' ELSE 'neutral' END AS reaction,
  CASE WHEN up <> down THEN round(least(1.0::DOUBLE, 0.3::DOUBLE * greatest(up, down)), 9) WHEN up > 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM x""")
def m28(spark, d):
    kind, sure = conversations.reaction(F.col("text"))
    return table(spark, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", kind.alias("reaction"), sure.alias("confidence"))


AGES_SQL = "x AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS cur, CAST(o_orderdate AS DATE) AS created, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 70 AS INT) AS observed FROM orders)"
NOW = "1997-06-30"


@query("m21_confidence", f"""WITH {AGES_SQL}, y AS (SELECT *, date_diff('day', observed, DATE '{NOW}') AS age, date_diff('day', created, observed) AS span FROM x)
SELECT id, CASE WHEN age >= 180 THEN 'low' WHEN age >= 90 THEN CASE WHEN cur = 'high' THEN 'medium' ELSE 'low' END WHEN span >= 45 THEN 'high'
  WHEN span >= 14 THEN CASE WHEN cur = 'high' THEN 'high' ELSE 'medium' END ELSE cur END AS confidence FROM y""")
def m21(spark, d):
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    cur = F.when(n % 3 == 0, "low").when(n % 3 == 1, "medium").otherwise("high")
    return table(spark, d, "orders").select(n.alias("id"), conversations.confidence(cur, day, F.date_add(day, (n % 70).cast("int")), F.lit(NOW).cast("date")).alias("confidence"))


@query("m22_stale", C + " SELECT scope, count(*) AS n FROM corpus WHERE modified < DATE '2024-12-31' - 90 GROUP BY scope")
def m22(spark, d):
    return corpus(spark, d).where(F.col("modified") < F.date_sub(F.lit("2024-12-31").cast("date"), 90)).groupBy("scope").agg(F.count("*").alias("n"))


@query("m23_similar_names", """WITH w AS (SELECT p_partkey AS id, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9]+'))) AS s FROM part WHERE p_partkey IS NOT NULL),
l AS (SELECT x.id, count(*) AS n FROM w x JOIN w y ON x.id <> y.id WHERE len(x.s) > 0 AND len(list_intersect(x.s, y.s)) >= 0.3 * len(list_distinct(list_concat(x.s, y.s))) - 1e-9 GROUP BY x.id)
SELECT id, CASE WHEN len(s) > 0 THEN min(id) OVER (PARTITION BY s) ELSE id END AS class_id, coalesce(n, 0) AS n_links FROM w LEFT JOIN l USING (id)""")
def m23(spark, d):
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", "p_name", "p_type")), F.lit("[a-z0-9]+"), F.lit(0))
    return conversations.similar_names(table(spark, d, "part"), "p_partkey", words)


@query("m25_index_lines", C + " SELECT project, '- ' || path AS line, row_number() OVER (PARTITION BY project ORDER BY path) AS pos FROM corpus WHERE scope = 'project_notes'")
def m25(spark, d):
    rows = corpus(spark, d).where("scope = 'project_notes'")
    return conversations.index_lines(rows, "project", "path")


@query("m9_sentences", "SELECT conv_id, turn, len(list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\b(Dr|Mr|Mrs|Ms|Prof)\\.', '\\1' || chr(1), 'g'), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '')) AS n FROM conversations WHERE text IS NOT NULL")
def m9(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(conversations.sentences(F.col("text"))).alias("n"))


LINKS_SQL = """l AS (SELECT doc_id, source AS project, unnest(CASE WHEN doc_id % 3 = 0 THEN ['global:Page ' || (doc_id % 7) || '|shown', 'Page ' || (doc_id % 5)] ELSE ['Page ' || (doc_id % 11)] END) AS raw FROM documents)"""


@query("m27_wikilinks", f"""WITH {LINKS_SQL}, t AS (SELECT DISTINCT doc_id, project, 'page-' || regexp_extract(raw, '(\\d+)', 1) AS target, starts_with(raw, 'global:') AS is_global FROM l),
own AS (SELECT 'src' || s AS project, 'page-' || n AS target, 'notes/project/src' || s || '/page-' || n AS path FROM range(20) a(s), range(6) b(n)),
sh AS (SELECT 'page-' || n AS target, 'notes/global/page-' || n AS path FROM range(3, 9) b(n))
SELECT doc_id, t.project, t.target, is_global, CASE WHEN is_global THEN sh.path ELSE coalesce(own.path, sh.path) END AS path FROM t LEFT JOIN own ON t.project = own.project AND t.target = own.target LEFT JOIN sh ON t.target = sh.target""")
def m27(spark, d):
    n = F.col("doc_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("[[global:Page "), n % 7, F.lit("|shown]] and [[Page "), n % 5, F.lit("]]"))).otherwise(F.concat(F.lit("[[Page "), n % 11, F.lit("]]")))
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("project"), text.alias("text"))
    links = conversations.wikilinks(docs, "doc_id", "text").join(docs.select("doc_id", "project"), "doc_id")
    slug = F.concat(F.lit("page-"), F.col("id") % 10)
    own = spark.range(200).where("id % 10 < 6").select(F.concat(F.lit("src"), F.floor(F.col("id") / 10)).alias("project"), slug.alias("slug"))
    own = own.select("project", "slug", F.concat_ws("/", F.lit("notes/project"), "project", "slug").alias("path"))
    shared = spark.range(3, 9).select(F.lit(None).cast("string").alias("project"), slug.alias("slug"), F.concat(F.lit("notes/global/"), slug).alias("path"))
    return conversations.resolve(links, own.union(shared)).select("doc_id", "project", "target", "is_global", "path")


@query("m29_compact", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= ceil(count(*) OVER (PARTITION BY conv_id) / 2)")
def m29(spark, d):
    return conversations.newest_half(table(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn")


@query("m31_stem", f"""WITH w AS (SELECT DISTINCT unnest({TOK.format('text')}) AS t FROM benchmark)
SELECT t AS term, CASE WHEN length(t) > 5 AND ends_with(t, 'ies') THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 5 AND ends_with(t, 'es') THEN left(t, length(t) - 2)
  WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END AS stem FROM w""")
def m31(spark, d):
    return table(spark, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("term")).distinct().select("term", conversations.stem(F.col("term")).alias("stem"))


@query("m20_preceding_user_turn", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_turn FROM conversations")
def m20(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("user_turn"))


@query("w6_buffer", """WITH x AS (SELECT conv_id, list({'o': turn, 'b': strlen(coalesce(text, ''))} ORDER BY turn) AS x FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, list_reduce(list_transform(x, lambda y: [y]), lambda a, b: CASE WHEN list_sum(list_transform(list_concat(a, b), lambda z: z.b)) // 4 >= 150 AND len(list_concat(a, b)) > 1
  THEN list_concat(a, b)[-greatest(len(list_concat(a, b)) * 50 // 100, 1):] ELSE list_concat(a, b) END) AS kept FROM x)
SELECT conv_id, e.o AS turn FROM (SELECT conv_id, unnest(kept) AS e FROM r)""")
def w6_buffer(spark, d):
    """What rolling buffers of 150 tokens hold after each session."""
    return conversations.buffered(table(spark, d, "conversations"), "conv_id", "turn", "text", 150)


@query("m24_reinforced", f"""WITH {AGES_SQL}, n AS (SELECT x.*, coalesce(c, 0) AS c FROM x LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = id WHERE id % 5 > 0),
o AS (SELECT *, CASE WHEN c >= 4 THEN 'high' WHEN c >= 2 THEN 'medium' ELSE 'low' END AS oc, date_diff('day', observed, DATE '{NOW}') AS age, date_diff('day', created, observed) AS span FROM n),
f AS (SELECT id, cur, CASE WHEN age >= 180 THEN 'low' WHEN age >= 90 THEN CASE WHEN oc = 'high' THEN 'medium' ELSE 'low' END WHEN span >= 45 THEN 'high' WHEN span >= 14 THEN CASE WHEN oc = 'high' THEN 'high' ELSE 'medium' END ELSE oc END AS confidence FROM o)
SELECT id, cur AS was, confidence, confidence <> cur AS updated FROM f""")
def m24(spark, d):
    """Orders as heuristic notes with a section for each line."""
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("c"))
    rows = table(spark, d, "orders").join(lines, n == F.col("l_orderkey"), "left")
    body = F.concat(F.lit("A rule\n"), F.array_join(F.array_repeat(F.lit("## seen\nagain"), F.coalesce("c", F.lit(0))), "\n"))
    cur = F.when(n % 3 == 0, "low").when(n % 3 == 1, "medium").otherwise("high")
    tags = F.when(n % 5 > 0, F.array(F.lit("x"), F.lit("Heuristic"))).otherwise(F.array(F.lit("x")))
    notes = rows.select(n.alias("id"), tags.alias("tags"), body.alias("body"), cur.alias("confidence"), day.alias("created"), F.date_add(day, (n % 70).cast("int")).alias("observed"))
    return conversations.reinforced(notes, F.lit(NOW).cast("date"))


_WORDS = ["red", "widget", "economy"]
_CALLS = "['open ' || lower(p_type), 'read brand']"


def _points(what: str, each: tuple) -> str:
    held = [f"contains(p_name, '{what}')", f"(contains(lower(p_brand), '{what}') OR contains('small tools', '{what}'))", f"contains('made for ' || lower(p_type) || ' use', '{what}')", f"len(list_filter({_CALLS}, lambda c: contains(c, '{what}'))) > 0", f"(lower(p_type) = '{what}' OR 'ok' = '{what}')"]
    return " + ".join(f"CASE WHEN {h} THEN {p} ELSE 0 END" for h, p in zip(held, each))


@query("m19_procedural", f"SELECT p_partkey, CAST({_points('red widget economy', conversations.PHRASE_POINTS)} + {' + '.join(_points(w, conversations.WORD_POINTS) for w in _WORDS)} AS INT) AS score FROM part")
def m19(spark, d):
    kind = F.lower("p_type")
    calls = F.array(F.concat(F.lit("open "), kind), F.lit("read brand"))
    score = conversations.procedural_score("Red  widget economy", F.col("p_name"), F.array("p_brand", F.lit("small tools")), F.concat(F.lit("Made for "), "p_type", F.lit(" use")), calls, kind, F.lit("ok"))
    return table(spark, d, "part").select("p_partkey", score.cast("int").alias("score"))
