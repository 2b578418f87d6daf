"""Queries of document text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge
from ..session import table
from ..sources.corpus import corpus
from .registry import query
from .search_queries import C, GRAMS


@query("t1_strip_html", """SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS text FROM pages""")
def t1(spark, d):
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("t2_content_type", "SELECT page_id, CASE WHEN regexp_matches(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '^(md|markdown)$') THEN 'text/markdown' WHEN regexp_matches(lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)), '^html?$') THEN 'text/html' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'pdf' OR starts_with(html, '%PDF') THEN 'application/pdf' WHEN lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) = 'json' THEN 'application/json' WHEN regexp_matches(lower(left(html, 400)), '<(!doctype html|html)\\b') THEN 'text/html' ELSE 'text/plain' END AS kind FROM pages")
def t2(spark, d):
    return table(spark, d, "pages").select("page_id", knowledge.content_type(F.col("url"), F.col("html")).alias("kind"))


@query("t5_title", C + """ SELECT chunk_id, CASE WHEN h <> '' THEN h WHEN l <> '' THEN l ELSE regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[A-Za-z0-9]+$', '') END AS t
FROM (SELECT chunk_id, path, trim(regexp_extract(coalesce(content, ''), '(?m)^# +(.+)$', 1)) AS h, trim(left(trim(regexp_extract(coalesce(content, ''), '(?m)^[ \\t]*(\\S.*)$', 1)), 120)) AS l FROM corpus)""")
def t5(spark, d):
    return corpus(spark, d).select("chunk_id", knowledge.title(F.coalesce("content", F.lit("")), F.col("path")).alias("t"))


@query("t6_slug", "SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS slug, left(sha256(p_name), 12) AS hash FROM part")
def t6(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"), T.hash_slug(F.col("p_name")).alias("hash"))


@query("t13_windows", "SELECT doc_id, i AS ordinal, substr(text, i * 1792 + 1, 2048) AS chunk FROM (SELECT doc_id, text, unnest(range(CAST(greatest(0, ceil((length(text) - 2048) / 1792)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)")
def t13(spark, d):
    return knowledge.windows(table(spark, d, "documents"), "doc_id", "text")


@query("t14_markdown", "SELECT doc_id, coalesce(regexp_matches(text, '(?m)^(#{1,6} |> |[-*+] |[0-9]+\\. )'), false) AS md FROM documents")
def t14(spark, d):
    return table(spark, d, "documents").select("doc_id", knowledge.looks_like_markdown(F.col("text")).alias("md"))


@query("t15_token_estimate", "SELECT doc_id, (strlen(text) + 3) // 4 AS by_bytes, (length(text) + 3) // 4 AS by_chars FROM documents")
def t15(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.token_estimate(t).alias("by_bytes"), T.token_estimate(t, "chars").alias("by_chars"))


@query("t16_frontmatter", "SELECT p_partkey, p_name AS name, p_brand AS brand, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_partkey % 5 <> 0")
def t16(spark, d):
    n = F.col("p_partkey")
    fence = F.when(n % 5 != 0, "\n---\nbody").otherwise("\nbody")
    text = F.concat(F.lit('---\nname: "'), "p_name", F.lit('"\nbrand: '), "p_brand", F.lit("\nsize:"), "p_size", fence)
    m = F.col("m")
    return table(spark, d, "part").select("p_partkey", knowledge.frontmatter(text).alias("m")).where("m is not null").select("p_partkey", m["name"].alias("name"), m["brand"].alias("brand"), m["size"].alias("size"))


@query("t19_lint", C + """, r AS (SELECT path, CASE WHEN chunk_id % 29 = 0 THEN '' ELSE title END AS title, coalesce(content, '') || CASE WHEN chunk_id % 4 = 0 THEN ' [[notes/global/' || (chunk_id + 4) || '.md]]' ELSE '' END AS body, chunk_id FROM corpus)
SELECT path, 'missing_field' AS issue FROM r WHERE trim(title) = '' UNION ALL SELECT path, 'empty_body' FROM r WHERE NOT regexp_matches(body, '\\S')
UNION ALL SELECT path, 'stub' FROM r WHERE len(regexp_extract_all(body, '\\S+')) BETWEEN 1 AND 199 UNION ALL SELECT path, 'zero_links' FROM r WHERE strpos(body, '[[') = 0
UNION ALL SELECT path, 'broken_link' FROM r WHERE chunk_id % 4 = 0 AND 'notes/global/' || (chunk_id + 4) || '.md' NOT IN (SELECT path FROM r)
UNION ALL SELECT path, 'duplicate_title' FROM r WHERE lower(trim(title)) IN (SELECT lower(trim(title)) FROM r WHERE trim(title) <> '' GROUP BY 1 HAVING count(*) > 1)""")
def t19(spark, d):
    n = F.col("chunk_id")
    link = F.when(n % 4 == 0, F.concat(F.lit(" [[notes/global/"), n + 4, F.lit(".md]]"))).otherwise("")
    rows = corpus(spark, d).select("path", F.when(n % 29 == 0, "").otherwise(F.col("title")).alias("title"), F.concat(F.coalesce("content", F.lit("")), link).alias("body"))
    return knowledge.lint(rows)


@query("t20_title_pairs", f"""WITH e AS (SELECT title AS t, min(chunk_id) AS id FROM (SELECT doc_id AS chunk_id, split_part(text, '.', 1) AS title FROM documents WHERE text IS NOT NULL) GROUP BY 1), g AS (SELECT id, {GRAMS.format('t')} AS g FROM e)
SELECT * FROM (SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))), 9) AS similarity FROM g x JOIN g y ON x.id < y.id WHERE len(x.g) > 0 AND len(y.g) > 0
  AND len(x.g) >= 0.85 * len(y.g) AND len(y.g) >= 0.85 * len(x.g)) WHERE similarity >= 0.85""")
def t20(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.substring_index("text", ".", 1).alias("title"))
    return knowledge.title_pairs(rows, "doc_id", "title")


@query("t20_keep_first")
def t20_keep(spark, d):
    """Which document each one merges into. No SQL, as what is kept depends on what was kept before: tested by brute force."""
    rows = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.substring_index("text", ".", 1).alias("title"), F.substring(F.coalesce("text", F.lit("")), F.length(F.substring_index("text", ".", 1)) + 1, F.length("text")).alias("body"))
    return knowledge.keep_first(rows, "doc_id", "title", "body")


def _redacted(text: str, n: int) -> str:
    for _, pattern, replacement in T.REDACTIONS[:n]:
        text = f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"
    return text


@query("t21_redact", f"SELECT doc_id, {_redacted('text', 2)} AS clean, len(regexp_extract_all(text, '{T.REDACTIONS[0][1]}')) AS emails, len(regexp_extract_all({_redacted('text', 1)}, '{T.REDACTIONS[1][1]}')) AS phones FROM documents WHERE text IS NOT NULL")
def t21(spark, d):
    clean, counts = T.redact(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", clean.alias("clean"), counts["email"].alias("emails"), counts["phone"].alias("phones"))


@query("t23_isolate", "SELECT item_id, '<note>' || chr(10) || regexp_replace(text || '</NOTE>', '(?i)</note>', '&lt;/note&gt;', 'g') || chr(10) || '</note>' AS x FROM benchmark")
def t23(spark, d):
    return table(spark, d, "benchmark").select("item_id", knowledge.isolate(F.concat("text", F.lit("</NOTE>")), "note").alias("x"))


@query("t24_checksum", "SELECT doc_id, sha256(text) AS checksum FROM documents WHERE text IS NOT NULL")
def t24(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("checksum"))


@query("t17_note_fields", """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END AS description,
  CASE WHEN p_partkey % 7 = 0 THEN [] WHEN p_partkey % 2 = 0 THEN [lower(p_brand), 'size ' || p_size, 'x: y'] ELSE [p_brand, p_type] END AS tags,
  CASE WHEN p_partkey % 7 = 0 THEN concat_ws(chr(10), '---', 'name: "' || p_name || '"', 'body') ELSE 'body of' || chr(10) || p_name END AS body FROM part""")
def t17(spark, d):
    """Notes made of parts: tags as a list or behind their key, a list of another key, a repeated field, and every seventh without a closing line."""
    n = F.col("p_partkey")
    listed = F.concat(F.lit("tags:\n  - "), F.lower("p_brand"), F.lit("\n- size "), "p_size", F.lit("\n- x: y\nlinks:\n- not a tag\nname: \n"))
    behind = F.concat(F.lit("tags: "), "p_brand", F.lit(", ,"), "p_type", F.lit("\n"))
    whole = F.concat(F.lit('---\nname: wrong\nname: "'), "p_name", F.lit("\"\ndescription: '"), "p_type", F.lit("'\n"), F.when(n % 2 == 0, listed).otherwise(behind), F.lit("---\n\nbody of\n"), "p_name", F.lit("\n"))
    text = F.when(n % 7 == 0, F.concat(F.lit('---\nname: "'), "p_name", F.lit('"\nbody'))).otherwise(whole)
    return table(spark, d, "part").select("p_partkey", knowledge.note_fields(text, ["name", "description"]).alias("f")).select("p_partkey", "f.*")


@query("t19_sources", """WITH a AS (SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'drafts/' || (o_orderkey // 2) ELSE 'wiki/' || o_orderkey END || '.md' AS path, 'raw/' || o_custkey || '.md' AS source, CAST(o_orderdate AS DATE) AS modified FROM orders),
f AS (SELECT 'raw/' || o_custkey || '.md' AS source, max(CAST(o_orderdate AS DATE)) AS latest FROM orders WHERE o_custkey % 4 > 0 GROUP BY 1)
SELECT path, 'stale_source' AS issue, source AS about FROM a JOIN f USING (source) WHERE starts_with(path, 'wiki/') AND latest > modified
UNION ALL SELECT path, 'orphan_draft', regexp_extract(path, '^drafts/(.*)\\.md$', 1) FROM a WHERE starts_with(path, 'drafts/') AND 'wiki/' || regexp_extract(path, '^drafts/(.*)\\.md$', 1) || '.md' NOT IN (SELECT path FROM a)""")
def t19_sources(spark, d):
    """Orders as articles whose source is their customer's file, last changed with the customer's newest order."""
    n, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    orders = table(spark, d, "orders")
    source = F.concat(F.lit("raw/"), "o_custkey", F.lit(".md"))
    path = F.concat(F.when(n % 9 == 0, F.concat(F.lit("drafts/"), F.floor(n / 2))).otherwise(F.concat(F.lit("wiki/"), n)), F.lit(".md"))
    articles = orders.select(path.alias("path"), F.array(source, F.lit(" "), F.lit("raw/none.md")).alias("sources"), day.alias("modified"))
    files = orders.where("o_custkey % 4 > 0").groupBy(source.alias("path")).agg(F.max(day).alias("modified"))
    return knowledge.lint_sources(articles, files)
