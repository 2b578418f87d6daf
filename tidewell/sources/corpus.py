"""The domain tables over the parquet tables: indexed rows, vectors, messages and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import table

#: Scopes by path prefix, first match wins; other paths are not indexed.
SCOPES = [("notes/global/", "global_notes"), ("notes/project/", "project_notes"), ("wiki/", "wiki"), ("raw/documents/", "raw_document"), ("raw/.sources/", "sources"), ("raw/eval/", "raw_eval")]


def scope_of(path: Column) -> Column:
    """Scope of a markdown path; null for other files and for other folders."""
    out = F.lit(None).cast("string")
    for prefix, scope in reversed(SCOPES):
        out = F.when(path.startswith(prefix), scope).otherwise(out)
    return F.when(path.endswith(".md"), out)


def project_of(path: Column) -> Column:
    return F.coalesce(F.regexp_extract(path, r"^notes/project/([^/]+)/", 1), F.lit(""))


def corpus(spark, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """Documents as indexed rows: a path by doc_id, title, content, and the metadata that filters and ranks need. ``only`` (chunk_id, few rows) are made, if it is given."""
    d = table(spark, sf_dir, "documents")
    if only is not None:
        d = d.join(F.broadcast(only.select(F.col("chunk_id").alias("doc_id"))), "doc_id", "left_semi")
    n = F.col("doc_id")
    path = (
        F.when(n % 4 == 0, F.concat(F.lit("notes/global/"), n, F.lit(".md")))
        .when(n % 4 == 1, F.concat(F.lit("notes/project/"), F.col("source"), F.lit("/"), n, F.lit(".md")))
        .when(n % 4 == 2, F.concat(F.lit("wiki/"), F.col("source"), F.lit("/"), n, F.lit(".md")))
        .otherwise(F.concat(F.lit("raw/documents/"), n, F.lit(".md")))
    )
    return d.select(
        n.alias("chunk_id"),
        path.alias("path"),
        F.substring_index("text", ".", 1).alias("title"),
        F.split_part("text", F.lit("."), F.lit(2)).alias("summary"),
        F.concat_ws(" ", "lang", "source").alias("tag_text"),
        F.col("text").alias("content"),
        F.array("lang", "source").alias("tags"),
        F.concat(F.lit("s"), n % 50).alias("session_id"),
        F.when(n % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 365).cast("int"))).alias("modified"),
        F.when(n % 13 == 0, F.concat(n + 1, F.lit(".md"))).otherwise("").alias("superseded_by"),
        F.when(n % 2 == 0, "user").otherwise("assistant").alias("source_role"),
    ).withColumns({"scope": scope_of(F.col("path")), "project": project_of(F.col("path"))})


#: The same view in SQL, to stand behind WITH.
CORPUS_SQL = """corpus AS (
  SELECT doc_id AS chunk_id, path, split_part(text, '.', 1) AS title, split_part(text, '.', 2) AS summary, concat_ws(' ', lang, source) AS tag_text, text AS content, [lang, source] AS tags, 's' || (doc_id % 50) AS session_id,
    CASE WHEN doc_id % 11 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 365 AS INT) END AS modified,
    CASE WHEN doc_id % 13 = 0 THEN (doc_id + 1) || '.md' ELSE '' END AS superseded_by, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS source_role,
    CASE doc_id % 4 WHEN 0 THEN 'global_notes' WHEN 1 THEN 'project_notes' WHEN 2 THEN 'wiki' ELSE 'raw_document' END AS scope,
    CASE WHEN doc_id % 4 = 1 THEN source ELSE '' END AS project
  FROM (SELECT *, CASE doc_id % 4 WHEN 0 THEN 'notes/global/' || doc_id || '.md' WHEN 1 THEN 'notes/project/' || source || '/' || doc_id || '.md'
    WHEN 2 THEN 'wiki/' || source || '/' || doc_id || '.md' ELSE 'raw/documents/' || doc_id || '.md' END AS path FROM documents))"""


def vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit("m").alias("model"), F.size("embedding").alias("dim"), "embedding", "label")


def messages(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))
