"""Queries of change events; the streams themselves are tested in tests/test_streaming.py."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ingest, knowledge
from ..session import shared_dir, table
from ..sources.corpus import CORPUS_SQL, corpus
from ..streaming import changes
from .registry import query


def change_events(spark, d):
    kind = F.when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "signup", "created").otherwise("updated")
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("wiki/"), F.col("user_id"), F.lit(".md")).alias("path"), kind.alias("kind"), F.sha2("props", 256).alias("checksum"))


EVENTS_SQL = "e AS (SELECT event_id AS seq, 'wiki/' || user_id || '.md' AS path, CASE event_type WHEN 'error' THEN 'deleted' WHEN 'signup' THEN 'created' ELSE 'updated' END AS kind, sha256(props) AS checksum FROM events)"


@query("w2_latest_event", f"WITH {EVENTS_SQL} SELECT path, seq, kind, checksum FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1")
def w2(spark, d):
    return changes.latest(change_events(spark, d))


@query("w1_index_after_events", f"WITH {EVENTS_SQL} SELECT path, seq, checksum FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE kind <> 'deleted'")
def w1(spark, d):
    events = change_events(spark, d)
    half = changes.apply(changes.empty(spark), events.where("seq % 2 = 0"))
    return changes.apply(half, events.where("seq % 2 = 1")).where("not gone").select("path", "seq", "checksum")


@query("w5_cursor", "SELECT conv_id, turn FROM conversations QUALIFY turn > (max(turn) OVER (PARTITION BY conv_id)) // 2 AND row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 80")
def w5(spark, d):
    """Messages after a session's cursor (here half of its turns), the last eighty."""
    rows = table(spark, d, "conversations").select("conv_id", "turn")
    cursors = rows.groupBy("conv_id").agg(F.floor(F.max("turn") / 2).alias("cursor"))
    fresh = rows.join(cursors, "conv_id").where("turn > cursor")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).where("_n <= 80").select("conv_id", "turn")


@query("s8_renames", f"""WITH {EVENTS_SQL}, r AS (SELECT e.seq, path, CASE WHEN ev.event_type = 'click' THEN 'created' ELSE kind END AS kind, checksum FROM e JOIN events ev ON ev.event_id = e.seq
  UNION ALL SELECT event_id, 'wiki/' || (user_id + 1) || '.md', 'deleted', NULL FROM events WHERE event_type = 'click')
SELECT path, seq, checksum FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY path ORDER BY seq DESC) = 1) WHERE kind <> 'deleted'""")
def s8(spark, d):
    """Clicks rename the next user's page to the user's own."""
    raw = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("wiki/"), F.col("user_id") + 1, F.lit(".md")).alias("old_path"), (F.col("event_type") == "click").alias("moves"))
    events = change_events(spark, d).join(raw, "seq").withColumn("kind", F.when(F.col("moves"), "renamed").otherwise(F.col("kind")))
    return changes.apply(changes.empty(spark), changes.expanded(events)).where("not gone").select("path", "seq", "checksum")


def _files(spark, d):
    return corpus(spark, d).select("path", "title", F.col("content").alias("body"))


def _stats(spark, found: list[dict]):
    names = ["step", "rows_before", "files_scanned", "files_indexed", "files_removed", "rows_after"]
    return spark.createDataFrame([(i, *[x[n] for n in names[1:]]) for i, x in enumerate(found)], "step int, " + ", ".join(f"{n} long" for n in names[1:]))


FILES_SQL = f"{CORPUS_SQL}, f AS (SELECT path, title, coalesce(content, '') AS body FROM corpus), half AS (SELECT path, title, body FROM f WHERE length(body) % 2 = 0), n AS (SELECT (SELECT count(*) FROM f) AS a, (SELECT count(*) FROM half) AS h, (SELECT count(*) FROM half WHERE starts_with(path, 'wiki/')) AS w)"


@query("s5_rebuild", f"WITH {FILES_SQL} SELECT 0 AS step, 0 AS rows_before, h AS files_scanned, h AS files_indexed, 0 AS files_removed, h AS rows_after FROM n UNION ALL SELECT 1, h, a, a - h + w, 0, a FROM n UNION ALL SELECT 2, a, h, w, a - h, h FROM n UNION ALL SELECT 3, h, a, a, h, a FROM n")
def s5(spark, d):
    """Statistics of an index over four steps: built from the files of even length, brought up to date with all files (wiki pages with a new title), back with the old ones, rebuilt from all."""
    files = _files(spark, d)
    half = files.where(F.length(F.coalesce("body", F.lit(""))) % 2 == 0)
    renamed = files.withColumn("title", F.when(F.col("path").startswith("wiki/"), F.concat(F.lit("new "), F.coalesce("title", F.lit("")))).otherwise(F.col("title")))
    index = ingest.index_table(spark, shared_dir(spark))
    return _stats(spark, [ingest.rebuild(index, half), ingest.update(index, renamed), ingest.update(index, half), ingest.rebuild(index, files)])


@query("s5_index_rows", f"WITH {FILES_SQL} SELECT path, sha256(concat_ws(chr(10), coalesce(title, ''), body)) AS checksum, CAST(length(body) AS INT) AS n FROM f")
def s5_rows(spark, d):
    """The rows of an index after an update that removes, changes and adds files."""
    files = _files(spark, d)
    index = ingest.index_table(spark, shared_dir(spark))
    ingest.rebuild(index, files.where(F.length(F.coalesce("body", F.lit(""))) % 2 == 0).withColumn("title", F.lit("old")))
    ingest.update(index, files)
    return index.read().select("path", "checksum", F.length("body").alias("n"))


INGESTED = """e AS (SELECT sha256(coalesce(text, '')) AS hash, min((coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) AS r, bool_or(lang = 'en') AS en, bool_or(lang = 'fr') AS fr FROM documents GROUP BY 1)"""


@query("s21_ingest", f"WITH {INGESTED} SELECT r[1] || ':' || left(hash, 16) AS document_id, 'raw/documents/' || hash || '.md' AS path, CAST(CASE WHEN length(r[3]) = 0 THEN 0 ELSE greatest(0, ceil((length(r[3]) - 2048) / 1792)) + 1 END AS INT) AS chunk_count, coalesce(en AND length(r[3]) > 0, false) AS reused FROM e")
def s21(spark, d):
    """Documents in a run after others: English ones were ingested, French ones stored or chunked only."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("title"), "text", F.col("source").alias("owner"), "lang")
    chunked = lambda rows: knowledge.windows(rows, "hash", "text").withColumnRenamed("chunk", "content")
    folder = shared_dir(spark)
    ingest.ingest(spark, docs.where("lang = 'en'"), folder, chunked)
    ingest.ingest(spark, docs.where("lang = 'fr'"), folder, chunked, upto="stored")
    ingest.ingest(spark, docs.where("lang = 'fr' and length(text) % 2 = 0"), folder, chunked, upto="chunked")
    return ingest.ingest(spark, docs, folder, chunked)
