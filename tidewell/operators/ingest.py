"""Index writes: full and partial rebuilds, and staged ingestion that takes up where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.stored import StoredTable

INDEX = "path string, checksum string, title string, body string"
STATE = "hash string, document_id string, path string, stage string, chunk_count int"
CHUNKS = "hash string, chunk_id string, ordinal int, content string"
#: The stages of a document, in order.
STAGES = ["stored", "chunked", "indexed"]


def index_table(spark: SparkSession, folder: str, buckets: int = 32) -> StoredTable:
    return StoredTable(spark, folder, INDEX, "path", buckets)


def rebuild(index: StoredTable, files: DataFrame) -> dict[str, int]:
    """All files (path, title, body) become the index; the statistics count rows before, files scanned, indexed and removed, and rows after.

    Null bodies are empty; repeated paths count once, with their smallest checksum. No files leave an empty index.
    """
    before = index.read().count()
    version = (index.versions() or [0])[-1] + 1
    index.replace(_rows(files), version)
    after = index.read().count()
    return {"rows_before": before, "files_scanned": after, "files_indexed": after, "files_removed": before, "rows_after": after}


def update(index: StoredTable, files: DataFrame) -> dict[str, int]:
    """The index after what is new, changed (by checksum) or no longer among ``files``; only the buckets of these paths are written again."""
    now, old = _rows(files), index.read()
    was = old.select("path", F.col("checksum").alias("was"), F.lit(True).alias("known"))
    both = now.join(was, "path", "full").withColumn("there", F.col("checksum").isNotNull())
    moved = both.where(~F.col("there") | F.col("known").isNull() | (F.col("checksum") != F.col("was")))
    counts = both.agg(F.count("known").alias("rows_before"), F.count_if("there").alias("files_scanned"), F.count_if(F.col("there") & (F.col("known").isNull() | (F.col("checksum") != F.col("was")))).alias("files_indexed"), F.count_if(~F.col("there")).alias("files_removed")).first()
    out = counts.asDict() | {"rows_after": counts["files_scanned"]}
    if out["files_indexed"] + out["files_removed"]:
        index.merge(moved.select("path", "checksum", "title", "body", "there"), (index.versions() or [0])[-1] + 1, _moved)
    return out


def _moved(old: DataFrame, rows: DataFrame) -> DataFrame:
    return old.join(rows.select("path"), "path", "left_anti").unionByName(rows.where("there").drop("there"))


def _rows(files: DataFrame) -> DataFrame:
    body = F.coalesce("body", F.lit(""))
    rows = files.where("path is not null").select("path", F.sha2(F.concat_ws("\n", F.coalesce("title", F.lit("")), body), 256).alias("checksum"), "title", body.alias("body"))
    return rows.groupBy("path").agg(F.min(F.struct("checksum", "title", "body")).alias("r")).select("path", "r.*")


def ingest(spark: SparkSession, docs: DataFrame, folder: str, chunk: Callable[[DataFrame], DataFrame], upto: str = STAGES[-1]) -> DataFrame:
    """Takes documents (title, text, owner) through the stages, each of them a batch of a stored table, and returns (document_id, path, chunk_count, reused).

    Documents are known by the hash of their text; one that is indexed is reused. A run takes up each document where an earlier one
    stopped, however far it came, as what a stage writes is the same again. Texts without a chunk stay
    at the stage before the last, with none; null texts are empty. ``upto`` ends a run after that stage. ``chunk`` gives (hash, ordinal, content) of (hash, text).
    """
    stored = StoredTable(spark, f"{folder}/stored", "hash string, title string, text string", "hash")
    chunks = StoredTable(spark, f"{folder}/chunks", CHUNKS, "hash")
    states = StoredTable(spark, f"{folder}/state", STATE, "hash")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.sha2(text, 256).alias("hash"), F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("title", F.lit("")).alias("title"), text.alias("text"))
    rows = rows.groupBy("hash").agg(F.min(F.struct("owner", "title", "text")).alias("r")).select("hash", "r.*")
    named = rows.select("hash", F.concat_ws(":", "owner", F.substring("hash", 1, 16)).alias("document_id"), F.concat(F.lit("raw/documents/"), "hash", F.lit(".md")).alias("path"), "title", "text")
    was = states.read().select("hash", F.col("stage").alias("was"))
    # texts are shuffled once here, and written where they are needed; what is to do at a stage follows from how far each came before
    known = F.coalesce(F.col("was") == STAGES[-1], F.lit(False))
    named = cut(named.join(was, "hash", "left").withColumn("text", F.when(~known, F.col("text"))))

    def at(stage: str, more: DataFrame) -> None:
        """States of ``more`` (hash, document_id, path, chunk_count) as of this stage."""
        new = more.select("hash", "document_id", "path", F.lit(stage).alias("stage"), "chunk_count")
        states.merge(new, _next(states), _replaced)

    def todo(stage: str) -> DataFrame:
        """Documents of this run that have not come to ``stage``."""
        return named.where(~F.coalesce(F.col("was").isin(STAGES[STAGES.index(stage) :]), F.lit(False)))

    some = todo("stored")
    if not some.isEmpty():
        stored.merge(some.select("hash", "title", "text"), _next(stored), _replaced)
        at("stored", some.withColumn("chunk_count", F.lit(0)))
    if upto != "stored":
        some = todo("chunked")
        if not some.isEmpty():
            parts = chunk(some.select("hash", "text")).select("hash", F.concat_ws(":", F.substring("hash", 1, 16), "ordinal").alias("chunk_id"), "ordinal", "content")
            if not parts.isEmpty():
                chunks.merge(parts, _next(chunks), _replaced)
            counts = chunks.read().groupBy("hash").agg(F.count("*").cast("int").alias("chunk_count"))
            found = some.select("hash", "document_id", "path").join(counts, "hash", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))
            at("chunked", found)
        if upto != "chunked":
            some = todo("indexed").select("hash").join(states.read(), "hash")
            if not some.isEmpty():
                at("indexed", some.where("chunk_count > 0"))
    counts = states.read().select("hash", "chunk_count")
    return named.select("hash", "document_id", "path", known.alias("reused")).join(counts, "hash").select("document_id", "path", "chunk_count", "reused")


def _replaced(old: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` in place of the old ones of their hashes; where they have none, as in a run that was not killed, no old text is shuffled to find that out."""
    hashes = rows.select("hash").distinct()
    if not old.select("hash").join(hashes, "hash", "left_semi").isEmpty():
        old = old.join(hashes, "hash", "left_anti")
    return old.unionByName(rows)


def _next(table: StoredTable) -> int:
    return (table.versions() or [0])[-1] + 1
