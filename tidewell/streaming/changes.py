"""An index that follows a stream of change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stored import StoredTable

SCHEMA = "seq long, path string, kind string, checksum string"
INDEX = "path string, seq long, checksum string, gone boolean"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def expanded(events: DataFrame) -> DataFrame:
    """Events with renames (kind 'renamed', from old_path to path) as a deletion and a creation."""
    moved = events.where("kind = 'renamed'")
    gone = moved.where("old_path <> path").select("seq", F.col("old_path").alias("path"), F.lit("deleted").alias("kind"), F.lit(None).cast("string").alias("checksum"))
    there = events.select("seq", "path", F.when(F.col("kind") == "renamed", "created").otherwise(F.col("kind")).alias("kind"), "checksum")
    return there.union(gone)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each path by its sequence number: (path, seq, kind, checksum)."""
    return events.groupBy("path").agg(F.max(F.struct("seq", "kind", "checksum")).alias("e")).select("path", "e.*")


def apply(index: DataFrame, events: DataFrame) -> DataFrame:
    """The index (path, seq, checksum, gone) after the events. Deletions stay as tombstones with their sequence
    number, so that a late or repeated batch changes nothing."""
    new = latest(events).select("path", "seq", "checksum", (F.col("kind") == "deleted").alias("gone"))
    both = index.unionByName(new)
    return both.groupBy("path").agg(F.max(F.struct("seq", "gone", "checksum")).alias("e")).select("path", "e.seq", "e.checksum", "e.gone")


def stored(spark: SparkSession, folder: str) -> StoredTable:
    """The index that a stream keeps under ``folder``."""
    return StoredTable(spark, folder, INDEX, "path")


def follow(spark: SparkSession, events: DataFrame, folder: str, checkpoint: str, keep: int | None = None):
    """Start a query that brings the index under ``folder`` up to date with each batch: only buckets of paths with events are written.

    A batch that runs again writes the same. ``keep`` removes what the newest so many batches do not need.
    """

    def batch(rows: DataFrame, n: int) -> None:
        index = stored(spark, folder)
        index.merge(rows, n, apply)
        if keep:
            index.compact(keep)

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The index as of the newest batch (older than ``before``, if given); empty if there is none."""
    return stored(spark, folder).read(before)
