"""Stored tables: killed and repeated batches, untouched buckets, compaction; ingestion that is taken up again."""

import os

import pytest

from pyspark.sql import functions as F

from tidewell.operators import ingest, knowledge
from tidewell.sources.stored import StoredTable
from tidewell.streaming import changes

SCHEMA = "path string, seq long, checksum string, gone boolean"


def files(folder):
    return {os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet") and "/v=" in d}


def batch(spark, rows):
    return spark.createDataFrame(rows, changes.SCHEMA)


def test_killed_and_repeated_batches(spark, tmp_path, monkeypatch):
    table = StoredTable(spark, str(tmp_path / "t"), SCHEMA, "path", 8)
    assert table.read().count() == 0 and table.versions() == []
    table.merge(batch(spark, [(i, f"{i}.md", "created", f"c{i}") for i in range(40)]), 1, changes.apply)
    before, kept = files(tmp_path), {r.path: r.seq for r in table.read().collect()}
    more = batch(spark, [(100, "3.md", "updated", "new"), (101, "9.md", "deleted", None)])

    def killed(*a, **k):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", killed)  # the manifest is not written any more
        with pytest.raises(RuntimeError):
            table.merge(more, 2, changes.apply)
    assert {r.path: r.seq for r in table.read().collect()} == kept and table.versions() == [1]
    touched = table.merge(more, 2, changes.apply)
    once = sorted(map(tuple, table.read().collect()))
    assert len(touched) <= 2 and before <= files(tmp_path)  # the first batch's files are all there under their names
    table.merge(more, 2, changes.apply)
    assert sorted(map(tuple, table.read().collect())) == once and len(once) == 40
    assert {r.path: (r.seq, r.gone) for r in table.read().where("seq >= 100").collect()} == {"3.md": (100, False), "9.md": (101, True)}
    assert {r.path: r.seq for r in table.read(before=2).collect()} == kept
    untouched = {p for b, v in table.manifest().items() if v == 1 for p in before if f"/bucket={b}/" in p}
    gone = table.compact(keep=1)
    assert "m=1" in gone and untouched <= files(tmp_path) and sorted(map(tuple, table.read().collect())) == once


def test_buckets_stay_as_first_written_and_replace(spark, tmp_path):
    StoredTable(spark, str(tmp_path), SCHEMA, "path", 4).merge(batch(spark, [(1, "a", "created", "x")]), 1, changes.apply)
    table = StoredTable(spark, str(tmp_path), SCHEMA, "path", 64)
    table.merge(batch(spark, [(2, "a", "updated", "y"), (3, None, "created", "z")]), 2, changes.apply)
    assert table.buckets == 4 and {r.path: r.checksum for r in table.read().collect()} == {"a": "y", None: "z"}
    table.replace(table.read().where("path = 'a'").select("*"), 3)
    assert [r.path for r in table.read().collect()] == ["a"]
    table.replace(spark.createDataFrame([], SCHEMA), 4)
    assert table.read().count() == 0


def test_follow_touches_only_paths_with_events(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "index", "cp"))
    for n, rows in enumerate([[(i, f"{i}.md", "created", "x") for i in range(60)], [(70, "5.md", "updated", "y")]]):
        batch(spark, rows).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(changes.SCHEMA).parquet(source)
        changes.follow(spark, events, folder, checkpoint, keep=2).awaitTermination()
    versions = changes.stored(spark, folder).manifest()
    assert sorted(versions.values()).count(1) == 1 and changes.current(spark, folder).count() == 60


def test_update_counts_and_leaves_the_rest(spark, tmp_path):
    index = ingest.index_table(spark, str(tmp_path), 16)
    rows = [(f"{i}.md", "t", f"body {i}") for i in range(30)] + [(None, "t", "x"), ("n.md", None, None), ("n.md", None, None)]
    df = spark.createDataFrame(rows, "path string, title string, body string")
    assert ingest.rebuild(index, df) == {"rows_before": 0, "files_scanned": 31, "files_indexed": 31, "files_removed": 0, "rows_after": 31}
    before = files(tmp_path)
    nothing = ingest.update(index, df)
    assert nothing["files_indexed"] == nothing["files_removed"] == 0 and files(tmp_path) == before and index.versions() == [1]
    changed = df.where("path <> '4.md'").withColumn("body", F.when(F.col("path") == "5.md", "other").otherwise(F.col("body")))
    assert ingest.update(index, changed) == {"rows_before": 31, "files_scanned": 30, "files_indexed": 1, "files_removed": 1, "rows_after": 30}
    assert {r.path: r.body for r in index.read().collect()}["5.md"] == "other" and index.read().count() == 30
    assert len(files(tmp_path) - before) <= 2


def test_ingest_takes_up_where_it_stopped(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([("a", "one " * 900, "o"), ("b", "two", "o"), ("b", "two", None), ("c", None, "o"), ("d", "three " * 2000, "p")], "title string, text string, owner string")
    seen = []

    def chunk(rows):
        seen.append(rows.count())
        return knowledge.windows(rows, "hash", "text").withColumnRenamed("chunk", "content")

    folder = str(tmp_path)
    merge, calls = StoredTable.merge, []

    def killed(self, *a):
        calls.append(self.folder)
        if self.folder.endswith("state") and calls.count(self.folder) == 2:
            raise RuntimeError("killed after the chunks were written")
        return merge(self, *a)

    with monkeypatch.context() as m:
        m.setattr(StoredTable, "merge", killed)
        with pytest.raises(RuntimeError):
            ingest.ingest(spark, docs, folder, chunk)
    first = {r.document_id: (r.chunk_count, r.reused) for r in ingest.ingest(spark, docs, folder, chunk).collect()}
    again = {r.document_id: (r.chunk_count, r.reused) for r in ingest.ingest(spark, docs, folder, chunk).collect()}
    assert sorted(first.values()) == [(0, False), (1, False), (2, False), (7, False)] and sorted(again.values()) == [(0, False), (1, True), (2, True), (7, True)]
    assert seen[0] == seen[1] == 4  # the killed run's texts are chunked again
    chunks = StoredTable(spark, f"{folder}/chunks", ingest.CHUNKS, "hash").read()
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 10
