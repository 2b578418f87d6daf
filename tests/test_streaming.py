"""The index follows a stream of files of change events."""

from tidewell.streaming import changes


def test_index_follows_events(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / x) for x in ("in", "index", "cp"))
    batches = [
        [(1, "a.md", "created", "x1"), (2, "b.md", "created", "y1")],
        [(3, "a.md", "updated", "x2"), (5, "b.md", "deleted", None)],
        [(4, "b.md", "updated", "y2"), (3, "a.md", "updated", "x2")],  # late and repeated events change nothing
    ]
    for b in batches:
        spark.createDataFrame(b, changes.SCHEMA).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(changes.SCHEMA).parquet(source)
        changes.follow(spark, events, folder, checkpoint).awaitTermination()
    got = {r.path: (r.seq, r.checksum, r.gone) for r in changes.current(spark, folder).collect()}
    assert got == {"a.md": (3, "x2", False), "b.md": (5, None, True)}
