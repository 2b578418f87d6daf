import gzip

from tidewell.llm import warc

PAGES = [
    (3, "http://a/1", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, None), (5, "http://b\r\nX: y", ""), (4, "u", "x\r\n\r\nWARC/1.1\r\n\r\n"), (9, "v", "long " * 50_000),
    (9, "v", "long " * 50_000), (10, "w", "long " * 50_000),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, payload string")
    pages.drop("payload").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in warc.op7_warc(spark, str(tmp_path)).collect())
    assert got == sorted(warc.brute_force(PAGES))


def test_payloads_and_assembly(spark, tmp_path):
    pages = spark.createDataFrame(PAGES[:5], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w", min_revisit_bytes=1)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w", with_payload=True)
    assert rows.count() == 15
    captures = warc.assemble(rows).collect()
    assert len(captures) == 5 and all(c.request.target_uri == c.target_uri and c.metadata.block for c in captures)
    assert {bytes(c.payload).decode() for c in captures if c.record_type == "response"} == {"<p>é</p>", "", "x\r\n\r\nWARC/1.1\r\n\r\n"}
    assert sum(c.record_type == "revisit" for c in captures) == 1  # empty payloads are below the bound


def test_reader_takes_members_and_plain(spark):
    one = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    for data in (one + one, gzip.compress(one) + gzip.compress(one)):
        assert [(h["warc-type"], b) for h, b in warc.records(data)] == [("metadata", b"hi")] * 2


def test_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/e")
    assert warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/e")).count() == 0


def test_large_pages_have_files_of_their_own(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SIZES", [(10, 6), (100, 3), (1 << 31, 3)])
    rows = [(i, f"u{i}", "x" * (i % 3 * 60) + str(i % 5)) for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, f"file://{tmp_path}/w")
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/w").select("content").collect()
    counts = sorted(sum(1 for _ in warc.records(bytes(f.content))) for f in files)
    assert sum(counts) == 90 and counts.count(3) == 20
    assert warc.assemble(warc.read_warc(spark, f"file://{tmp_path}/w")).count() == 30
