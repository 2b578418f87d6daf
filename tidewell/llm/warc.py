"""WARC archives: write pages as request, response or revisit, and metadata records;
read archives; assemble the records of one capture through their concurrent-to ids.

Writing needs no Python: a WARC record ends with CR LF CR LF, so Spark's text writer,
given that as its line separator, writes valid archives on any file system it knows.
Files hold so many records as their pages' sizes allow. Reading parses by Content-Length,
streaming through the compressed bytes, and keeps payloads only where asked.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

_NL = "\r\n"
_END = "\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORDS = (
    "record_type string, record_id string, concurrent_to string, refers_to_id string, target_uri string, "
    "payload_bytes long, payload_digest string, block string, payload binary"
)


def base32_of_hex(column: str) -> Column:
    """Upper-case base32 of 40 hex digits: each five hex digits are four letters."""
    return F.expr(
        f"array_join(transform(sequence(0, 31), j -> substr('{_BASE32}', (shiftright(cast(conv(substr({column}, (j div 4) * 5 + 1, 5), 16, 10) as int), "
        "cast(15 - 5 * (j % 4) as int)) & 31) + 1, 1)), '')"
    )


def _id(*parts: Column) -> Column:
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(text, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column, rid: Column, uri: Column, date: str, headers: list[tuple[str, Column]], block: Column) -> Column:
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(_NL))).otherwise(F.lit(""))
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), *headers]
    return F.concat(
        F.lit(f"WARC/1.1{_NL}"), *[line(n, v) for n, v in fields],
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END), block,
    )


#: Payloads up to so many bytes, and so many records in a file: no file has much over 64 MB but for one larger page.
SIZES = [(1 << 16, 3000), (1 << 20, 180), (1 << 31, 3)]


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", min_revisit_bytes: int = 0) -> None:
    """Write three records for each row of ``pages`` (page_id, url, html) under ``path``, pages of each class of SIZES in files of their own.

    Equal payloads have equal sizes, so that each class finds its revisits by itself.
    """
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    bounds = [0, *[b + 1 for b, _ in SIZES]]
    held = pages.agg(*[F.count_if((size >= lo) & (size <= hi)) for lo, (hi, _) in zip(bounds, SIZES)]).first()
    for n, lo, (hi, records_per_file) in zip(held, bounds, SIZES):
        if n or (hi == SIZES[0][0] and not sum(held)):
            _write(pages.where((size >= lo) & (size <= hi)), path, date, min_revisit_bytes, records_per_file)


def _write(pages: DataFrame, path: str, date: str, min_revisit_bytes: int, records_per_file: int) -> None:
    """Write the records of pages of one class of sizes.

    Of payloads that are equal and at least ``min_revisit_bytes`` long, the one with the
    smallest page_id is a response and the others revisit it; shorter payloads are all
    responses. A null html is an empty payload, a null url leaves out the target URI.
    Rows that repeat the smallest page_id are all responses. A null page_id comes last.
    """
    p = (
        pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
        .withColumn("key", F.sha2("payload", 256))
        .withColumn("sha1_hex", F.sha1("payload"))
        .withColumn("digest", base32_of_hex("sha1_hex"))
        .withColumn("size", F.octet_length("payload").cast("long"))
        .withColumn("rid", _id(F.col("page_id"), F.col("url"), F.col("key"), F.lit("response")))
    )
    # which rows revisit is found without their payloads; these meet the answer by their own ids, so that a common payload makes no key hot
    small = p.where(F.col("size") >= min_revisit_bytes).select("key", "page_id", "rid")
    firsts = small.groupBy("key").agg(F.min(F.struct(F.col("page_id").isNull().alias("n"), "page_id", "rid")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    again = small.join(firsts, "key").where(~F.col("page_id").eqNullSafe(F.col("first.page_id"))).select("rid", "first").distinct()
    p = p.join(again, "rid", "left").withColumn("revisit", F.col("first").isNotNull())
    uri = F.regexp_replace("url", "[\r\n]", " ")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_NL}Content-Type: text/html; charset=utf-8{_NL}Content-Length: "), F.col("size").cast("string"), F.lit(_END))
    get = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{_END}"))
    note = F.to_json(F.struct("page_id", "url", F.when(F.col("revisit"), F.col("first.page_id")).alias("refers_to")))
    rid = F.col("rid")
    kinds = [
        _record(F.lit("request"), _id(rid, F.lit("request")), uri, date, [("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/http;msgtype=request"))], get),
        _record(
            F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), rid, uri, date,
            [
                ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
                ("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
                ("WARC-Refers-To", F.when(F.col("revisit"), F.col("first.rid"))),
                ("Content-Type", F.lit("application/http;msgtype=response")),
            ],
            F.concat(http, F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))),
        ),
        _record(F.lit("metadata"), _id(rid, F.lit("metadata")), uri, date, [("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/json"))], note),
    ]
    p.select(F.explode(F.array(*kinds)).alias("value")).write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).mode("append").text(path)


class _Bytes(io.RawIOBase):
    """The uncompressed bytes of an archive, gzipped (any number of members) or plain, as a stream."""

    def __init__(self, content: bytes):
        self.rest, self.zipped = content, content[:2] == b"\x1f\x8b"
        self.d = zlib.decompressobj(31) if self.zipped else None
        self.out = b""

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        while not self.out and self.rest:
            if not self.zipped:
                self.out, self.rest = self.rest, b""
                break
            self.out = self.d.decompress(self.rest, 1 << 20)
            self.rest = self.d.unconsumed_tail
            if self.d.eof:
                self.rest, self.d = self.d.unused_data, zlib.decompressobj(31)
        n = min(len(b), len(self.out))
        b[:n], self.out = self.out[:n], self.out[n:]
        return n


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record."""
    f = io.BufferedReader(_Bytes(content), 1 << 20)
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, f.read(int(head["content-length"]))


def _parsed(with_payload: bool):
    def parse(batches):
        for pdf in batches:
            for content in pdf["content"]:
                rows = []
                for head, block in records(content):
                    kind, payload, size, digest, text = head.get("warc-type"), None, None, None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        else:
                            fields = dict(x.lower().split(b":", 1) for x in http.split(b"\r\n")[1:] if b":" in x)
                            size = int(fields.get(b"content-length", b"0"))
                            digest, payload = head.get("warc-payload-digest", "").removeprefix("sha1:"), None
                    else:
                        text = block.decode("utf-8", "replace")
                    rows.append((kind, head.get("warc-record-id"), head.get("warc-concurrent-to"), head.get("warc-refers-to"), head.get("warc-target-uri"), size, digest, text, payload if with_payload else None))
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=_COLUMNS).astype({"payload_bytes": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=_COLUMNS).astype({"payload_bytes": "Int64"})

    return parse


_COLUMNS = [x.split()[0] for x in RECORDS.split(", ")]


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row for each record of the archives under ``path``."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(_parsed(with_payload), RECORDS)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row for each capture: its response or revisit with the request and the
    metadata that are concurrent to it (null where there is none). Records repeated under
    one id count once on the request and metadata side and once each as a response."""
    captures = rows.where(F.col("record_type").isin("response", "revisit")).drop("concurrent_to", "block")

    def beside(kind: str) -> DataFrame:
        got = rows.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull())
        return got.groupBy(F.col("concurrent_to").alias("record_id")).agg(F.first(F.struct(F.col("record_id").alias("id"), "target_uri", "block")).alias(kind))

    return captures.join(beside("request"), "record_id", "left").join(beside("metadata"), "record_id", "left")


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark) + "/archives"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    note = F.from_json("metadata.block", "page_id long, url string, refers_to long")
    return assemble(read_warc(spark, path)).withColumn("note", note).select(
        F.col("note.page_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("note.refers_to").alias("refers_to")
    )


OP7_SQL = None  # DuckDB has no base32; the query is tested against a brute-force version


def brute_force(rows: list[tuple]) -> list[tuple]:
    """op7's rows for (page_id, url, html) rows, without archives."""
    first: dict[str, int] = {}
    for page, _, html in rows:
        first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        kind = "response" if first[html or ""] == page else "revisit"
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, None if kind == "response" else first[html or ""]))
    return out
