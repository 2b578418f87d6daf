"""Tables that are changed batch by batch: stored in buckets of their key, of which a batch rewrites only those it touches.

A folder holds data (``v=N/bucket=B``) and, for each finished batch N, a manifest (``m=N``) that names the
version of every bucket. A batch writes its buckets first and its manifest last, so that one which
is killed leaves the table as it was, and one that runs again writes the same. Folders
of buckets that a batch does not touch keep their files and names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class StoredTable:
    """Rows of ``schema`` under ``folder`` (any path Spark can write), in ``buckets`` of ``key``, whose number stays as the first batch has it."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = 32):
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _paths(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The finished batches, in order."""
        path, fs = self._paths()
        if not fs.exists(path):
            return []
        done = lambda s: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(path) if s.getPath().getName().startswith("m=") and done(s))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """The version of each bucket as of the newest batch (older than ``before``)."""
        known = [v for v in self.versions() if before is None or v < before]
        if not known:
            return {}
        rows = self.spark.read.schema("bucket int, version int, buckets int").parquet(f"{self.folder}/m={known[-1]}").collect()  # as many as buckets
        if rows:
            self.buckets = rows[0]["buckets"]
        return {r["bucket"]: r["version"] for r in rows}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _read(self, manifest: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/v={v}/bucket={b}" for b, v in sorted(manifest.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, before: int | None = None) -> DataFrame:
        """The rows as of the newest batch (older than ``before``); none if there is none."""
        return self._read(self.manifest(before))

    def merge(self, rows: DataFrame, version: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Batch ``version``: combine(the stored rows of the buckets that ``rows`` touch, rows) takes their place. Returns these buckets.

        combine keeps a row's bucket and works key by key, so that other buckets need not be read.
        """
        before = self.manifest(version)
        touched = [r["b"] for r in rows.select(self.bucket().alias("b")).distinct().collect()]  # buckets at most
        new = combine(self._read({b: v for b, v in before.items() if b in touched}), rows)
        self._write(new, version, {b: v for b, v in before.items() if b not in touched})
        return sorted(touched)

    def replace(self, rows: DataFrame, version: int) -> None:
        """Batch ``version``: ``rows`` take the place of all."""
        self.manifest(version)
        self._write(rows, version, {})

    def _write(self, rows: DataFrame, version: int, others: dict[int, int]) -> None:
        names = [f.name for f in StructType.fromDDL(self.schema)]
        out = f"{self.folder}/v={version}"
        rows.select(*names, self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(out)
        path, fs = self._paths()
        written = [int(s.getPath().getName()[7:]) for s in fs.listStatus(self.spark._jvm.org.apache.hadoop.fs.Path(out)) if s.getPath().getName().startswith("bucket=")]
        manifest = [(b, v, self.buckets) for b, v in {**others, **dict.fromkeys(written, version)}.items()]
        self.spark.createDataFrame(manifest, "bucket int, version int, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/m={version}")

    def compact(self, keep: int = 2) -> list[str]:
        """Removes what no manifest of the newest ``keep`` batches names: older manifests, their buckets and those of killed batches. Returns the removed folders' names."""
        path, fs = self._paths()
        stay = self.versions()[-keep:]
        if not stay:
            return []
        used: set[tuple[int, int]] = set()
        for v in stay:
            used |= set(self.manifest(v + 1).items())
        gone = []
        of = lambda *parts: self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if name.startswith("m=") and int(name[2:]) not in stay:
                gone.append(name)
            elif name.startswith("v="):
                inside = [x.getPath().getName() for x in fs.listStatus(s.getPath())]
                dead = [b for b in inside if b.startswith("bucket=") and (int(b[7:]), int(name[2:])) not in used]
                gone += [f"{name}/{b}" for b in dead] if len(dead) < len([b for b in inside if b.startswith("bucket=")]) else [name]
        for name in gone:
            fs.delete(of(name), True)
        return gone
