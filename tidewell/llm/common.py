"""Helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Text bytes that one vectorised step works on; bounds a worker's RAM.
STEP_BYTES = 4_000_000
#: Column that carries an operator's texts.
HELD = "__held"


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share.

    Only in local mode, as in tests, a temporary folder of this machine is set and used
    where the session names none; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = got.get() if got.isDefined() else None
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def null_safe_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def with_columns(docs: DataFrame, text: str, added: str, make: Callable[[], Callable[[list[str]], list[list]]], limit: int = STEP_BYTES, keep_text: bool = True, release: Callable[[], None] = lambda: None) -> DataFrame:
    """Add the columns ``added`` (DDL) to ``docs``, which replace columns of their names.

    make(), called once a task, gives the function from some texts (null: empty) to the
    lists of the added columns; it sees about ``limit`` characters at once. All other
    columns pass through as Arrow data, so that their values stay as they are.
    release() is called when a task ends: a worker that waits for its next task holds
    no more of an operator than that keeps.
    """
    new = StructType.fromDDL(added)
    names = [f.name for f in new]
    kept = [f for f in docs.schema if f.name not in names and (keep_text or f.name != text)]
    arrow = to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            values = batch.column(0)
            sizes = pc.fill_null(pc.binary_length(values), 0).to_pylist()
            rest = batch.select(list(range(1, batch.num_columns)))
            for a, b in steps(sizes, sizes, limit):
                columns = f([v or "" for v in values.slice(a, b - a).to_pylist()])
                own = [pa.array(c, type=t.type) for c, t in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays([*rest.slice(a, b - a).columns, *own], names=[*rest.schema.names, *names])
        del f
        release()

    into = docs.select(F.col(text).alias(HELD), *[F.col(f"`{x.name}`") for x in kept])
    return into.mapInArrow(run, StructType([*kept, *new]))


def steps(values: Iterable, sizes: Iterable[int], limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows whose sizes sum to about ``limit``; a larger row is a range alone."""
    start, total, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if i >= start:
        yield start, i + 1
