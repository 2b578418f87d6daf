"""Codes of vectors: each part of a vector becomes the index of its codebook's nearest entry.

Codebooks are learned by rounds of assignment and of integer means. A part is assigned by
Exponion search: its distance u to the entry that it had before bounds how far from that
entry a nearer one can be (2u, by the triangle inequality), so only a prefix of that entry's
neighbours, sorted by distance, is scanned. Distances are exact integers, ties go to the
lower index. Each round writes the vectors with their codes, and with them one row of sums
for each entry and task; only the sums, as many as entries, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import cut
from .topk import scaled

#: Parts of a vector, entries of a codebook, rounds.
PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Vectors that are assigned at once.
STEP = 4096
_EXACT = 2.0**53


class Codebooks:
    """Entries by part (lists of lists of whole numbers), the distances between a part's entries, and each entry's neighbours by distance."""

    def __init__(self, parts: list[list[list[int]]]):
        self.parts = parts
        self.width = len(parts[0][0])
        self.largest = max((abs(x) for p in parts for e in p for x in e), default=0)
        self._ready = {}

    def of(self, part: int, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, neighbours of each entry and the squared distances to these, ascending; doubles or whole numbers of any size."""
        if (part, kind) not in self._ready:
            c = np.array(self.parts[part], dtype=object).astype(kind).reshape(-1, self.width)
            d = np.stack([((c - x) * (c - x)).sum(axis=1) for x in c])
            near = np.stack([np.array(sorted(range(len(c)), key=lambda j: (row[j], j))) for row in d])
            self._ready[part, kind] = c, near, np.take_along_axis(d, near, axis=1)
        return self._ready[part, kind]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_ready": {}}

    def digest(self) -> str:
        numbers = ",".join(str(x) for p in self.parts for e in p for x in e)
        return hashlib.sha256(numbers.encode()).hexdigest()


def nearest(x: np.ndarray, before: np.ndarray, part: int, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row of ``x``, ties to the lower index, and its squared distance; ``before``: the entry to start at.

    Doubles hold all numbers while these stay below 2^53; else whole numbers of any size do.
    """
    largest = max(books.largest, int(np.abs(x.astype(np.float64)).max(initial=0)))
    kind = np.float64 if 16.0 * books.width * largest * largest < _EXACT else object
    entries, near, apart = books.of(part, kind)
    x = x.astype(kind)
    start = ((x - entries[before]) ** 2).sum(axis=1)
    best, least = before.copy(), start.copy()
    for a in np.unique(before).tolist():
        rows = np.flatnonzero(before == a)
        within = np.searchsorted(apart[a], 4 * start[rows], side="right")  # entries nearer than 2u, or just as far
        for upto in (1 << k for k in range(1, len(entries).bit_length() + 1)):
            some = rows[(within <= upto) & (within > upto // 2)] if upto > 2 else rows[within <= 2]
            if not len(some):
                continue
            scan = np.sort(near[a, :upto])  # by index, so that of equal distances the first is the lowest
            c = entries[scan]
            d = (x[some] * x[some]).sum(axis=1)[:, None] - 2 * (x[some] @ c.T) + (c * c).sum(axis=1)
            at = d.argmin(axis=1) if kind is np.float64 else np.array([min(range(len(scan)), key=row.__getitem__) for row in d])
            best[some], least[some] = scan[at], d[np.arange(len(some)), at]
    return best, least


def _steps(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some rows at a time, with their vectors (column v) filled with zeros to ``width``."""
    for at in range(0, batch.num_rows, STEP):
        some = batch.slice(at, STEP)
        column = some.column("v")
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        x = np.zeros((some.num_rows, width), dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        x[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        yield some, x


def _assigner(shared, width: int, parts: int, final: bool):
    """Rows with v and code -> the same rows with new codes, followed by the task's sums by part and entry (or, at the end, the errors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books: Codebooks = shared.value
        w, k = books.width, len(books.parts[0])
        sums = np.zeros((parts, k, w), dtype=object)
        counts = np.zeros((parts, k), dtype=np.int64)
        kept = None
        for batch in batches:
            for some, x in _steps(batch, width):
                before = some.column("code").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
                codes, error = np.zeros_like(before), np.zeros(len(x), dtype=object)
                for p in range(parts):
                    mine = x[:, p * w : (p + 1) * w]
                    best, least = nearest(mine, before[:, p].astype(np.int64), p, books)
                    codes[:, p] = best
                    error += least.astype(object)
                    if not final:
                        order = np.argsort(best, kind="stable")
                        heads = np.flatnonzero(np.diff(best[order], prepend=-1))
                        wide = float(np.abs(mine.astype(np.float64)).max(initial=0)) * len(mine) < 2.0**62
                        sums[p, best[order[heads]]] += np.add.reduceat(mine[order] if wide else mine[order].astype(object), heads, axis=0).astype(object)
                        counts[p] += np.bincount(best, minlength=k)
                kept = some.select(["vec_id", "label"] if final else ["vec_id", "label", "v"])
                code = pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel(), pa.int32()), parts).cast(pa.list_(pa.int32()))
                if final:
                    worth = pa.array([min(int(e), 2**63 - 1) for e in error], pa.int64())
                    yield pa.RecordBatch.from_arrays([*kept.columns, code, worth], names=["vec_id", "label", "code", "error"])
                else:
                    none = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int32(), pa.list_(pa.decimal128(38, 0)), pa.int64())]
                    yield pa.RecordBatch.from_arrays([*kept.columns, code, *none], names=[*kept.schema.names, "code", "part", "entry", "total", "n"])
        if not final and kept is not None:
            p, e = np.nonzero(counts)
            total = pa.array([[Decimal(int(x)) for x in sums[i, j]] for i, j in zip(p, e)], pa.list_(pa.decimal128(38, 0)))
            own = [pa.nulls(len(p), f.type) for f in kept.schema] + [pa.nulls(len(p), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(p, pa.int32()), pa.array(e, pa.int32()), total, pa.array(counts[p, e], pa.int64())], names=[*kept.schema.names, "code", "part", "entry", "total", "n"])

    return run


def _means(table: DataFrame, books: Codebooks) -> Codebooks:
    """The entries after a round: floors of the means of their parts; entries without parts stay."""
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(books.width)]
    found = table.where("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect()  # as many rows as entries
    parts = [list(map(list, p)) for p in books.parts]
    for row in found:
        parts[row["part"]][row["entry"]] = [int(row[f"t{i}"]) // row["n"] for i in range(books.width)]
    return Codebooks(parts)


def vector_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(vec_id, label, code, error) of every row of ``vectors`` (vec_id, label, v array<long>), and the codebooks.

    code is the list of entry indexes by part, error the squared distances summed over the parts, held
    within a long. Shorter vectors are filled with zeros to the longest one's length, and all to a multiple of
    ``parts``. The first entries are the parts of the ``entries`` smallest (vec_id, v), null ids last; with
    fewer vectors there are fewer entries. Repeated rows count each; rows with a null v take no part. An
    empty table has no codebooks (None) and no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.where("v is not null").select("vec_id", "label", "v", F.array_repeat(F.lit(0), parts).alias("code"))
    kind = rows.schema["label"].dataType
    state = cut(rows)
    longest = state.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return state.select("vec_id", "label", "code", F.lit(0).cast("long").alias("error")), None
    w = max(1, -(-longest // parts))
    first = [list(r["v"]) + [0] * (w * parts - len(r["v"])) for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    books = Codebooks([[v[p * w : (p + 1) * w] for v in first] for p in range(parts)])
    made = StructType([*(f for f in state.schema), *StructType.fromDDL("part int, entry int, total array<decimal(38,0)>, n long")])
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(books)  # parts x entries
        state = cut(state.select("vec_id", "label", "v", "code").mapInArrow(_assigner(shared, w * parts, parts, False), made))
        books = _means(state, books)
        state = state.where("part is null")
    shared = spark.sparkContext.broadcast(books)
    coded = StructType([StructField("vec_id", state.schema["vec_id"].dataType), StructField("label", kind), *StructType.fromDDL("code array<int>, error long")])
    return state.select("vec_id", "label", "v", "code").mapInArrow(_assigner(shared, w * parts, parts, True), coded), books


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = scaled(table, keep=("label",))
    coded, books = vector_codes(vectors)
    coded = cut(coded)
    top = F.lit(2**63 - 1).cast("decimal(38,0)")
    by_label = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    joined = coded.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    digits = F.array_join(F.transform("code", lambda i: F.lower(F.lpad(F.hex(i), 2, "0"))), "")
    return joined.select("vec_id", digits.alias("code"), "error", "label_error", F.lit(books.digest() if books else hashlib.sha256().hexdigest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The rounds spelled out: all distances of a round, its assignment, its means."""
    assign = "a{r} AS (SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT p.vec_id, p.part, c.entry, list_inner_product(list_transform(c.v, lambda x, i: x - p.v[i]), list_transform(c.v, lambda x, i: x - p.v[i])) AS d FROM p JOIN c{r} c ON p.part = c.part) GROUP BY ALL)"
    means = "c{n} AS (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT part, entry, list(x ORDER BY pos) AS v FROM (SELECT a.part, a.entry, pos, floor(sum(p.v[pos]) / count(*)) AS x FROM a{r} a JOIN p USING (vec_id, part), unnest(range(1, len(p.v) + 1)) AS u(pos) GROUP BY ALL) GROUP BY ALL) m ON c.part = m.part AND c.entry = m.entry)"
    steps = [s.format(r=r, n=r + 1) for r in range(ROUNDS) for s in (assign, means)] + [assign.format(r=ROUNDS)]
    return f"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, u.part, v[u.part * len(v) // {PARTS} + 1 : (u.part + 1) * len(v) // {PARTS}] AS v FROM e, unnest(range({PARTS})) AS u(part)),
c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM p QUALIFY entry < {ENTRIES}),
{", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
k AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id),
s AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS sha FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha FROM s) AS codebooks_sha256 FROM k JOIN e USING (vec_id)
"""


OP11_SQL = _sql()
