"""Which sources of a language differ, and by which terms: a tournament of term shares.

Every (lang, source) group has a seat, and its counts are cut by term into shards, so that
what meets in one task is bounded however many terms or sources there are. The slices stay
where their seats are, in a table bucketed by language, shard and seat; compressed copies of
the other seats' slices visit them, in rounds of a round-robin tournament in which each seat
meets one other seat, and once its own. A meeting is evaluated for both directions. Terms
are ranked by heaps within the tasks, whose short lists are merged.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, null_safe_text, shared_dir

#: Documents that a kept term stands in at least, and the ranks of part `term`.
LEAST_DOCS, TERM_RANKS = 10, 10
#: Seats of a language; the tournament has one round less, and one at home.
SEATS = 8
#: Counts (groups x terms) of a seat's slice: bounds what a meeting holds.
CELLS = 131_072
#: Different terms that a task counts before it passes them on, and bytes of a text that it splits at once.
HELD_TERMS, PIECE = 1_000_000, 4_000_000
SHARE = 1_000_000_000
#: A byte of a term as itself, A-Z lower-cased, every other byte as a space.
_BYTES = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about PIECE bytes of text."""
    data, at = text.translate(_BYTES), 0
    while at < len(data):
        end = len(data)
        if end - at > PIECE:
            end = data.rfind(b" ", at, at + PIECE)
            end = end if end > at else data.find(b" ", at + PIECE)
            end = end if end > at else len(data)
        yield data[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, _text -> partial counts: n of a term in a group; docs of a term in a language (source null); and one row for each group (term null)."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[str, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in n.items():
            yield _rows(lang, source, [None, *found], [0, *found.values()], [0] * (len(found) + 1))
        for lang, found in docs.items():
            yield _rows(lang, None, list(found), [0] * len(found), list(found.values()))
        n.clear()
        docs.clear()

    held = 0
    for batch in batches:
        langs, sources, texts = batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("_text")
        for r, (lang, source) in enumerate(zip(langs, sources)):
            mine, seen = n[lang, source], set()
            for some in terms(texts[r].as_buffer().to_pybytes()):
                mine.update(some)
                seen.update(some)
            docs[lang].update(seen)
            held += len(seen)
            if held > 20 * HELD_TERMS or (held > HELD_TERMS and sum(map(len, n.values())) > HELD_TERMS):
                yield from rows()
                held = 0
    yield from rows()


def _rows(lang: str, source: str | None, term: list, n: list, docs: list) -> pa.RecordBatch:
    columns = [pa.array([lang] * len(term), pa.string()), pa.array([source] * len(term), pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + 2) / total), exact for totals below 9e15, by long division in three digits of a thousand."""
    left = count.astype(np.int64) + 2
    out = left // total
    left = left % total
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of a slice, compressed."""
    for pdf in batches:
        blobs = []
        for pos, n in zip(pdf["pos"], pdf["n"]):
            some = pos is not None and len(pos)
            body = np.array(pos, np.int32).tobytes() + np.array(n, np.int64).tobytes() if some else b""
            blobs.append(zlib.compress(body, 1))
        yield pdf.drop(columns=["pos", "n"]).assign(blob=blobs)


def _shares(rows: pd.DataFrame) -> np.ndarray:
    """The shares of a seat's groups: one row a group, one column a term of the shard."""
    out = np.zeros((len(rows), int(rows["size"].iloc[0])), dtype=np.int64)
    for i, blob in enumerate(rows["blob"]):
        body = zlib.decompress(blob)
        k = len(body) // 12
        out[i, np.frombuffer(body, np.int32, k)] = np.frombuffer(body, np.int64, k, 4 * k)
    return share(out, (rows["in_group"] + 2 * rows["kept"]).to_numpy(np.int64)[:, None]) if out.shape[1] else out


def _home(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return _met(key[0], rows, _shares(rows), None, None)


def _meeting(key: tuple, residents: pd.DataFrame, visitors: pd.DataFrame) -> pd.DataFrame:
    if not len(residents) or not len(visitors):
        return _met(key[0], residents[:0], None, visitors[:0], None)
    return _met(key[0], residents, _shares(residents), visitors, _shares(visitors))


def _met(lang: str, rows: pd.DataFrame, p: np.ndarray, others: pd.DataFrame | None, q: np.ndarray | None) -> pd.DataFrame:
    """Both directions of each pair of groups: what the shard adds is the same for both."""
    names, out = rows["source"].tolist(), []
    for i, source in enumerate(names):
        items, with_ = (names[i + 1 :], p[i + 1 :]) if others is None else (others["source"].tolist(), q)
        values = divergence(with_, p[i]).sum(axis=1).tolist() if items else []
        out += [(lang, source, item, v) for item, v in zip(items, values)]
        out += [(lang, item, source, v) for item, v in zip(items, values)]
    return pd.DataFrame(out, columns=["lang", "source", "item", "value"])


def rounds(seats: int) -> list[dict[int, int]]:
    """The rounds of a round-robin tournament of an even number of seats: visiting seat -> host."""
    turn, out = seats - 1, []
    for r in range(turn):
        pairs = [(turn, r)] + [((r + i) % turn, (r - i) % turn) for i in range(1, seats // 2)]
        out.append(dict(pairs if r % 2 else [(b, a) for a, b in pairs]))
    return out


def _best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best terms of each group that this task sees: a heap a group, passed on when there are very many groups."""
    heaps: dict[tuple, list] = {}

    def rows() -> pd.DataFrame:
        return pd.DataFrame([(lang, source, t, -v) for (lang, source), h in heaps.items() for v, t in h], columns=["lang", "source", "item", "value"])

    for pdf in batches:
        p = share(pdf["n"].to_numpy(np.int64), (pdf["in_group"] + 2 * pdf["kept"]).to_numpy(np.int64))
        q = share(pdf["total"].to_numpy(np.int64), (pdf["in_lang"] + 2 * pdf["kept"]).to_numpy(np.int64))
        more = p > q
        found = pdf.loc[more, ["lang", "source", "term"]].assign(value=-divergence(p[more], q[more]))
        for key, part in found.groupby(["lang", "source"], sort=False):
            heaps[key] = heapq.nsmallest(TERM_RANKS, [*heaps.get(key, []), *zip(part["value"].tolist(), part["term"].tolist())])
        if len(heaps) > HELD_TERMS // TERM_RANKS:
            yield rows()
            heaps.clear()
    yield rows()


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, part, item, value and rank (from 1): parts `pair` and `term` of each (lang, source) group of ``docs``.

    Null text, lang and source count as ''; every row is a document, repeated ones too. Terms
    are runs of letters and of characters beyond ASCII, only A-Z lower-cased; a language keeps
    those in at least ``least_docs`` of its documents. A group without terms has shares too. A
    language with one source has no pairs; where no term is kept all pairs have the value 0.
    An empty table gives no row; other columns are not read. Exact for languages of fewer
    than 9e15 kept occurrences.
    """
    spark = docs.sparkSession
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], null_safe_text().alias("_text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counted = cut(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    groups = counted.where("term is null").select("lang", "source")
    kept = counted.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "term", "total")
    # one row a language; joined by Spark as its size allows
    wide = groups.groupBy("lang").agg(F.count("*").alias("sources"))
    langs = wide.join(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("in_lang")), "lang", "left").na.fill(0, ["kept", "in_lang"])
    slice_terms = F.greatest(F.lit(1), F.floor(F.lit(CELLS) / (2 * F.ceil(F.col("sources") / SEATS))))
    langs = cut(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") / slice_terms))))
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    place = Window.partitionBy("lang", "shard").orderBy("term")  # a shard's terms, about CELLS at most
    numbered = cut(kept.join(langs.select("lang", "shards"), "lang").withColumn("shard", shard).withColumn("pos", F.row_number().over(place) - 1).drop("shards"))
    counts = cut(counted.where("source is not null and n > 0").select("lang", "source", "term", "n").join(numbered, ["lang", "term"]))
    in_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    groups = cut(groups.join(in_group, ["lang", "source"], "left").na.fill(0, ["in_group"]).join(langs.select("lang", "kept", "in_lang", "shards"), "lang"))

    sizes = numbered.groupBy("lang", "shard").agg(F.count("*").cast("int").alias("size"))
    slices = counts.groupBy("lang", "source", "shard").agg(F.collect_list(F.struct("pos", "n")).alias("c"))  # a shard's terms at most
    every = groups.select("lang", "source", "in_group", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    every = every.join(slices, ["lang", "source", "shard"], "left").join(sizes, ["lang", "shard"], "left").na.fill(0, ["size"])
    seated = every.select("lang", "shard", F.pmod(F.xxhash64("source"), F.lit(SEATS)).cast("int").alias("seat"), "source", "in_group", "kept", "size", F.col("c.pos").alias("pos"), F.col("c.n").alias("n"))
    seated = seated.mapInPandas(_packed, "lang string, shard long, seat int, source string, in_group long, kept long, size int, blob binary")
    parts, seat = int(spark.conf.get("spark.sql.shuffle.partitions")), ["lang", "shard", "seat"]
    name = f"seats_{uuid.uuid4().hex}"
    seated.repartition(parts, *seat).write.bucketBy(parts, *seat).option("path", shared_dir(spark)).option("compression", "none").saveAsTable(name)
    residents = spark.table(name)

    made = "lang string, source string, item string, value long"
    met = residents.groupBy(*seat).applyInPandas(_home, made)
    for visits in rounds(SEATS):
        hosts = F.element_at(F.create_map(*[F.lit(x) for pair in visits.items() for x in pair]), F.col("seat"))
        visitors = residents.where(F.col("seat").isin(list(visits))).withColumn("seat", hosts)
        stay = residents.where(F.col("seat").isin(list(visits.values())))
        met = met.unionByName(stay.groupBy(*seat).cogroup(visitors.groupBy(*seat)).applyInPandas(_meeting, made))
    pairs = met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    told = counts.join(groups.drop("shards"), ["lang", "source"]).select("lang", "source", "term", "n", "total", "in_group", "in_lang", "kept")
    best = told.mapInPandas(_best, made).withColumn("part", F.lit("term"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")  # a group's peers, or the heaps' short lists
    ranked = pairs.unionByName(best).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= TERM_RANKS)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT lang, source, doc, term, count(*) AS n FROM (SELECT lang, source, doc, unnest(w) AS term FROM d) GROUP BY ALL),
k AS (SELECT lang, term, sum(n) AS total FROM o GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT o.lang, o.source, o.term, sum(n) AS n FROM o JOIN k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n, CAST(1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + (1000000000 * (k.total + 2)) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang LEFT JOIN s ON g.lang = s.lang AND g.source = s.source LEFT JOIN c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank FROM z WHERE part = 'pair' OR rank <= 10
"""
