"""Benchmark decontamination with a positional inverted index.

While the test items are small (BROADCAST_BYTES, which is checked), their windows travel to
the documents, which are the shards of the index: each task stores the positions of every
test term of its documents, takes for each test window the term with the shortest list
in the shard, and intersects its list, shifted by the term's offset, with the lists of
the other terms from the rarest up. What remains are exact phrase occurrences.

Beyond that size nothing is collected or broadcast: the postings of all documents are stored as a table
keyed by term, each window meets the postings of its rarest term of all documents by a
join, which Spark splits where a term is hot, and the places that are left are read in their documents.
Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, null_safe_text, with_columns

WINDOW = 13
#: Text bytes of test items that are broadcast; larger ones are joined by term.
BROADCAST_BYTES = 16_000_000
#: Different words that a task counts before it passes them on.
HELD_WORDS = 500_000
#: Word bytes are digits, letters (A-Z lower-cased) and all bytes from 0x80; others separate.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PAD = -2


def words(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


class TestWindows:
    """The distinct windows of test items: a matrix of term ids, filled up with -1, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.vocabulary, seen = _Vocabulary(), {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for i in range(max(1, len(ids) - window + 1) if ids else 0):
                seen.setdefault(tuple(ids[i : i + window]), {})[item_id] = None
        self.items = [list(x) for x in seen.values()]
        self.lengths = np.array([len(k) for k in seen], dtype=np.int64)
        self.terms = np.full((len(seen), window), -1, dtype=np.int64)
        for i, k in enumerate(seen):
            self.terms[i, : len(k)] = k


def search(docs: list[list[bytes]], test: TestWindows, near: int | None = None, everywhere: dict[bytes, int] | None = None):
    """Exact occurrences in a shard: (start, window) arrays in positions of the joined
    documents, the documents' starts, and, if ``near`` is given, windows whose three
    rarest terms occur within that many words of the rarest: (position, window) arrays.
    ``everywhere`` says how often a term occurs in all documents; without it terms are as rare as in this shard."""
    width = test.terms.shape[1] if test.terms.size else 1
    pad = max(width, 1)
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    starts = pad + np.concatenate([[0], np.cumsum(lengths + pad)[:-1]]).astype(np.int64) if len(docs) else np.zeros(0, np.int64)
    ids = np.full(int(lengths.sum() + pad * (len(docs) + 1)), _PAD, dtype=np.int64)
    get = test.vocabulary.__getitem__
    for d, s in zip(docs, starts):
        ids[s : s + len(d)] = np.fromiter(map(get, d), dtype=np.int64, count=len(d))
    none = np.zeros(0, np.int64)
    if not len(test.terms):
        return none, none, starts, (none, none)
    at = np.flatnonzero(ids >= 0)
    order = at[np.argsort(ids[at], kind="stable")]  # the postings, list by list
    count = np.bincount(ids[at], minlength=len(test.vocabulary))
    offset = np.concatenate([[0], np.cumsum(count)])
    size = np.where(test.terms >= 0, count[np.maximum(test.terms, 0)], np.iinfo(np.int64).max)
    alive = np.flatnonzero((size > 0).all(axis=1))
    if everywhere is not None:
        whole = np.array([everywhere.get(w, 0) for w in test.vocabulary] or [0], dtype=np.int64)
        size = np.where(test.terms >= 0, whole[np.maximum(test.terms, 0)], np.iinfo(np.int64).max)
    by_rarity = np.argsort(size[alive], axis=1, kind="stable")
    rarest = test.terms[alive, by_rarity[:, 0]]
    n = count[rarest]
    which = np.repeat(np.arange(len(alive)), n)
    found = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offset[rarest], n)]
    close = (none, none)
    if near is not None:
        ok, composite = np.ones(len(found), dtype=bool), ids[order] * len(ids) + order
        doc_of = np.searchsorted(starts, found, side="right")
        for j in range(1, min(3, width)):
            term = test.terms[alive, by_rarity[:, j]][which]
            right = np.searchsorted(composite, np.maximum(term, 0) * len(ids) + found)
            hit = np.zeros(len(found), dtype=bool)
            for k in (right - 1, right):
                p = order[np.clip(k, 0, len(order) - 1)]
                hit |= (ids[p] == term) & (np.abs(p - found) <= near) & (np.searchsorted(starts, p, side="right") == doc_of)
            ok &= hit | (term < 0)
        close = (found[ok], alive[which[ok]])
    found = found - by_rarity[which, 0]
    for j in range(1, width):
        place = by_rarity[which, j]
        term = test.terms[alive[which], place]
        keep = (term < 0) | (ids[found + place] == term)
        found, which = found[keep], which[keep]
    return found, alive[which], starts, close


_ADDED = "n_words long, hit_starts array<int>, hit_ends array<int>, items array<string>"


def _joined(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def _hits(docs: list[list[bytes]], windows: TestWindows, near: int | None, everywhere: dict[bytes, int] | None) -> list[tuple]:
    """Of each document its words, its runs of hit words, and the items whose windows occur (and are near)."""
    spans, items, beside = ([[] for _ in docs] for _ in range(3))
    found, which, starts, close = search(docs, windows, near, everywhere)
    doc = np.searchsorted(starts, found, side="right") - 1
    for d, f, w in zip(doc.tolist(), (found - starts[doc]).tolist(), which.tolist()):
        items[d] += windows.items[w]
        spans[d].append((f, f + int(windows.lengths[w])))
    for d, w in zip((np.searchsorted(starts, close[0], side="right") - 1).tolist(), close[1].tolist()):
        beside[d] += windows.items[w]
    runs = [_joined(x) for x in spans]
    return [(len(d), [x[0] for x in r], [x[1] for x in r], sorted(set(i)), sorted(set(n))) for d, r, i, n in zip(docs, runs, items, beside)]


def _broadcast(docs: DataFrame, tests: DataFrame, window: int, near: int | None, text: str, keep_text: bool) -> DataFrame:
    spark = docs.sparkSession
    windows = TestWindows([tuple(r) for r in tests.collect()], window)  # BROADCAST_BYTES at most
    everywhere = None
    if near is not None:
        known = spark.createDataFrame([(w,) for w in windows.vocabulary], "term binary")
        everywhere = {bytes(r["term"]): r["n"] for r in _term_counts(docs, text).join(known, "term", "left_semi").collect()}  # as many as the items' words
    shared = spark.sparkContext.broadcast(pickle.dumps((windows, everywhere)))

    def make():
        known, whole = pickle.loads(shared.value)
        return lambda texts: [list(c) for c in zip(*_hits([words(t) for t in texts], known, near, whole))][: 4 + (near is not None)]

    return with_columns(docs, text, _ADDED + ", near_items array<string>" * (near is not None), make, keep_text=keep_text)


# -- the stored index ----------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found.update(words(text))
            if len(found) > HELD_WORDS:
                yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})
                found.clear()
    yield pa.RecordBatch.from_pydict({"term": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})


def _term_counts(docs: DataFrame, text: str) -> DataFrame:
    """(term, n) of all documents."""
    return docs.select(null_safe_text(text).alias("_text")).mapInArrow(_counted, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _windows(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """item_id and text -> key (of the words), item_id and the words of each distinct window of an item."""
        for batch in batches:
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                w = words(text)
                seen = {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else set()
                keys = [hashlib.blake2b(b" ".join(x), digest_size=16).digest() for x in seen]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "item_id": pa.array([item] * len(seen), pa.string()), "words": pa.array([list(x) for x in seen], pa.list_(pa.binary()))})

    return rows


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row and _text -> one row for each different word of a document, with its places."""
    for batch in batches:
        for row, text in zip(batch.column("row").to_pylist(), batch.column("_text").to_pylist()):
            places: dict[bytes, list[int]] = {}
            for i, w in enumerate(words(text)):
                places.setdefault(w, []).append(i)
            yield pa.RecordBatch.from_pydict({"term": pa.array(list(places), pa.binary()), "row": pa.array([row] * len(places), pa.int64()), "places": pa.array(list(places.values()), pa.list_(pa.int32()))})


def _read(window: int, near: int | None):
    """A document and its candidates (key, rare, offset, words, place of the rarest) -> what occurs."""

    def found(docs: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row, text in zip(docs["row"], docs["_text"]):
            w = words(text)
            at: dict[bytes, np.ndarray] = {}
            for key, rare, offset, phrase, places in zip(candidates["key"], candidates["rare"], candidates["offset"], candidates["words"], candidates["places"]):
                phrase = [bytes(x) for x in phrase]
                starts = [p - offset for p in places if p >= offset and w[p - offset : p - offset + len(phrase)] == phrase]
                close = False
                if near is not None:
                    ok = np.ones(len(places), dtype=bool)
                    for term in rare[1:3]:
                        if term not in at:
                            at[term] = np.array([i for i, x in enumerate(w) if x == term], dtype=np.int64)
                        ok &= (np.abs(at[term][None, :] - np.asarray(places)[:, None]) <= near).any(axis=1)
                    close = bool(ok.any())
                if starts or close:
                    out.append((row, key, starts, len(phrase), close))
        return pd.DataFrame(out, columns=["row", "key", "starts", "size", "close"])

    return found


def _by_term(docs: DataFrame, tests: DataFrame, window: int, near: int | None, text: str, keep_text: bool) -> DataFrame:
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    texts = rows.select(F.col("__row").alias("row"), null_safe_text(text).alias("_text"))
    each = cut(tests.mapInArrow(_windows(window), "key binary, item_id string, words array<binary>"))
    windows = each.groupBy("key").agg(F.any_value("words").alias("words"))
    terms = windows.select("key", F.posexplode("words").alias("offset", "term")).join(_term_counts(docs, text), "term")
    # a window none of whose words is missing, by its rarest words, the first of equal ones
    rare = terms.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))), 1, window).alias("rare"))  # a window's words
    chosen = windows.join(rare, "key").where(F.size("rare") == F.size("words"))
    chosen = cut(chosen.select("key", "words", F.col("rare")[0]["term"].alias("term"), F.col("rare")[0]["offset"].alias("offset"), F.slice(F.col("rare.term"), 1, 3).alias("rare")))
    index = texts.mapInArrow(_postings, "term binary, row long, places array<int>").join(chosen.select("term").distinct(), "term", "left_semi")
    candidates = index.join(chosen, "term").select("row", "key", "rare", "offset", "words", "places")
    read = texts.groupBy("row").cogroup(candidates.groupBy("row")).applyInPandas(_read(window, near), "row long, key binary, starts array<int>, size int, close boolean")
    read = cut(read)

    def names(which: str, name: str) -> DataFrame:
        return read.where(which).select("row", "key").join(each.select("key", "item_id"), "key").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias(name))  # a document's items

    spans = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("size")).alias("e")))
    hits = read.where("size(starts) > 0").groupBy("row").agg(F.array_sort(F.flatten(F.collect_list(spans))).alias("spans"))  # a document's own words
    empty = F.expr("cast(array() as array<string>)")
    out = rows.join(hits, F.col("__row") == F.col("row"), "left").drop("row").join(names("size(starts) > 0", "items"), F.col("__row") == F.col("row"), "left").drop("row")
    if near is not None:
        out = out.join(names("close", "near_items"), F.col("__row") == F.col("row"), "left").drop("row")

    def make():
        return lambda found: [[len(words(t)) for t in found]]

    kept = with_columns(out, text, "n_words long", make, keep_text=keep_text)
    merged = kept.withColumn("spans", F.coalesce("spans", F.expr("cast(array() as array<struct<s: int, e: int>>)")))
    # sorted spans become runs: a span that begins within the run before it lengthens that
    start = F.expr("cast(array() as array<struct<s: int, e: int>>)")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    grow = lambda a, x: F.when(
        (F.size(a) > 0) & (x["s"] <= last(a)["e"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(last(a)["s"].alias("s"), F.greatest(last(a)["e"], x["e"]).alias("e"))))
    ).otherwise(F.concat(a, F.array(x)))
    merged = merged.withColumn("spans", F.aggregate("spans", start, grow))
    merged = merged.withColumns({"hit_starts": F.col("spans.s"), "hit_ends": F.col("spans.e"), "items": F.coalesce("items", empty)})
    if near is not None:
        merged = merged.withColumn("near_items", F.coalesce("near_items", empty))
    return merged.drop("__row", "spans")


def find_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int | None = None, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add n_words, n_hit, hit_starts and hit_ends (maximal runs of hit words), items,
    n_items and contaminated to ``docs``; ``near`` adds near_items, items with a window
    whose three rarest terms (of all documents; the first of equal ones) stand within that many words of the rarest.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not
    none, is one window. A document is contaminated if n_hit > 0 and 20 n_hit >= n_words.
    Null texts have no words; a null item_id counts as ''; repeated items count once. An
    empty table of items hits nothing. Columns of the names above are replaced.
    """
    tests = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), null_safe_text().alias("text")).distinct()
    docs = docs.drop("near_items", "n_hit", "n_items", "contaminated", "n_words", "hit_starts", "hit_ends", "items")
    small = (tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES
    got = (_broadcast if small else _by_term)(docs, tests, window, near, text, keep_text)
    hit = F.aggregate(F.zip_with("hit_starts", "hit_ends", lambda s, e: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    got = got.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    return got.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
t AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
      FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
o AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM t) AS l, unnest(range(1, len(w) - n + 2)) AS u(i)),
m AS (SELECT DISTINCT doc_id, i, o.n, item_id FROM o JOIN t ON o.g = t.g AND o.n = t.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS u(p) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""
