"""Full-text matching, BM25, vector search and rank fusion as DataFrame plans."""

from __future__ import annotations

import datetime
import functools
import operator
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window

from ..functions.stem import fnv1a64, porter, porter_stem
from ..functions.text import jaccard, tokens, trigrams
from ..session import cut

K1, B, RRF_K = 1.2, 0.75, 60
#: Weight of an occurrence in each field.
FIELDS = {"path": 3.0, "title": 10.0, "summary": 5.0, "tag_text": 4.0, "content": 1.0}


def fields_of(rows: DataFrame, fields: dict[str, float] = FIELDS) -> dict[str, float]:
    """The fields that ``rows`` has, with their weights."""
    return {f: w for f, w in fields.items() if f in rows.columns}


def postings(rows: DataFrame, fields: dict[str, float] = FIELDS, terms: list[str] | None = None) -> DataFrame:
    """(chunk_id, field, weight, pos, term) of every token, or of ``terms`` only; the filter runs inside the explode's stage."""

    def part(f: str, w: float) -> Column:
        return F.transform(tokens(F.col(f)), lambda t, i: F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight"), i.alias("pos"), t.alias("term")))

    parts = [part(f, w) for f, w in fields_of(rows, fields).items()]
    out = rows.select("chunk_id", F.inline(F.concat(*parts)))
    return out.where(F.col("term").isin(terms)) if terms is not None else out


def match(rows: DataFrame, must: list[str] = (), any_of: list[str] = (), must_not: list[str] = ()) -> DataFrame:
    """Rows with all of ``must``, one of ``any_of`` if there are any, and none of ``must_not``, in any field."""
    have = F.array_distinct(F.flatten(F.array(*[tokens(F.col(f)) for f in fields_of(rows)])))
    lits = lambda ts: F.array(*[F.lit(t) for t in ts])
    tests = [F.array_contains(have, t) for t in must]
    if any_of:
        tests.append(F.arrays_overlap(have, lits(any_of)))
    if must_not:
        tests.append(~F.arrays_overlap(have, lits(must_not)))
    return rows.where(functools.reduce(operator.and_, tests)) if tests else rows


def phrase(rows: DataFrame, words: list[str], fields: dict[str, float] = FIELDS) -> DataFrame:
    """Rows where the words stand next to each other in one field."""
    space = lambda c: F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))
    return rows.where(functools.reduce(operator.or_, [space(F.col(f)).contains(f" {' '.join(words)} ") for f in fields_of(rows, fields)]))


def prefix(rows: DataFrame, start: str) -> DataFrame:
    return rows.where(functools.reduce(operator.or_, [F.exists(tokens(F.col(f)), lambda t: t.startswith(start)) for f in fields_of(rows)]))


def bm25_many(rows: DataFrame, queries: dict[int, list[str]], fields: dict[str, float] = FIELDS, variants: DataFrame | None = None) -> DataFrame:
    """(query_no, chunk_id, score) of the rows that hold any term of a query; higher is better.

    All queries share two passes over ``rows``: one counts rows and tokens, the other
    gathers the occurrences of all their terms; only those are shuffled. The inverse
    document frequency is floored at 1e-6. ``variants`` (token, term) maps tokens to the
    terms they stand for, such as stems; it is few rows, which are broadcast, so that
    other tokens are not shuffled. Without it tokens are terms.
    """
    fields = fields_of(rows, fields)
    terms = sorted({t for q in queries.values() for t in q})
    wanted = rows.sparkSession.createDataFrame([(n, t) for n, q in queries.items() for t in sorted(set(q))], "query_no int, term string")
    toks = rows.select("chunk_id", *[tokens(F.col(f)).alias(f) for f in fields])
    length = functools.reduce(operator.add, [F.size(f) for f in fields])
    stats = toks.agg(F.count("*").alias("n_rows"), F.avg(length).alias("avg_len"))  # one row

    def part(f: str, w: float) -> Column:
        own = F.filter(f, lambda t: t.isin(terms)) if variants is None else F.col(f)
        return F.transform(own, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    found = toks.select("chunk_id", length.alias("len"), F.inline(F.concat(*[part(f, w) for f, w in fields.items()])))
    if variants is not None:
        found = found.withColumnRenamed("term", "token").join(F.broadcast(variants), "token")
    tf = found.groupBy("chunk_id", "len", "term").agg(F.sum("w").alias("f"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # one row for each query term
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    one = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    weights = df.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len").join(F.broadcast(wanted), "term")
    return tf.join(F.broadcast(weights), "term").groupBy("query_no", "chunk_id").agg(F.round(F.sum(F.col("idf") * one), 9).alias("score"))


#: As many (query, term) are collected and broadcast; beyond them tokens meet the terms by a join.
FEW_TERMS = 50_000
#: Most queries times terms whose scores are a product of matrices.
FEW_CELLS = 1_000_000


def bm25_table(rows: DataFrame, wanted: DataFrame, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(query_no, chunk_id, score) as bm25_many, for a table of any number of queries: ``wanted`` has a row (query_no, term) for each.

    Up to FEW_TERMS of these, rows are read once: their lengths and their occurrences of the terms are written, dealt by row, and neither other
    tokens nor (query, row) pairs are shuffled. Beyond, occurrences meet the distinct terms before they are counted.
    """
    return _scored(*_held(rows, wanted, fields))


def _held(rows: DataFrame, wanted: DataFrame, fields: dict[str, float], beside: list[str] = ()) -> tuple[DataFrame, DataFrame, bool]:
    """Rows (chunk_id, len, held: their tokens with weights, and the columns ``beside``), what is wanted, and whether this is few; if so, the rows are written and hold only wanted terms."""
    fields = fields_of(rows, fields)
    wanted = cut(wanted.select("query_no", "term").where("term is not null").distinct())
    few = len(wanted.limit(FEW_TERMS + 1).select(F.lit(1)).collect()) <= FEW_TERMS
    terms = sorted(r.term for r in wanted.select("term").distinct().collect()) if few else []
    toks = rows.select("chunk_id", *[tokens(F.col(f)).alias(f) for f in fields], *beside)
    length = functools.reduce(operator.add, [F.size(f) for f in fields])

    def part(f: str, w: float) -> Column:
        own = F.filter(f, lambda t: t.isin(terms)) if few else F.col(f)
        return F.transform(own, lambda t: F.struct(t.alias("term"), F.lit(w).alias("w")))

    held = toks.select("chunk_id", length.alias("len"), F.concat(*[part(f, w) for f, w in fields.items()]).alias("held"), *beside)
    return (cut(held) if few else held), wanted, few


def _idf(held: DataFrame, df: DataFrame) -> DataFrame:
    """(term, idf, avg_len) of document frequencies (term, df)."""
    stats = held.agg(F.count("*").alias("n_rows"), F.avg("len").alias("avg_len"))  # one row
    idf = F.greatest(F.lit(1e-6), F.log((F.col("n_rows") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    return df.join(F.broadcast(stats)).select("term", idf.alias("idf"), "avg_len")


def _scored(held: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    if few:
        found = held.where(F.size("held") > 0).repartition("chunk_id").select("chunk_id", "len", F.inline("held"))
    else:
        found = held.select("chunk_id", "len", F.inline("held")).join(wanted.select("term").distinct(), "term")
    tf = found.groupBy("chunk_id", "len", "term").agg(F.sum("w").alias("f"))
    weights = _idf(held, tf.groupBy("term").agg(F.count("*").alias("df"))).join(F.broadcast(wanted) if few else wanted, "term")
    one = F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return tf.join(F.broadcast(weights) if few else weights, "term").groupBy("query_no", "chunk_id").agg(F.round(F.sum(F.col("idf") * one), 9).alias("score"))


def bm25_best(rows: DataFrame, wanted: DataFrame, k: int, fields: dict[str, float] = FIELDS) -> DataFrame:
    """(query_no, chunk_id, score, rank): the best ``k`` of each query, as best_of_each of bm25_table.

    Where queries times terms are at most FEW_CELLS and no chunk_id repeats or is null, each task scores its rows as a matrix product and gives k rows a query.
    """
    return best_held(*_held(rows, wanted, fields), k)


def best_held(held: DataFrame, wanted: DataFrame, few: bool, k: int, until: DataFrame | None = None) -> DataFrame:
    """bm25_best of rows that _held gave, for those (query_no, term) that are ``wanted`` of them.

    The queries of ``until`` (query_no, day: one row each) find only rows that are ``modified`` no later than their day; all rows count for the frequencies.
    """
    asks = wanted.collect() if few else []  # FEW_TERMS at most
    queries, terms = sorted({r.query_no for r in asks}), sorted({r.term for r in asks})
    if not few or len(queries) * len(terms) > FEW_CELLS or not held.groupBy("chunk_id").count().where("count > 1 or chunk_id is null").isEmpty():
        scored = _scored(held, wanted, few)
        if until is not None:
            dated = scored.join(held.select("chunk_id", "modified"), "chunk_id").join(until.withColumn("_bound", F.lit(True)), "query_no", "left")
            scored = dated.where(F.col("_bound").isNull() | (F.col("modified") <= F.col("day"))).select(scored.columns)
        return best_of_each(scored, k)
    days = F.datediff("modified", F.lit("1970-01-01").cast("date")).cast("double") if until is not None else F.lit(0.0)
    last = {r.query_no: np.nan if r.day is None else (r.day - datetime.date(1970, 1, 1)).days for r in until.collect()} if until is not None else {}  # one row a query
    some = held.where(F.size("held") > 0)
    df = some.select(F.explode(F.array_distinct(F.transform("held", lambda x: x["term"]))).alias("term")).where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("df"))
    known = _idf(held, df).collect()
    idf, avg_len = np.zeros(len(terms)), known[0].avg_len if known else 1.0
    idf[[terms.index(r.term) for r in known]] = [r.idf for r in known]
    asked = np.zeros((len(terms), len(queries)))
    asked[[terms.index(r.term) for r in asks], [queries.index(r.query_no) for r in asks]] = 1.0
    step = max(1, 4_000_000 // max(1, len(terms)))  # rows that are scored at once

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [(np.zeros(0), np.zeros(0, dtype=np.int64)) for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, held = part.column(0).to_numpy(zero_copy_only=False), part.column(2)
                flat, sizes = held.flatten(), pc.list_value_length(held).to_numpy(zero_copy_only=False)
                at_term = pc.fill_null(pc.index_in(flat.field(0), value_set=pa.array(terms, pa.string())), -1).to_numpy(zero_copy_only=False)
                mine = at_term >= 0  # rows may hold terms of other queries
                cell = np.repeat(np.arange(len(ids)), sizes)[mine] * len(terms) + at_term[mine]
                f = np.bincount(cell, flat.field(1).to_numpy(zero_copy_only=False)[mine], len(ids) * len(terms)).reshape(len(ids), len(terms))
                day = part.column(3).to_numpy(zero_copy_only=False)  # of rows without one: nan
                own = K1 * (1 - B + B * part.column(1).to_numpy(zero_copy_only=False) / avg_len)
                scores = (idf * (f * (K1 + 1) / (f + own[:, None]))) @ asked
                for q in range(len(queries)):
                    s, i = top[q]
                    ok = day <= last[queries[q]] if queries[q] in last else True
                    new = np.flatnonzero(ok & (scores[:, q] > 0) & (scores[:, q] >= (s[-1] - 1e-8 if len(s) == k else 0)))
                    if len(new):
                        s, i = np.concatenate([s, np.round(scores[new, q], 9)]), np.concatenate([i, ids[new]])
                        order = np.lexsort((i, -s))[:k]
                        top[q] = s[order], i[order]
        for q, (s, i) in zip(queries, top):
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(s), numbers), pa.array(i, pa.int64()), pa.array(s)], names=["query_no", "chunk_id", "score"])

    kind = wanted.schema["query_no"].dataType
    numbers = pa.int32() if kind.simpleString() == "int" else pa.int64()
    scored = some.select(F.col("chunk_id").cast("long").alias("chunk_id"), "len", "held", days.alias("days")).mapInArrow(best, f"query_no {kind.simpleString()}, chunk_id long, score double")
    return best_of_each(scored, k)


#: Weights of the fields whose positions make a cover, in their order.
COVER_FIELDS = {"title": 1.0, "summary": 0.4, "tag_text": 0.2, "content": 0.1}


def cover_density(rows: DataFrame, wanted: DataFrame, fields: dict[str, float] = COVER_FIELDS) -> DataFrame:
    """(query_no, chunk_id, covers, score) of the rows that hold all terms of a query; ``wanted`` has a row (query_no, term) for each.

    A cover is a shortest run of a row's words (all fields in order) that holds all of the query's terms. It adds the harmonic mean of its
    term occurrences' weights, over one more than the number of its other words. Only occurrences of query terms are shuffled; the places
    that a row has of a query's terms are swept once, in order. Queries without terms, and null texts, find nothing.
    """
    fields = fields_of(rows, fields)
    wanted = wanted.select("query_no", "term").distinct()
    needed = wanted.groupBy("query_no").agg(F.array_sort(F.collect_set("term")).alias("terms"))  # a query's terms
    toks = rows.select("chunk_id", *[tokens(F.col(f)).alias(f) for f in fields])

    def part(f: str, w: float, before: list[str]) -> Column:
        shift = functools.reduce(operator.add, [F.size(b) for b in before], F.lit(0))
        return F.transform(f, lambda t, i: F.struct(t.alias("term"), (i + shift).alias("at"), F.lit(1 / w).alias("inverse")))

    every = F.concat(*[part(f, w, list(fields)[:n]) for n, (f, w) in enumerate(fields.items())])
    found = toks.select("chunk_id", F.inline(every)).join(wanted, "term")
    places = found.groupBy("query_no", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("at", "term", "inverse"))).alias("p"), F.count_distinct("term").alias("n"))  # a row's own words
    places = places.join(needed, "query_no").where(F.col("n") == F.size("terms"))
    # seen: for each term the last place so far, as a number in p (-1: none); begun: where the last cover began
    start = F.struct(F.transform("terms", lambda t: F.lit(-1)).alias("seen"), F.lit(-1).alias("begun"), F.lit(0).alias("i"), F.lit(0).alias("covers"), F.lit(0.0).alias("score"))

    def step(a: Column, x: Column) -> Column:
        seen = F.zip_with(a["seen"], "terms", lambda s, t: F.when(t == x["term"], a["i"]).otherwise(s))
        low = F.array_min(seen)
        size = a["i"] - low
        noise = x["at"] - F.element_at("p", F.greatest(low, F.lit(0)) + 1)["at"] - size
        weights = F.aggregate(F.slice("p", F.greatest(low, F.lit(0)) + 1, size + 1), F.lit(0.0), lambda s, y: s + y["inverse"])
        new = (low >= 0) & (low > a["begun"])
        gain = F.when(new, (size + 1) / weights / (1 + noise)).otherwise(0.0)
        return F.struct(seen.alias("seen"), F.when(new, low).otherwise(a["begun"]).alias("begun"), (a["i"] + 1).alias("i"), (a["covers"] + new.cast("int")).alias("covers"), (a["score"] + gain).alias("score"))

    swept = places.select("query_no", "chunk_id", F.aggregate("p", start, step).alias("r"))
    return swept.select("query_no", "chunk_id", F.col("r.covers").alias("covers"), F.round("r.score", 9).alias("score"))


def bm25(rows: DataFrame, terms: list[str], fields: dict[str, float] = FIELDS) -> DataFrame:
    """(chunk_id, score) of the rows that hold any of ``terms``; higher is better."""
    return bm25_many(rows, {0: terms}, fields).drop("query_no")


def stem_variants(rows: DataFrame, terms: list[str], fields: dict[str, float] = FIELDS) -> DataFrame:
    """(token, term): the distinct tokens of ``rows`` whose Porter stem is that of a term, with the stem.

    The stemmer changes no more than a word's end: all but the last two letters of a stem begin its words. Other tokens go before any is set apart.
    What is found is written, as a filter by the stem would else move into the joins that it serves, to every token beside its row.
    """
    stems = sorted({porter_stem(t) for t in terms})
    begins = lambda t: functools.reduce(operator.or_, [t.startswith(s[:-2]) for s in stems], F.lit(False))
    every = F.flatten(F.array(*[F.filter(tokens(F.col(f)), begins) for f in fields_of(rows, fields)]))
    vocabulary = rows.select(F.explode(F.array_distinct(every)).alias("token")).distinct()
    return cut(vocabulary.withColumn("term", porter(F.col("token"))).where(F.col("term").isin(stems)))


def best_of_each(scored: DataFrame, k: int, group: str = "query_no", key: str = "chunk_id") -> DataFrame:
    """The best ``k`` of each query with ranks from 1, ties to the smaller key; Spark keeps k rows a group before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fanout(rows: DataFrame, queries: dict[int, list[str]], k: int = 10) -> DataFrame:
    """(list_no, chunk_id, score, rank): the best ``k`` of every query, from one pass for all."""
    return best_of_each(bm25_many(rows, queries), k).withColumnRenamed("query_no", "list_no")


def admitted(lists: DataFrame, queries: dict[int, list[str]], primary: int = 0) -> DataFrame:
    """The primary list and those others that may join it: where the primary is empty, where the query has a digit
    or two to four terms, or where two of its best ten are in the primary's. Sizes are those of a query's lists."""
    first = lists.where(F.col("list_no") == primary).select("chunk_id", F.lit(1).alias("_in"))
    beside = lists.join(first, "chunk_id", "left").groupBy("list_no").agg(F.count("_in").alias("overlap"))
    plain = [n for n, q in queries.items() if n == primary or 2 <= len(q) <= 4 or any(c.isdigit() for t in q for c in t)]
    none = lists.where(F.col("list_no") == primary).agg((F.count("*") == 0).alias("none"))
    ok = beside.join(F.broadcast(none)).where(F.col("list_no").isin(plain) | (F.col("overlap") >= 2) | F.col("none")).select("list_no")
    return lists.join(ok, "list_no", "left_semi")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in one pass over both; 0 where one has no length. What one has beyond the other's length makes it null."""
    pairs = F.zip_with(a, b, lambda p, q: F.struct(p.cast("double").alias("p"), q.cast("double").alias("q")))
    start = F.struct(F.lit(0.0).alias("pq"), F.lit(0.0).alias("pp"), F.lit(0.0).alias("qq"))
    sums = F.aggregate(pairs, start, lambda s, x: F.struct((s["pq"] + x["p"] * x["q"]).alias("pq"), (s["pp"] + x["p"] * x["p"]).alias("pp"), (s["qq"] + x["q"] * x["q"]).alias("qq")), lambda s: F.when((s["pp"] > 0) & (s["qq"] > 0), s["pq"] / F.sqrt(s["pp"]) / F.sqrt(s["qq"])).otherwise(0.0))
    return sums


def knn(vecs: DataFrame, query: list[float], k: int, allowed: DataFrame | None = None) -> DataFrame:
    """(id, similarity): exact k nearest by cosine among vectors of the query's dimension; ``allowed`` (id) filters before the top-k."""
    v = vecs.where(F.size("embedding") == len(query))
    if allowed is not None:
        v = v.join(allowed.select("id").distinct(), "id", "left_semi")
    norm = float(np.sqrt(sum(float(x) * float(x) for x in query)))
    q = F.array(*[F.lit(float(x) / norm if norm else 0.0) for x in query])  # of length one, so that a row's own length is all that is left
    pairs = F.zip_with("embedding", q, lambda p, x: F.struct(p.cast("double").alias("p"), x.alias("x")))
    start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("own"))
    near = F.aggregate(pairs, start, lambda s, y: F.struct((s["dot"] + y["p"] * y["x"]).alias("dot"), (s["own"] + y["p"] * y["p"]).alias("own")), lambda s: F.when(s["own"] > 0, s["dot"] / F.sqrt(s["own"])).otherwise(0.0))
    return v.select("id", F.round(near, 9).alias("similarity")).orderBy(F.desc("similarity"), "id").limit(k)


def vector_of(vecs: DataFrame, vec_id: int) -> list[float]:
    """A query vector by id (one row): that id's, else the next larger one's, else the smallest one's; none of an empty table."""
    row = vecs.where("embedding is not null").orderBy(F.col("id") < vec_id, "id").select("embedding").first()
    return list(row[0]) if row else []


def ranked(scored: DataFrame, k: int, by: str = "score", key: str = "chunk_id") -> DataFrame:
    """The best ``k`` with ranks from 1, ties to the smaller key: a top-k first, so that the rank window sees k rows."""
    top = scored.orderBy(F.desc(by), key).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(by), key)))


def rrf(lists: DataFrame, k: int = RRF_K, key: str = "chunk_id") -> DataFrame:
    """(key, score) of lists (list_no, rank from 1): sums of 1 / (k + rank)."""
    return lists.groupBy(key).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def hybrid(rows: DataFrame, terms: list[str], vecs: DataFrame, query: list[float], k: int = 10, candidates: int = 60) -> DataFrame:
    """Both legs' candidates joined in full and fused by reciprocal ranks."""
    words = ranked(bm25(rows, terms), candidates).select("chunk_id", F.col("rank").alias("bm25_rank"))
    near = ranked(knn(vecs, query, candidates).select(F.col("id").alias("chunk_id"), "similarity"), candidates, "similarity").select("chunk_id", F.col("rank").alias("vector_rank"))
    leg = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = words.join(near, "chunk_id", "full").withColumn("score", F.round(leg("bm25_rank") + leg("vector_rank"), 9))
    return fused.orderBy(F.desc("score"), "chunk_id").limit(k)


def fuzzy(entries: DataFrame, text: str, query: str, k: int = 10, least: float = 0.3, key: str = "chunk_id") -> DataFrame:
    """(key, similarity) by trigram Jaccard in one pass: the query's grams are a literal, and entries that share none go before any set is built."""
    mine = entries.select(key, trigrams(F.col(text)).alias("grams"), trigrams(F.lit(query)).alias("q"))
    shared = mine.where(F.arrays_overlap("grams", "q"))
    return shared.select(key, F.round(jaccard(F.col("grams"), F.col("q")), 9).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(k)


def rung(entries: DataFrame, text: str, words: list[str], k: int = 10, least: float = 0.3, key: str = "chunk_id") -> DataFrame:
    """(key, similarity) by the best trigram Jaccard similarity that any of ``words`` has with the text."""
    mine = entries.select(key, trigrams(F.col(text)).alias("grams"))
    best = F.greatest(*[jaccard(F.col("grams"), trigrams(F.lit(w))) for w in words], F.lit(0.0))
    return mine.select(key, F.round(best, 9).alias("similarity")).where(F.col("similarity") >= least).orderBy(F.desc("similarity"), key).limit(k)


def hash_embed(words: Column, dim: int = 1024) -> Column:
    """Unit vector of signed feature hashing: a word's 64-bit FNV-1a hash gives a sign (low bit) and a bucket; all zeros without words."""
    return _hash_embed(words, F.lit(dim))


@F.pandas_udf(ArrayType(DoubleType()))
def _hash_embed(words: pd.Series, dim: pd.Series) -> pd.Series:
    n = int(dim.iloc[0]) if len(dim) else 1
    out: list[np.ndarray] = []
    for a in range(0, len(words), 512):  # rows whose vectors are built at once; each different word of theirs is hashed once
        some = [list(x) if x is not None else [] for x in words.iloc[a : a + 512]]
        different, which = np.unique(np.array([w for x in some for w in x], dtype=object), return_inverse=True)
        hashes = np.array([fnv1a64(w.encode()) for w in different], dtype=np.uint64)
        place, sign = ((hashes >> np.uint64(1)) % np.uint64(n)).astype(np.int64), np.where(hashes & np.uint64(1), 1.0, -1.0)
        rows = np.zeros((len(some), n))
        np.add.at(rows, (np.repeat(np.arange(len(some)), [len(x) for x in some]), place[which]), sign[which])
        norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        out += list(np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0))
    return pd.Series(out, index=words.index)


def fallback_score(text: Column, query: str, similarity: Column) -> Column:
    """Ten for each occurrence of the whole query in the text, and the similarity if it is positive."""
    needle = query.lower()
    times = (F.length(F.lower(text)) - F.length(F.replace(F.lower(text), F.lit(needle), F.lit("")))) / len(needle)
    return F.round(10 * times + F.greatest(similarity, F.lit(0.0)), 9)


def presence_score(fields: dict[str, float], terms: list[str]) -> Column:
    """Sum over terms and fields of the field's weight where its tokens hold the term."""
    hits = [F.array_contains(tokens(F.col(f)), t).cast("double") * w for f, w in fields.items() for t in terms]
    return functools.reduce(operator.add, hits).cast("long")


def occurrence_score(fields: dict[str, float], terms: list[str]) -> Column:
    """Sum over terms and fields of the field's weight times the substring's occurrences."""

    def times(f: str, t: str) -> Column:
        text = F.lower(F.coalesce(F.col(f), F.lit("")))
        return (F.length(text) - F.length(F.replace(text, F.lit(t), F.lit("")))) / len(t)

    return functools.reduce(operator.add, [w * times(f, t) for f, w in fields.items() for t in terms]).cast("long")


def snippet(text: Column, terms: list[str], width: int = 64) -> Column:
    """``width`` words that begin a few before the first of ``terms``, each occurrence marked; cut ends show '…'."""
    words = F.split(F.trim(F.coalesce(text, F.lit(""))), r"\s+")
    hit = F.array_position(F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]+", "").isin([t.lower() for t in terms])), True)
    start = F.greatest(F.lit(1), hit - width // 4).cast("int")
    body = F.array_join(F.slice(words, start, F.lit(width)), " ")
    marked = F.regexp_replace(body, rf"(?i)(?<![\p{{L}}\p{{N}}])({'|'.join(terms)})(?![\p{{L}}\p{{N}}])", "<mark>$1</mark>")
    return F.concat(F.when(start > 1, "… ").otherwise(""), marked, F.when(F.size(words) >= start + width, " …").otherwise(""))


def knn_many(vecs: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(query_id, id, similarity, rank): the ``k`` nearest of every query by cosine, itself left out.

    Blocks of queries meet blocks of vectors, each pair in a task of its own, which gives its
    best ``k``; only these are ranked. Vectors of another dimension or without a length
    have similarity 0, and those of another dimension take no part.
    """
    deal = lambda df, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    n_v, n_q = (max(1, -(-df.count() // block)) for df in (vecs, queries))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vecs.select("id", "embedding", deal(vecs, n_v).alias("vb"), spread(n_q).alias("qb"))
    right = queries.select("id", "embedding", deal(queries, n_q).alias("qb"), spread(n_v).alias("vb"))

    def nearest(_, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size, some in q.groupby(q["embedding"].map(len)):
            mine = v[v["embedding"].map(len) == size]
            if not len(mine) or not size:
                continue
            ids = mine["id"].to_numpy()
            a, b = (np.stack(x["embedding"].to_numpy()).astype(np.float64) for x in (mine, some))
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.round(np.nan_to_num((b @ a.T) / (np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :])), 9)
            for qid, s in zip(some["id"], near):
                order = np.lexsort((ids, -s))
                order = order[ids[order] != qid][:k]
                out += [(qid, i, x) for i, x in zip(ids[order].tolist(), s[order].tolist())]
        return pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    lists = left.groupBy("vb", "qb").cogroup(right.groupBy("vb", "qb")).applyInPandas(nearest, "query_id long, id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
