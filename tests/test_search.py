"""Stems, hashing and queries that have no SQL."""

import math

from pyspark.sql import functions as F

from tidewell.functions import stem
from tidewell.functions import text as T
from tidewell.operators import search
from tidewell.sources.corpus import corpus

SF = "/root/testdata/sf0.001"


def test_porter_stems():
    pairs = "caresses:caress ponies:poni cats:cat agreed:agre plastered:plaster motoring:motor conflated:conflat troubled:troubl hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit vietnamization:vietnam differently:differ vileness:vile analogousli:analog sensibiliti:sensibl triplicate:triplic formative:form electrical:electr hopeful:hope revival:reviv allowance:allow adjustment:adjust adoption:adopt effective:effect probate:probat rate:rate cease:ceas controll:control roll:roll is:is"
    for word, want in (p.split(":") for p in pairs.split()):
        assert stem.porter_stem(word) == want, word


def test_fnv_and_hash_embedding(spark):
    assert stem.fnv1a64(b"") == 0xCBF29CE484222325 and stem.fnv1a64(b"a") == 0xAF63DC4C8601EC8C
    df = spark.createDataFrame([(1, "b a b"), (2, ""), (3, None)], "id int, text string").select("id", search.hash_embed(T.tokens(F.col("text")), 64).alias("e"))
    got = {r.id: list(r.e) for r in df.collect()}
    want = [0.0] * 64
    for w in ("b", "a", "b"):
        h = stem.fnv1a64(w.encode())
        want[(h >> 1) % 64] += 1 if h & 1 else -1
    norm = math.sqrt(sum(x * x for x in want))
    assert got[1] == [x / norm for x in want] and got[2] == got[3] == [0.0] * 64


def test_stemmed_bm25_is_bm25_over_stems(spark):
    rows = corpus(spark, SF).select("chunk_id", *search.FIELDS)
    terms = ["licensing", "ands"]
    stems = sorted({stem.porter_stem(t) for t in terms})
    got = {r.chunk_id: r.score for r in search.bm25_many(rows, {0: stems}, variants=search.stem_variants(rows, terms)).collect()}
    docs = {r.chunk_id: [(stem.porter_stem(t), w) for f, w in search.FIELDS.items() for t in words(r[f])] for r in rows.collect()}
    mean = sum(map(len, docs.values())) / len(docs)
    want = {}
    for t in stems:
        tf = {i: sum(w for s, w in d if s == t) for i, d in docs.items()}
        df = sum(v > 0 for v in tf.values())
        for i, f in tf.items():
            if f:
                want[i] = want.get(i, 0) + max(1e-6, math.log((len(docs) - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean))
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


def words(text):
    import re

    return re.findall(r"[^\W_]+", (text or "").lower())
