import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from tidewell.llm import language_id as L

TEXTS = {"xx": ["abab abba baab ab", "aab bba"], "yy": ["cdcd dccd cd é", "ddc ccd abc"]}


def plain_bits(text, lang, order=3):
    """PPM with escape method C, byte by byte from counts in dictionaries."""
    counts = defaultdict(Counter)
    for t in TEXTS[lang]:
        data = b"\n\n\n" + t.encode()
        for i in range(3, len(data)):
            for k in range(order + 1):
                counts[data[i - k : i]][data[i]] += 1
    data, bits = b"\n\n\n" + text.encode(), 0.0
    for i in range(3, len(data)):
        for k in range(order, -2, -1):
            if k < 0:
                bits += 8
                break
            c = counts[data[i - k : i]] if data[i - k : i] in counts else None
            if not c:
                continue
            n, d = sum(c.values()), len(c)
            if data[i] in c:
                bits -= math.log2(c[data[i]] / (n + d))
                break
            bits -= math.log2(d / (n + d))
    return bits


def model():
    parts = L.fourgrams([pd.DataFrame([(k, t) for k, ts in TEXTS.items() for t in ts], columns=["lang", "_text"])])
    return L.Model(pd.concat(list(parts)).groupby(["lang", "code"], as_index=False).sum())


def test_code_lengths_are_those_of_a_plain_ppm():
    m = model()
    texts = ["abba", "", "cdd é", "zzz ab\nc", "a" * 200, "d"]
    got = m.code_lengths([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert np.allclose(row, [plain_bits(t, "xx"), plain_bits(t, "yy")], rtol=1e-5), t


def test_long_texts_in_pieces(monkeypatch):
    m = model()
    texts = [t.encode() for t in ("abba cd é" * 30, "", "cdd é", "a" * 200)]
    whole = m.code_lengths(texts)
    monkeypatch.setattr(L, "PIECE", 7)
    assert np.allclose(m.code_lengths(texts), whole, rtol=1e-6)


def test_predictions_and_edges(spark):
    rows = [(1, "abab ab", 0.5), (2, "cd cd", 0.5), (3, None, 0.5), (4, "", 0.5), (5, "123 !?", 0.5), (6, "ab ab " * 50_000, 0.5), (6, "ab ab", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = sorted((r.doc_id, r.lang_pred, round(r.score, 3)) for r in L.predict(df, model()).collect())
    assert [g[:2] for g in got] == [(1, "xx"), (2, "yy"), (3, "und"), (4, "und"), (5, "und"), (6, "xx"), (6, "xx")]
    assert all(0 <= g[2] <= 1 for g in got)
    none = L.fit(df.limit(0).withColumn("lang", L.F.lit("a")))
    assert {r.lang_pred for r in L.predict(df, none).collect()} == {"und"}
    assert L.predict(df.limit(0), model()).count() == 0


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = L.op2_language_id(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert len(got) == 1000 and (held["lang"] == held["lang_pred"]).mean() > 0.97


def test_sample_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(i, "ab cd", "xx" if i % 3 else None) for i in range(900)], "doc_id long, text string, lang string")
    a, b = L.fit(df, rows=10), L.fit(df.repartition(7), rows=10)
    assert a.languages == ["xx"] and np.array_equal(a.cost, b.cost)
