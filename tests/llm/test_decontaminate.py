import re

from tidewell.llm import decontaminate as D

_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return _W.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, n):
    out = []
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for a in range(max(1, len(v) - n + 1) if v else 0):
                g = v[a : a + n]
                for s in range(len(w) - len(g) + 1):
                    if w[s : s + len(g)] == g:
                        hit.update(range(s, s + len(g)))
                        ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    docs = [(1, "A b c d e f g"), (2, "x a B, c d! y a b c"), (3, None), (4, ""), (5, "z " * 300 + "a b c"), (6, "q é 9 q É 9"), (6, "q é 9 q É 9"), (7, "a b a b a b a b")]
    items = [(1, "a b c d"), (2, "É 9"), (3, None), (4, "..."), (5, "a b a b a"), (1, "a b c d"), (10, "é 9")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (D.BROADCAST_BYTES, 8):  # the second joins windows and postings by term
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        got = D.find_benchmark(df, bench, window=3)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got.collect()), key=str) == brute(docs, items, 3)


def test_both_ways_on_given_documents(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = []
    for size in (D.BROADCAST_BYTES, 100):
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        got = D.find_benchmark(docs, bench, window=3, near=4, keep_text=False)
        rows.append(sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()))
    assert rows[0] == rows[1] and any(r[-2] for r in rows[0])


def test_near(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha x beta y gamma"), (2, "alpha " + "x " * 50 + "beta gamma")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    for size in (D.BROADCAST_BYTES, 8):
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        got = {r.doc_id: (r.near_items, r.n_hit) for r in D.find_benchmark(df, bench, near=6).collect()}
        assert got == {1: (["7"], 0), 2: ([], 0)}


def test_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    for size in (D.BROADCAST_BYTES, -1):
        monkeypatch.setattr(D, "BROADCAST_BYTES", size)
        r = D.find_benchmark(df, none).first()
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (2, 0, 0, False)
        assert D.find_benchmark(df.limit(0), none).count() == 0
