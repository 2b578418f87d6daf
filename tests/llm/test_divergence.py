import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa

from tidewell.llm import divergence as D

SF = "/root/testdata/sf0.001"


def brute(rows, least):
    """op13's rows for (text, lang, source) rows."""
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low)
        groups.add((lang, source))
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        mine = sorted(s for x, s in groups if x == lang)
        whole = Counter()
        for s in mine:
            whole.update(counts[lang, s])

        def shares(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in mine}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in mine:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in mine if o != s]
            top = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", top, 10)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows, least):
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value int").repartition(4)
    got = D.audit(df, least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def corpus(r, n, sources):
    words = ["the", "The", "THE", "ÉTÉ", "été", "né", "日本", "a", "b1c", "x_y", "İ", "zz", "Öl", "öl"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(" ".join(r.choices(words, k=r.randrange(0, 30))), r.choice(["en", "de", None, ""]), f"s{min(r.randrange(sources), r.randrange(sources))}") for _ in range(n)]


def test_against_brute_force(spark):
    r = random.Random(2)
    rows = corpus(r, 300, 25) + [(None, "en", None), ("", "xx", "only"), ("12 34 ++", "xx", "other"), ("alone", "one", "one")]
    check(spark, rows, 5)


def test_small_shards(spark, monkeypatch):
    """The same rows where a shard holds a few terms only."""
    monkeypatch.setattr(D, "CELLS", 16)
    check(spark, corpus(random.Random(4), 120, 9), 3)


def test_task_flushes_and_pieces(monkeypatch):
    """Counts that a task passes on often, of texts that it splits, sum to the same."""
    rows = corpus(random.Random(8), 80, 5) + [("x" * 50 + " y " * 40, "en", "s1")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] or "" for r in rows]) for i in (1, 2, 0)], names=["lang", "source", "_text"])

    def sums():
        out = Counter()
        for b in D._counted(iter([batch, batch])):
            for r in b.to_pylist():
                out[r["lang"], r["source"], r["term"], "n"] += r["n"]
                out[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return out

    whole = sums()
    monkeypatch.setattr(D, "HELD_TERMS", 10)
    monkeypatch.setattr(D, "PIECE", 8)
    assert sums() == whole


def test_no_kept_terms_repeated_rows_and_empty(spark):
    check(spark, [("rare", "en", "a"), ("rarer", "en", "b"), (None, None, None)], 10)
    check(spark, [("same words", "en", "a")] * 12 + [("same other", "en", "b")] * 11, 10)
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert D.audit(df).count() == 0


def test_every_seat_meets_every_other_once():
    met = [frozenset(x) for visits in D.rounds(D.SEATS) for x in visits.items()]
    assert len(met) == len(set(met)) == D.SEATS * (D.SEATS - 1) // 2
    assert all(len({*v, *v.values()}) == D.SEATS for v in D.rounds(D.SEATS))


def test_shares_are_exact():
    r = random.Random(1)
    for _ in range(300):
        total = r.randrange(2, 9 * 10 ** r.randrange(1, 16))
        n = r.randrange(0, max(1, total - 1))
        assert int(D.share(np.array([n]), np.array([total]))[0]) == 1 + 10**9 * (n + 2) // total


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(D.OP13_SQL).fetchall()
    assert sorted(map(tuple, D.op13_source_divergence(spark, SF).collect())) == sorted(want)
