import random
import re

import numpy as np

from tidewell.llm import near_dedup as N


def classes(rows, threshold=0.8):
    """Brute force: components of links between all pairs of distinct texts."""
    first, sets = {}, {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if t and re.search(r"\w", t):
            first.setdefault(t, i)
    for t, i in first.items():
        w = re.findall(r"\w+", t.lower())
        n = min(5, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            near = a < b and min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b]))
            if near and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold:
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {(i, top(first[t]) if t in first else i) for i, t in rows if i is not None}


def test_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(25):
        base = r.choices(words, k=r.choice([3, 8, 40, 200]))
        for c in range(r.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(base) // 20) + 1)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((100 * g + c, " ".join(copy)))
    rows += [(9000, rows[3][1]), (9001, rows[3][1].upper()), (9002, None), (9003, ""), (9004, "!!"), (9005, "!!"), (9006, "one"), (9007, "one"), (9008, "same " * 5000), (9009, "same " * 4000)]
    df = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, class_id int")
    got = N.near_duplicates(df).collect()
    assert {(x.doc_id, x.class_id) for x in got} == classes(rows)
    links_connect(rows, got)


def links_connect(rows, got):
    """Every link is one by its texts, and the links connect each class: as many trees as classes."""
    text = dict(rows)
    sets = {i: set(zip(*[w[j : max(0, len(w) - n + 1) + j] for j in range(n)])) for i, t in rows if t and (w := re.findall(r"\w+", t.lower())) and (n := min(5, len(w)))}
    for x in got:
        if x.copy_of != x.doc_id:
            assert x.linked_to == x.copy_of and x.similarity == 1.0 and text[x.doc_id] == text[x.copy_of]
        elif x.linked_to is not None:
            a, b = sets[x.doc_id], sets[x.linked_to]
            assert x.linked_to < x.doc_id and abs(len(a & b) / len(a | b) - x.similarity) < 1e-9 and x.similarity >= 0.8
    of = {x.doc_id: x.class_id for x in got}
    assert all(of[x.linked_to] == x.class_id for x in got if x.linked_to is not None)
    assert any(x.linked_to is not None and x.similarity < 1 for x in got)


def test_repeated_rows_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f!")], "doc_id long, text string")
    got = sorted(((x.doc_id or 0, x.class_id, x.copy_of) for x in N.near_duplicates(df).collect()), key=str)
    assert got == [(0, None, None), (1, 1, 1), (1, 1, 1), (2, 1, 2)]
    assert N.near_duplicates(df.limit(0)).count() == 0


def test_signatures_estimate_probability_jaccard():
    """Agreement of registers against the definition of probability Jaccard similarity."""
    r = np.random.default_rng(1)
    a = np.unique(N.mix(np.arange(1, 301, dtype=np.uint64)))
    b = np.concatenate([a[:200], N.mix(np.arange(1000, 1080, dtype=np.uint64))])
    ca, cb = r.integers(1, 20, len(a)), r.integers(1, 20, len(b))
    sig = N.signatures([(a, ca), (b, cb)], 4096)
    wa, wb = dict(zip(a.tolist(), 1 + np.log(ca))), dict(zip(b.tolist(), 1 + np.log(cb)))
    both = [d for d in wa if d in wb]
    exact = sum(1 / sum(max(wa.get(e, 0) / wa[d], wb.get(e, 0) / wb[d]) for e in wa.keys() | wb.keys()) for d in both)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03


def test_components(spark):
    r = random.Random(1)
    path = list(range(100))
    r.shuffle(path)
    edges = list(zip(path, path[1:])) + [(200, 201), (201, 202), (300, 300)]
    got = {x.id: x.label for x in N.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100), 0), 200: 200, 201: 200, 202: 200}


def test_shingles_of_words():
    """Whatever the batch and the pieces, one hash for each distinct run of five words."""
    texts = ["", "one", "Ünï cödé_ 1_2 x\ny z", "a b c d e a b c d e", "\u0130 \u01c5 \U0001d7d9\U00010428 9\u0663", " ".join(f"w{i % 700}" for i in range(3000)) + " end"]
    together = N.shingle_sets(texts)
    before, N.PIECE = N.PIECE, 50
    try:
        pieces = [N.shingles(t) for t in texts]
    finally:
        N.PIECE = before
    for t, (s, c), (s2, c2) in zip(texts, together, pieces):
        w = re.findall(r"\w+", t.lower())
        n = min(5, len(w))
        want = [tuple(w[j : j + n]) for j in range(len(w) - n + 1)] if w else []
        assert len(set(want)) == len(s) and c.sum() == len(want)
        assert (s == s2).all() and (c == c2).all()


def near_copies(n, seed):
    """Copies of one text of 150 words with up to nine words changed: some are links, some are near misses."""
    r = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    out = []
    for c in range(n):
        copy = list(base)
        for _ in range(r.randrange(10)):
            copy[r.randrange(len(copy))] = f"new{r.randrange(10**9)}"
        out.append((c, " ".join(copy)))
    return out


def test_hot_group(spark):
    """One large group: classes as by all pairs, but for what no band can find, and comparisons that grow with the rows."""
    compared = {}
    for n in (150, 600):
        rows = near_copies(n, n)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        seen, before = [], N.verified
        N.verified = lambda pairs, texts: seen.append(pairs.distinct().count()) or before(pairs, texts)
        try:
            got = {(x.doc_id, x.class_id) for x in N.near_duplicates(df).collect()}
        finally:
            N.verified = before
        want = classes(rows)
        assert len(got & want) >= 0.99 * len(want)
        compared[n] = sum(seen)
    assert compared[600] < 6 * compared[150]


def test_recall_on_whole_documents(spark):
    """Against all pairs of the documents at sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = classes([tuple(x) for x in docs.collect()])
    got = {(x.doc_id, x.class_id) for x in N.near_duplicates(docs).collect()}
    copies = {x for x in want if x[0] != x[1]}
    assert len(copies) > 20 and len(copies & got) >= 0.9 * len(copies) and len(want & got) >= 0.99 * len(want)
