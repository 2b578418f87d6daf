import random

import numpy as np

from tidewell.llm import topk as K


def brute(vectors, queries, k):
    out = []
    for q, x in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    r = random.Random(3)
    vectors = [(i, [r.randrange(-50, 50) for _ in range(8)]) for i in range(300)] + [(1000 + i, [1] * 8) for i in range(40)] + [(2000, []), (2001, [5])]
    df = spark.createDataFrame(vectors, "vec_id long, v array<long>")
    got = K.exact_topk(df, df.where("vec_id % 50 = 0"), k=7, block=64)
    assert sorted(map(tuple, got.collect())) == brute(vectors, {i: v for i, v in vectors if i % 50 == 0}, 7)


def test_scaled_drops_and_large_values(spark):
    rows = [(0, [0.5, -0.1]), (1, None), (2, [float("nan"), 1.0]), (3, [float("inf"), 1.0]), (4, [None, 1.0]), (5, [1e12, 1e12]), (6, [-1e12, 3.0]), (None, [1.0, 1.0])]
    v = K.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.v) for r in v.where("vec_id < 5").collect()) == [(0, [512, -103])]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in K.exact_topk(v, v, k=1).collect()}
    assert got[(5, 1)][0] == 0 and got[(6, 1)][0] == 0 and got[(0, 1)][0] == 5


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, v array<long>")
    assert K.exact_topk(df, df).count() == 0


def test_terms_become_non_essential():
    """Skewed dimensions, so that bounds split the terms; small steps; and numbers beyond doubles."""
    r = random.Random(9)
    for scale in (1, 2**40):
        rows = [[r.randrange(-(4**d), 4**d) * scale for d in range(10)] for _ in range(400)]
        ids = list(range(0, 800, 2))
        r.shuffle(ids)
        for n in range(20):
            q = [r.choice([0, 1, -3, 2]) * scale for _ in range(10)] if n else [0] * 10
            want = sorted((-sum(a * b for a, b in zip(q, x)), i) for i, x in zip(ids, rows) if i != 4)[:5]
            got = K.maxscore(np.array(ids), np.array(rows, dtype=np.int64), 4, np.array(q, dtype=np.int64), 5, step=16)
            assert got == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in want]
