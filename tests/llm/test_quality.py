import math

import numpy as np
import pytest

from tidewell.llm import quality as Q
from tidewell.llm.language_id import held_out

SF = "/root/testdata/sf0.1"


def plain_score(net, data: bytes) -> float:
    """The same network by loops over a whole text."""
    p, total, at, n = net.p, np.zeros(Q.HIDDEN), 0, 0
    while True:
        codes = [*data[at : at + Q.CHUNK]]
        codes += [256] * (Q.CHUNK - len(codes))
        best = np.full(Q.FILTERS, -np.inf)
        for place in range(0, Q.CHUNK - Q.SPAN + 1, Q.STRIDE):
            under = np.concatenate([p["vectors"][codes[place + j]] for j in range(Q.SPAN)]).astype(np.float64)
            best = np.maximum(best, under @ p["filters"])
        units = np.maximum(np.maximum(best + p["bias"], 0) @ p["hidden"] + p["hidden_bias"], 0)
        total, n, at = total + units, n + 1, at + Q.STEP
        if at + (Q.CHUNK - Q.STEP) >= len(data):
            break
    x = float((total / n) @ p["last"] + p["last_bias"][0] + net.offset)
    return 1 / (1 + math.exp(-x))


def test_whole_texts_in_overlapping_chunks():
    net = Q.Network(3)
    texts = [b"", b"a", b"x" * 512, b"x" * 513, b"The quick brown fox. " * 60, "Füße naïve ".encode() * 70, bytes(range(256)) * 9]
    got = Q.scored(net, texts)
    for g, t in zip(got, texts):
        assert abs(g - plain_score(net, t)) < 1e-5
    for size in (0, 1, 448, 511, 512, 513, 960, 961, 5000):
        starts = Q.chunk_starts(size)
        covered = {b for a in starts for b in range(a, min(a + Q.CHUNK, size))}
        assert covered == set(range(size))


def test_long_texts_pass_in_pieces(monkeypatch):
    net = Q.Network(4)
    r = np.random.default_rng(1)
    long = r.integers(32, 127, 20_000).astype(np.uint8).tobytes()
    whole = Q.scored(net, [long, b"short", long[:3000]])
    monkeypatch.setattr(Q, "PIECE", 1500)
    assert np.allclose(Q.scored(net, [long, b"short", long[:3000]]), whole, atol=1e-6)
    codes, owner = Q.chunks([long])
    changed = long[:-3] + b"\xff\xff\xff"
    assert (Q.chunks([changed])[0] != codes).any()  # the end counts too


def test_gradients_against_differences():
    net = Q.Network(5)
    codes, owner = Q.chunks([b"some text that is fine " * 40, b"!!!! ??? " * 30, b"z"])
    label = np.array([1, 0, 1], dtype=np.float32)

    def loss() -> float:
        total, n = net.scores(codes, owner, 3)
        p = net.probability(total, n)
        return float(-np.mean(label * np.log(p) + (1 - label) * np.log(1 - p)))

    got = net.gradients(codes, owner, label)
    for name in ("last", "hidden", "hidden_bias", "filters", "bias", "vectors"):
        at = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        kept, by = net.p[name][at].copy(), 2e-3
        net.p[name][at] = kept + by
        up = loss()
        net.p[name][at] = kept - by
        down = loss()
        net.p[name][at] = kept
        assert (up - down) / (2 * by) == pytest.approx(got[name][at], rel=0.15, abs=1e-4), name


def test_held_out_accuracy(spark):
    found = Q.op12_quality(spark, SF)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").where("held_out").toPandas()
    assert (rows["predicted"] == rows["quality"]).mean() > 0.95
    good, bad = (np.sort(rows.loc[rows["quality"] == q, "score"]) for q in (1, 0))
    auc = np.searchsorted(bad, good).sum() / (len(good) * len(bad))
    assert auc > 0.97 and rows["score"].between(0, 1).all()


def test_labels_one_sided_null_or_empty(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(9)] + [(None, None, "y")], "doc_id long, text string, score string")
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    for rows, want in (([], 0.5), ([(1, 1), (None, 0), (3, None), (4, 7)], 1.0), ([(2, 0), (99, 1)], 0.0)):
        got = Q.score(docs, Q.fit(docs, labels(rows)), keep_text=False).collect()
        assert [(r.score, r.predicted) for r in got] == [(want, int(want >= 0.7))] * 10
    net = Q.fit(docs.unionByName(docs), labels([(i, i % 2) for i in range(9)] * 2 + [(1, 0)]))
    found = Q.score(docs, net)
    assert found.columns == ["doc_id", "text", "score", "predicted"] and found.count() == 10
    assert Q.score(docs.limit(0), net).count() == 0


def test_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "fine words here" if i % 2 else "!! ??") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    wrong = labels.where(held_out()).selectExpr("doc_id", "1 - quality AS quality").unionByName(labels.where(~held_out()))
    nets = [Q.fit(docs, x.where(~held_out())).p for x in (labels, wrong)]
    assert all((nets[0][k] == nets[1][k]).all() for k in nets[0])
