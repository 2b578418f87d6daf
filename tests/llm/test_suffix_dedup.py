import random
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from tidewell.llm import suffix_dedup as S


def test_suffix_array_is_sorted():
    r = random.Random(2)
    for _ in range(80):
        n, k = r.randrange(2, 300), r.choice([1, 2, 3, 26])
        t = np.array([r.randrange(1, k + 1) if r.random() > 0.02 else 0 for _ in range(n)] + [0], dtype=np.int64)
        sa = S.suffix_array(t, 100)
        padded = list(t) + [0] * 110
        keys = [tuple(padded[i : i + 100]) for i in sa]
        assert sorted(sa) == list(range(len(t))) and keys == sorted(keys)


def corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, base = text(60), text(120)
    rows = [(i, text(40) + " " + passage[: r.randrange(90, len(passage))] + " " + text(r.randrange(0, 30))) for i in range(60)]
    rows += [(100 + i, base) for i in range(20)] + [(200 + i, base.replace("a", "xy", i)) for i in range(20)]
    rows += [(300, None), (301, ""), (302, "x" * 99), (303, "x" * 500), (304, "ab" * 300), (305, "x" * 100), (-5, base[10:300] + base[10:300]), (306, text(20_000))]
    return rows


@pytest.mark.parametrize("frequent", [None, 3, 0])
def test_against_brute_force(spark, tmp_path, monkeypatch, frequent):
    """Whichever anchors count as frequent: none, some, all."""
    if frequent is not None:
        monkeypatch.setattr(S, "SAMPLED", 1)
        monkeypatch.setattr(S, "FREQUENT", frequent)
    rows = corpus()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_removed int").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = S.op5_suffix_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect())) == S.brute_force(rows)


def test_small_pieces(monkeypatch):
    """Texts cut in pieces and sorted in many groups give the same spans."""
    monkeypatch.setattr(S, "HASH_BYTES", 400)
    monkeypatch.setattr(S, "SORT_BYTES", 3000)
    rows = [(i, t) for i, t in corpus() if t and i < 306]
    batch = pa.RecordBatch.from_pylist([{"doc_id": i, "_text": t} for i, t in rows])
    none = SimpleNamespace(value=np.zeros(0, np.int64))
    segs = pd.concat([b.to_pandas() for b in S._segment_rows(none)([batch])])
    segs = segs.assign(n=segs["no"] // 128, k=segs["g"])
    data = {i: t.encode() for i, t in rows}
    assert segs["n"].sum() == sum(max(0, len(b) - 99) for b in data.values())
    gone = {i: np.zeros(len(b) + 1, dtype=bool) for i, b in data.items()}
    for s in segs[segs["again"]].itertuples():
        gone[s.doc_id][s.s0 : s.s0 + s.n + 99] = True
    rest = segs[~segs["again"]].sort_values("k")
    rest = rest.assign(body=[data[s.doc_id][s.s0 : s.s0 + s.n + 99] for s in rest.itertuples()])
    for out in S._sorted_groups([rest]):
        for s in out.itertuples():
            gone[s.doc_id][s.start : s.end] = True
    assert {i: int(g.sum()) for i, g in gone.items()} == {r[0]: r[2] for r in S.brute_force(rows)}


def test_repeated_ids_and_empty(spark):
    base = "abcdefghij" * 12
    df = spark.createDataFrame([(1, base), (1, base), (2, base), (None, base), (1, "z" + base)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in S.repeated_bytes(df).collect()}
    assert got == {1: 110, 2: 120}
    assert S.repeated_bytes(df.limit(0)).count() == 0


def test_equal_windows_go_the_same_way():
    """Windows of frequent anchors: whatever stands around them, equal ones have equal keys."""
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh") for _ in range(260))
    rows = [(i, ("".join(r.choice("xyz") for _ in range(r.randrange(50))) + passage[r.randrange(60) : r.randrange(180, 260)] + "".join(r.choice("xyz") for _ in range(r.randrange(50)))).encode()) for i in range(30)]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([b.decode() for _, b in rows])], names=["doc_id", "_text"])
    every = np.unique(S.segments([(i, 0, b) for i, b in rows])["k"])
    by_doc = {}
    for b in S._segment_rows(SimpleNamespace(value=every))([batch]):
        for x in b.to_pylist():
            assert x["often"]
            by_doc.setdefault(x["doc_id"], []).append({"g": x["g"], "s0": x["s0"], "no": x["no"], "gone": False, "often": True})
    segs = pa.array([by_doc.get(i, []) for i, _ in rows])
    keys, seen = {}, 0
    for b in S._bodies([pa.RecordBatch.from_arrays([*batch.columns, segs], names=["doc_id", "_text", "segs"])]):
        for x in b.to_pylist():
            for j in range(len(x["body"]) - 99):
                seen += 1
                assert rows[x["doc_id"]][1][x["s0"] + j : x["s0"] + j + 100] == x["body"][j : j + 100]
                keys.setdefault(x["body"][j : j + 100], set()).add(x["k"])
    assert seen == sum(max(0, len(b) - 99) for _, b in rows) and all(len(k) == 1 for k in keys.values())
