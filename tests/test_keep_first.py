"""Keep-first deduplication against the sequential rule."""

import hashlib
import random
import re

from tidewell.operators import knowledge as K
from tidewell.plans import registry

SF = "/root/testdata/sf0.001"


def grams(s):
    return {s} - {""} if len(s) < 3 else {s[i : i + 3] for i in range(len(s) - 2)}


def brute(rows, least=0.85):
    items = []
    for i, title, body in sorted(rows):
        key = re.sub(r"[\W_]+", " ", (title or "").lower()).strip()
        items.append((i, key, grams(key), hashlib.sha256((body or "").strip(" ").encode()).hexdigest()))
    keep, out = {}, {}
    for n, (i, t, g, h) in enumerate(items):
        if i in keep:
            continue
        keep[i], out[i] = i, (i, None, None)
        for j, u, k, b in items[n + 1 :]:
            if j in keep:
                continue
            like = len(g & k) / len(g | k) if g | k else 0
            same, exact, near = h == b, t != "" and t == u, like >= least
            if same or exact or near:
                keep[j] = i
                out[j] = (i, 1.0 if same or exact else like, "both" if same and (exact or near) else "content_hash" if same else "title")
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, title string, body string, keep string").repartition(4)
    got = {r.id: (r["keep"], r.score, r.reason) for r in K.keep_first(df, "id", "title", "body").collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (keep, score, reason) in want.items():
        assert got[i][0] == keep and got[i][2] == reason and (score is None) == (got[i][1] is None) and abs((score or 0) - (got[i][1] or 0)) < 1e-6, i


def test_chains_and_groups(spark):
    long = "the long history of the old harbour town and its people"
    rows = [(i, long[: len(long) - i], f"b{i}") for i in range(12)]  # each title is like its neighbours only
    rows += [(20, "A Title", "same"), (21, "Other", "same "), (22, "other!", "x"), (23, "a  title", "y"), (24, None, "z"), (25, "", "z"), (26, "", None), (27, None, ""), (28, "ab", "1"), (29, "AB", "2"), (30, "ab c", "same")]
    check(spark, rows)


def test_random_rows(spark):
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    rows = []
    for i in range(250):
        title = " ".join(r.choices(words, k=r.randrange(0, 9)))
        if rows and r.random() < 0.5:
            title = (r.choice(rows)[1] or "") + r.choice(["", "s", " x", "!"])
        rows.append((i * 3, title, f"body {r.randrange(120)}"))
    check(spark, rows)


def test_empty_and_given_documents(spark):
    assert K.keep_first(spark.createDataFrame([], "id long, title string, body string"), "id", "title", "body").count() == 0
    rows = [(r.doc_id, (r.text or "").split(".")[0], (r.text or "")[len((r.text or "").split(".")[0]) :]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.id: r["keep"] for r in registry.QUERIES["t20_keep_first"](spark, SF).collect()}
    assert got == {i: k for i, (k, _, _) in brute(rows).items()}
