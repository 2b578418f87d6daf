"""What the findings of round 4 found: titles that met by single frequent grams, so that candidates grew with the square of the titles."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import text as T
from tidewell.operators import knowledge


def titles(n: int, seed: int) -> list[str]:
    """Titles of few words, so that all grams are frequent, with families that differ by a letter or a word."""
    r = random.Random(seed)
    words = "harbour winter letter garden silver mountain thunder village morning captain orchard window".split()
    out = []
    for i in range(n):
        t = " ".join(r.choices(words, k=r.choice([1, 2, 4, 9, 14]))) + (f" {r.randrange(10**6)}" if i % 3 else "")
        out.append(r.choice(out) + r.choice(["s", "", " old", "!"]) if out and i % 4 == 0 else t)
    return out


@pytest.mark.parametrize("least", [0.5, 0.85, 0.95, 1.0])
@pytest.mark.parametrize("grams_of", [T.trigrams, knowledge.plain_trigrams])
def test_pairs_are_those_of_all_comparisons(spark, least, grams_of):
    r = random.Random(5)
    long = [" ".join(f"w{r.randrange(900)}" for _ in range(700)) for _ in range(2)]  # dealt into many parts, whose number is rounded
    texts = [*titles(160, 1), *long, long[0] + " end", long[1][:-300], "a", "A", "ab", "abc", "", "!!", None, "ünï 😀 cødé", "ünï 😀 cødé s"]
    rows = spark.createDataFrame([*enumerate(texts), (None, "none's own title")], "id long, t string").repartition(3)
    g = rows.groupBy("t").agg(F.min("id").alias("id")).where("id is not null").select("id", grams_of(F.col("t")).alias("g")).collect()
    sets = {x.id: set(x.g) for x in g if x.g}
    alike = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) for a in sets for b in sets if a < b}
    want = {(*p, s) for p, s in alike.items() if s >= least}
    got = [tuple(x) for x in knowledge.title_pairs(rows, "id", "t", least, grams_of).collect()]
    assert set(got) == want and len(got) == len(want) and (want or least == 1)


def test_a_key_of_several_titles(spark):
    """As in the SQL, a title is a row of its own, though its key be another's."""
    rows = spark.createDataFrame([(1, "the old harbour town"), (1, "quite another title"), (2, "the old harbour town!"), (3, "Quite another title")], "id long, t string")
    assert sorted(map(tuple, knowledge.title_pairs(rows, "id", "t").collect())) == [(1, 2, 1.0), (1, 3, 1.0)]


def test_frequent_grams_make_no_candidates(spark):
    """Titles that share frequent grams meet by whole parts: less than a tenth of all pairs do, counted once for each part."""
    rows = spark.createDataFrame([(i, i, f"{t} {i}") for i, t in enumerate(titles(600, 2))], "k long, id long, t string")
    met = knowledge._signatures(rows, 0.85, T.trigrams).groupBy("key", "m").count().agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0]
    assert met < 600 * 600 / 2 / 10


def test_grams_are_made_once_a_title(spark):
    """No filter makes them again, and no window sorts them."""
    plan = knowledge.title_pairs(spark.createDataFrame([(1, "a title")], "id long, t string"), "id", "t")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not [x for x in plan.split("\n") if " Filter " in x and "regexp_extract_all" in x]
    assert "BroadcastHashJoin [key" not in plan


def test_rounds_carry_numbers_only(spark, monkeypatch):
    """Titles and hashes of bodies are written once; what rounds write again are numbers."""
    seen = []
    monkeypatch.setattr(knowledge, "cut", lambda df: (seen.append(dict(df.dtypes)), session.cut(df))[1])
    long = "the long history of the old harbour town and its people"
    rows = spark.createDataFrame([(i, long[: len(long) - i], f"b{i}") for i in range(12)] + [(20, None, "b0"), (21, None, None), (22, "", " ")], "id long, title string, body string")
    got = {r.id: (r["keep"], r.reason) for r in knowledge.keep_first(rows, "id", "title", "body").collect()}
    assert got[0] == (0, None) and got[20][1] == "content_hash" and got[22] == (21, "content_hash") and len(got) == 15
    assert [("t" in c, "h" in c) for c in seen[:2]] == [(True, True), (True, False)]
    assert all(not {"string", "binary"} & set(c.values()) for c in seen[2:]) and len(seen) > 4


def test_plain_trigrams_count_characters(spark):
    texts = ["", "a", "ab", "abc", "abcabcd", "ünï 😀😀 cødé", "line\nbreak", None, "x" * 20000 + "😀"]
    got = [r.g for r in spark.createDataFrame([(t,) for t in texts], "t string").select(knowledge.plain_trigrams(F.col("t")).alias("g")).collect()]
    assert got[-2] is None
    for t, g in zip(texts, got):
        if t is not None:
            assert g == list(dict.fromkeys([t[i : i + 3] for i in range(max(1, len(t) - 2))] if t else []))
