"""Operators on small inline tables: nulls, empty texts, ties and empty tables."""

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import conversations, intervals, knowledge, search, stats


def test_match_and_phrase_of_nulls(spark):
    rows = spark.createDataFrame([(1, "a.md", "The Cat", "sat on the mat"), (2, None, None, None), (3, "b.md", "", "the mat sat on")], "chunk_id long, path string, title string, content string")
    ids = lambda df: sorted(r.chunk_id for r in df.collect())
    assert ids(search.match(rows, must=["mat"], must_not=["cat"])) == [3]
    assert ids(search.phrase(rows, ["on", "the", "mat"])) == [1]
    assert ids(search.prefix(rows, "ca")) == [1]
    assert ids(search.bm25(rows, ["mat", "absent"])) == [1, 3]
    assert search.bm25(rows.limit(0), ["mat"]).count() == 0


def test_knn_skips_other_dimensions(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0]), (4, [1.0, 1.0]), (5, None)], "id long, embedding array<double>")
    assert [(r.id, r.similarity) for r in search.knn(v, [1.0, 0.0], 5).collect()] == [(1, 1.0), (4, 0.707106781), (3, 0.0)]


def test_intervals(spark):
    rows = spark.createDataFrame([(1, 5, 3), (None, 5, 3), (1, None, 9), (5, 1, 3), (None, None, None)], "lo int, hi int, at int")
    assert [r.x for r in rows.select(intervals.contains(F.col("lo"), F.col("hi"), F.col("at")).alias("x")).collect()] == [True, True, True, False, False]


def test_jaccard_of_empty_sets(spark):
    row = spark.range(1).select(T.jaccard(T.trigrams(F.lit("")), T.trigrams(F.lit(""))).alias("t"), T.jaccard(T.tokens(F.lit("")), T.tokens(F.lit("")), 1.0).alias("w")).first()
    assert (row.t, row.w) == (0.0, 1.0)


def test_sentences_keep_titles_of_persons(spark):
    row = spark.range(1).select(conversations.sentences(F.lit("I saw Dr. Who. It was fun!\nReally?  Yes")).alias("s")).first()
    assert row.s == ["I saw Dr. Who.", "It was fun!", "Really?", "Yes"]


def test_reaction(spark):
    texts = ["Perfect, that helps", "No, that's wrong", "yes and no", "the weather"]
    kind, sure = conversations.reaction(F.col("t"))
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", kind.alias("k"), sure.alias("c")).orderBy("i").collect()
    assert [(r.k, r.c) for r in got] == [("reinforced", 0.6), ("corrected", 0.6), ("neutral", 0.2), ("neutral", 0.0)]


def test_frontmatter_needs_a_closing_fence(spark):
    rows = spark.createDataFrame([(1, "---\nname: 'x'\ntags: [a]\n---\nb"), (2, "---\nname: x\nb"), (3, ""), (4, None)], "i int, t string")
    got = {r.i: r.m for r in rows.select("i", knowledge.frontmatter(F.col("t")).alias("m")).collect()}
    assert got == {1: {"name": "x", "tags": "[a]"}, 2: None, 3: None, 4: None}


def test_sections_and_windows(spark):
    rows = spark.createDataFrame([(1, "intro\n# A\nx\n## B\ny"), (2, ""), (3, None)], "id int, t string")
    assert [(r.id, r.section) for r in knowledge.sections(rows, "id", "t").orderBy("ordinal").collect()] == [(1, "intro\n"), (1, "# A\nx\n"), (1, "## B\ny")]
    text = "".join(chr(97 + i % 26) for i in range(5000))
    long = spark.createDataFrame([(1, text), (2, "short"), (3, ""), (4, None)], "id int, t string")
    got = sorted((r.id, r.ordinal, r.chunk) for r in knowledge.windows(long, "id", "t").collect())
    assert got == [(1, i, text[i * 1792 : i * 1792 + 2048]) for i in range(3)] + [(2, 0, "short")]


def test_allocation_is_whole(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "category string, n long")
    assert {r.category: r["take"] for r in stats.allocate(counts, 7).collect()} == {"a": 4, "b": 2, "c": 1}
    assert {r.category: r["take"] for r in stats.allocate_equal(counts, 8).collect()} == {"a": 3, "b": 3, "c": 2}
