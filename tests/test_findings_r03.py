"""What the findings of round 3 found: odd inputs, and work that grew faster than its input."""

import pytest
from pyspark.sql import functions as F

from tidewell import session
from tidewell.functions import text as T
from tidewell.operators import conversations, ingest, knowledge, questions, recall, retry, search
from tidewell.sources import hits


@pytest.fixture
def large(spark):
    """Plans as for large tables: nothing is broadcast that no hint names, and plans do not change as they run."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_reaction_has_ascii_word_bounds(spark):
    texts = ["noé", "éno", "node", "actually\x0bx", "actually\tx", "yeſ", "that waſ right", "thanKs"]
    kind, _ = conversations.reaction(F.col("text"))
    got = [r.k for r in spark.createDataFrame([(t,) for t in texts], "text string").select(kind.alias("k")).collect()]
    assert got == ["corrected", "corrected", "neutral", "neutral", "corrected", "neutral", "reinforced", "reinforced"]


def test_stemmed_search_shuffles_no_other_tokens(large):
    rows = large.createDataFrame([(1, "licensing the license"), (2, "licence licensees of licensed"), (3, "the the"), (4, None)], "chunk_id long, content string")
    found = search.bm25_many(rows, {0: [search.porter_stem("licensing")]}, variants=search.stem_variants(rows, ["licensing"]))
    assert "SortMergeJoin" not in plan(found) and "ArrowEvalPython" not in plan(found)
    assert sorted(r.chunk_id for r in found.collect()) == [1, 2]
    assert sorted(r.token for r in search.stem_variants(rows, ["licensing"]).collect()) == ["license", "licensed", "licensing"]


def test_best_rows_are_those_of_all_scores(large):
    """With and without the matrix form, which repeated ids go round; other tokens than the queries' are not shuffled, nor pairs of queries and rows."""
    texts = [" ".join(w for j, w in enumerate("the red widget and a blue bolt of my old garden red red".split()) if (i * 7 + j * j) % 3) for i in range(60)]
    rows = large.createDataFrame([(i, t) for i, t in enumerate([*texts, None, ""])], "chunk_id long, content string")
    wanted = large.createDataFrame([(1, "red"), (1, "bolt"), (2, "garden"), (2, "none"), (3, "absent"), (3, None)], "query_no int, term string")
    for some in (rows, rows.union(rows.limit(3)), rows.limit(0)):
        every = search.bm25_table(some, wanted)
        assert "SortMergeJoin" not in plan(every)
        found = search.bm25_best(some, wanted, 5)
        assert "hashpartitioning(chunk_id" not in plan(found) or some.count() != rows.count()
        assert sorted(found.collect()) == sorted(search.best_of_each(every, 5).select(*found.columns).collect())
    few, search.FEW_TERMS = search.FEW_TERMS, 1
    try:
        assert sorted(search.bm25_best(rows, wanted, 5).collect()) == sorted(found_all(rows, wanted, few))
    finally:
        search.FEW_TERMS = few


def found_all(rows, wanted, few):
    now, search.FEW_TERMS = search.FEW_TERMS, few
    try:
        return search.bm25_best(rows, wanted, 5).collect()
    finally:
        search.FEW_TERMS = now


def test_recall_reads_only_candidates_whole(large):
    """Notes that are no candidates go before repeated paths do."""
    topics = large.createDataFrame([(i, 0, "global_notes", f"n{i:03}.md", "note", "", "", f"red {i}") for i in range(260)], "chunk_id long, grp int, scope string, path string, title string, summary string, tag_text string, content string").withColumn("modified", F.lit("2024-01-01").cast("date"))
    requests = large.createDataFrame([(1, 0, 1.0, 0.5, "What red?")], "request int, grp int, w_global double, w_project double, question string")
    found = recall.recall(requests, topics, large.createDataFrame([], "request int, path string"))
    assert "LeftSemi" in plan(found)
    assert found.count() == recall.RECALLED and max(r.chunk_id for r in found.collect()) < recall.SCANNED


def test_ingest_shuffles_texts_once_to_find_what_is_to_do(spark, tmp_path, monkeypatch):
    """Each text is hashed and grouped once a run; stages read what that wrote, and a run again changes no more than it has to."""
    seen = []
    monkeypatch.setattr(ingest, "cut", lambda df: (seen.append(df.columns), session.cut(df))[1])
    docs = spark.createDataFrame([("a", "x" * 3000, "me"), ("b", "x" * 3000, "me"), ("c", "y", None), ("d", None, "me")], "title string, text string, owner string")
    chunk = lambda rows: knowledge.windows(rows, "hash", "text").withColumnRenamed("chunk", "content")
    got = [sorted((r.chunk_count, r.reused) for r in ingest.ingest(spark, docs, f"file://{tmp_path}/t", chunk).collect()) for _ in range(2)]
    assert got == [[(0, False), (1, False), (2, False)], [(0, False), (1, True), (2, True)]]
    assert len(seen) == 2 and all("text" in c for c in seen)


def test_title_candidates_end_at_their_bits(large):
    """Pairs are those of all comparisons; bits of hashed grams are compared before any set is joined to a pair."""
    words = "red widget of the old garden by some quiet river near zürich".split()
    titles = [" ".join(words[(i * j) % 12] + ("x" if (i + j) % 11 == 0 else "") for j in range(1, 9)) for i in range(40)]
    titles += [" ".join(f"w{i}q{j}" for j in range(200)) for i in (1, 2)] + [" ".join([f"w1q{j}" for j in range(200)] + ["end"]), "ab", "", None]
    rows = large.createDataFrame(list(enumerate(titles)), "id long, t string")
    found = knowledge.title_pairs(rows, "id", "t")
    assert "bit_count" in plan(found)
    g = rows.groupBy("t").agg(F.min("id").alias("id")).select("id", T.trigrams(F.col("t")).alias("g")).collect()
    sets = {r.id: set(r.g) for r in g if r.g}
    want = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 9) >= 0.85}
    assert {(r.a, r.b) for r in found.collect()} == want and want


def test_cascade_reads_its_rows_once(spark, monkeypatch):
    """One pass holds what all rungs need; the forms for many words and for few find the same, rows are bounded by the question's day."""
    words = "red widget blue bolt garden recipe commute".split()
    rows = [(i, f"notes/{words[i % 7]}s-{i}.md" if i % 3 else None, " ".join(words[(i * j) % 7] for j in range(1, 1 + i % 5)) or None, f"2024-0{1 + i % 9}-03" if i % 8 else None) for i in range(50)]
    rows = spark.createDataFrame(rows, "chunk_id long, path string, content string, m string").select("chunk_id", "path", F.lit(None).cast("string").alias("title"), F.lit("").alias("summary"), "content", F.col("m").cast("date").alias("modified"))
    asked = [(-1, "Which red widget or wigdet?", "2024-05-01"), (2, "gardens", "2024-03-04"), (3, "recipe and absent things of a commute yesterday", "2023-01-01"), (4, "the", "2024-01-01"), (5, None, "2024-01-01"), (6, "bolts blues", None)]
    asked = spark.createDataFrame(asked, "query_no int, question string, d string").select("query_no", "question", F.col("d").cast("date").alias("day"))
    passes, hold = [], search._held
    monkeypatch.setattr(search, "_held", lambda rows, *more: (passes.append(1), hold(rows, *more))[1])

    def run():
        found = retry.cascade(asked, rows, F.col("modified") <= F.lit("2024-04-30").cast("date"), lambda: questions.date_hints(F.col("question"), F.col("day")), lambda ids: rows.join(ids, "chunk_id", "left_semi"), 3)
        return [sorted(map(tuple, f.collect())) for f in found]

    few = run()
    assert len(passes) == 1 and {r[1] for r in few[0]} == {0, 1, 3, 4, 5, 6} and few[1]
    monkeypatch.setattr(search, "FEW_TERMS", 1)
    monkeypatch.setattr(retry, "FEW_WORDS", 1)
    assert run() == few


def test_only_hits_are_made_again(spark):
    """Of documents, as of notes, those that were found are read again, no others."""
    ids = spark.createDataFrame([(3,), (-2,)], "chunk_id long")
    assert sorted(r.chunk_id for r in hits.searched(spark, "/root/testdata/sf0.001", ids).collect()) == [-2, 3]
