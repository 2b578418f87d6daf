"""Rows that the pipeline must not lose: null ids, different texts under one id, no known language."""

import corpus_pipeline as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(name, n=40):
    return " ".join(f"{name}{i}" for i in range(n))


def stage(f, spark, rows):
    got = f(spark, spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows], SCHEMA), "")
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)


def test_null_ids_stay(spark):
    rows = [(1, words("a"), "en"), (2, words("a") + " more", "en"), (None, words("b"), "en"), (None, words("c"), "en")]
    assert stage(C.drop_near_duplicates, spark, rows) == sorted([(1, words("a")), (None, words("b")), (None, words("c"))], key=str)


def test_texts_under_one_id_are_documents(spark):
    """Id 5's second text is no copy of its first, which goes as a copy of id 1; id 7 is a near copy of the second."""
    rows = [(1, words("a"), "en"), (5, words("a") + " more", "en"), (5, words("b"), "en"), (5, words("b"), "en"), (7, words("b") + " more", "en"), (5, words("c"), "en"), (None, words("c"), "en")]
    assert stage(C.drop_near_duplicates, spark, rows) == sorted([(1, words("a")), (5, words("b")), (5, words("c")), (None, words("c"))], key=str)


def test_no_language_learned(spark):
    rows = [(1, words("a"), None), (2, "12 34", None), (3, None, None), (4, "", None)]
    assert stage(C.identify_language, spark, rows) == [(1, words("a"))]


def test_all_stages_keep_them(spark, tmp_path):
    rows = [(1, words("a"), None, "s", 1), (1, words("b"), None, "s", 1), (None, words("c"), None, "s", 1), (None, words("d"), None, "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words("bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = C.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "None", "None"] and len({r.ids_sha256 for r in got}) == 4


def test_extra_columns_and_marks_stay(spark, tmp_path):
    """Columns with the stages' own names, an array, a null date, and U+FFFD characters of a text that loses bytes."""
    shared = "the shared passage is long enough to be removed from all of the documents but the first one, as it is over one hundred bytes"
    rows = [(1, words("a") + shared + " \ufffd é", "en", "s", 1, 1.5, "x", [1], None), (2**60 + 1, words("b") + " \ufffd ü " + shared, "en", "s", 1, None, None, None, None), (3, "", None, "s", None, 0.0, "y", [], None)]
    spark.createDataFrame(rows, SCHEMA + ", score double, `lang_pred` string, _kept array<int>, `at it` date").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words("bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, str(tmp_path)))
        assert docs.columns == columns
    got = {r.doc_id: r for r in docs.collect()}
    assert set(got) == {1, 2**60 + 1} and got[1]["text"] == rows[0][1] and got[1]["_kept"] == [1] and got[1]["score"] == 1.5
    assert got[2**60 + 1]["text"] == words("b") + " \ufffd ü " and got[2**60 + 1]["lang_pred"] is None


def test_empty_tables_and_missing_columns(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
    bare = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in C.tokenize(spark, bare, str(tmp_path)).collect()}
    assert got[1] > 0 and got[2] == 0
    assert C.drop_contaminated(spark, bare, str(tmp_path)).count() == 2


def test_very_long_texts(spark, tmp_path):
    """Texts of some megabytes pass all stages: a long run of one letter, many words, one that holds the other."""
    long = words("long", 200_000)
    rows = [(1, long, "en", "s", len(long)), (2, "x" * 2_000_000, "en", "s", 1), (3, "before " + words("short"), "en", "s", 1), (4, "y" * 50 + long[:500_000], "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words("bench"))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        docs = C.cut(stage(spark, docs, str(tmp_path)))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert kept[1] == long and kept[3] == rows[2][1] and kept[2] == "x"
    assert kept[4].startswith("y" * 50) and len(kept[4]) < 200
    assert C.tokenize(spark, docs, str(tmp_path)).count() == 4
