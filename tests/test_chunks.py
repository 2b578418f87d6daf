"""What sentence-bounded chunks must keep, and plain text."""

import re

from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import chunks
from tidewell.plans import registry


def test_segments_keep_every_word_in_order():
    text = "# One\n" + "A sentence here. " * 200 + "\n## Two\nshort\n# Three\n" + "x" * 5000 + "! yes? no\n\n" + "word " * 500
    got = chunks.segment(text)
    assert re.sub(r"\s+", "", "".join(got)) == re.sub(r"\s+", "", text)
    assert all(len(c) <= chunks.MOST + chunks.LEAST + 2 for c in got)
    assert got[0].startswith("# One") and got[0].endswith(".")
    assert chunks.segment("") == [] and chunks.segment("   ") == [] and chunks.segment("tiny") == ["tiny"]


def test_cut_prefers_the_last_mark_of_the_first_kind():
    assert chunks.sentence_cut("a" * 70 + "\n\n" + "b" * 10 + ". " + "c" * 50, 100) == 72
    assert chunks.sentence_cut("a" * 70 + ". b. " + "c" * 50, 100) == 75
    assert chunks.sentence_cut("a" * 70 + "! b? " + "c" * 50, 100) == 72
    assert chunks.sentence_cut("a. " + "b" * 150, 100) == 100


def test_segments_of_the_table(spark):
    rows = registry.QUERIES["t11_segments"](spark, "/root/testdata/sf0.001").groupBy("doc_id").agg(F.max("ordinal").alias("last"), F.count("*").alias("n"))
    assert rows.where("n <> last + 1").count() == 0 and rows.count() > 100


def test_plain_text(spark):
    df = spark.createDataFrame([("ﬁne​ x­²",), ("",), (None,)], "text string")
    assert [r.t for r in df.select(T.plain(F.col("text")).alias("t")).collect()] == ["fine x2", "", None]


def test_heading_paths(spark):
    df = spark.createDataFrame([(1, "intro\n# A\ntext\n### B\nx\n## C\ny\n# D"), (2, None), (3, "")], "id int, text string")
    got = [(r.id, r.path, r.section.split("\n")[0]) for r in chunks.heading_paths(df, "id", "text").orderBy("id", "ordinal").collect()]
    assert got == [(1, "", "intro"), (1, "A", "# A"), (1, "A > B", "### B"), (1, "A > C", "## C"), (1, "D", "# D")]
