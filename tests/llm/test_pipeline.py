import hashlib

import corpus_pipeline as C
from tidewell.llm import decontaminate, suffix_dedup
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import classes

ROWS = (
    [(i, f"Document {i} tells of {' '.join(f'thing{i}x{j}' for j in range(30))}.", "en", "s", 1) for i in range(8)]
    + [(20, f"Document 3 tells of {' '.join(f'thing3x{j}' for j in range(30))}.", "en", "s", 1)]
    + [(30 + i, f"Own words {i} {i * 7} " + "the shared passage is long enough to be removed from all of the documents but the first one, as it is over one hundred bytes", "en", "s", 1) for i in range(3)]
    + [(40, None, None, "s", 1), (41, "123 456", "en", "s", 1), (42, "alpha " + " ".join(f"bench{j}" for j in range(20)), "en", "s", 1)]
)


def test_each_stage_on_its_own_input(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, " ".join(f"bench{j}" for j in range(20)))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, got = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in C.STAGES:
        docs = C.cut(stage(spark, docs, str(tmp_path)))
        got[name] = {r.doc_id: r.asDict() for r in docs.collect()}
        if name != "tokenize":
            assert docs.columns == columns
    assert set(got["language_id"]) == {r[0] for r in ROWS} - {40, 41}
    before = [(i, r["text"]) for i, r in got["language_id"].items()]
    assert set(got["near_dedup"]) == {i for i, c in classes(before) if i == c}
    before = [(i, r["text"]) for i, r in got["near_dedup"].items()]
    for i, _, removed, _, kept in suffix_dedup.brute_force(before):
        assert hashlib.sha256(got["suffix_dedup"][i]["text"].encode()).hexdigest() == kept and (removed > 0) == (i in (31, 32))
        assert got["suffix_dedup"][i]["n_chars"] == (len(got["suffix_dedup"][i]["text"]) if removed else 1)
    before = [(i, r["text"]) for i, r in got["suffix_dedup"].items()]
    assert set(got["decontaminate"]) == {r[0] for r in contaminated(before, items, decontaminate.WINDOW) if not r[4]}
    assert set(got["tokenize"]) == set(got["decontaminate"])
    final = {r.doc_id: r.ids_sha256 for r in C.run(spark, str(tmp_path)).collect()}
    assert final == {i: r["ids_sha256"] for i, r in got["tokenize"].items()}
