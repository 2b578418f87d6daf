import random

import duckdb

from tidewell.llm import topk, vector_codes as V

SF = "/root/testdata/sf0.001"


def brute(vectors, parts, entries, rounds):
    """vec_id -> (code, error), and the last entries; vectors: (vec_id, whole numbers), all of one length."""
    w = len(vectors[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    first = sorted(vectors)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    for r in range(rounds + 1):
        near = [[min(range(len(books[p])), key=lambda j: (far(cut(v, p), books[p][j]), j)) for p in range(parts)] for _, v in vectors]
        if r == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [cut(v, p) for (_, v), n in zip(vectors, near) if n[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    return {i: (n, sum(far(cut(v, p), books[p][n[p]]) for p in range(parts))) for (i, v), n in zip(vectors, near)}, books


def frame(spark, vectors):
    return spark.createDataFrame([(i, i % 3, v) for i, v in vectors], "vec_id long, label int, v array<long>").repartition(5)


def check(spark, vectors, parts=2, entries=16, rounds=3):
    coded, books = V.vector_codes(frame(spark, vectors), parts, entries, rounds)
    want, entries_ = brute(vectors, parts, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == want
    assert books.parts == entries_


def test_against_brute_force_with_clusters_and_ties(spark):
    r = random.Random(5)
    clustered = [(i, [50 * r.randrange(4) + r.randrange(-2, 3) for _ in range(8)]) for i in range(400)]
    check(spark, clustered)
    check(spark, [(i, [r.randrange(2) for _ in range(4)]) for i in range(200)])  # many equal vectors and ties
    check(spark, [(i, [-7, 3, -7, 3]) for i in range(40)])  # entries that stay unused


def test_numbers_beyond_doubles_and_few_vectors(spark):
    r = random.Random(6)
    check(spark, [(i, [r.randrange(-(2**28), 2**28) for _ in range(4)]) for i in range(60)])
    check(spark, [(i, [r.randrange(9) for _ in range(4)]) for i in range(5)])


def test_nulls_lengths_repeats_and_extra_columns(spark):
    rows = [(1, 0, [1, 2, 3]), (1, 0, [1, 2, 3]), (2, None, [9]), (None, 1, [5, 5, 5]), (3, 1, None), (4, 1, [])]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, label int, v array<long>, code string")
    coded, books = V.vector_codes(df, 2, 4, 2)
    got = sorted((str(r.vec_id), r.code, r.error) for r in coded.collect())
    want, entries = brute([(i, x) for i, x in ((1, [1, 2, 3, 0]), (1, [1, 2, 3, 0]), (2, [9, 0, 0, 0]), (4, [0] * 4), (9, [5, 5, 5, 0]))], 2, 4, 2)
    assert books.parts == entries and len(got) == 5
    assert got == sorted((str(i if i != 9 else None), *want[i]) for i in (1, 1, 2, 4, 9))
    none, books = V.vector_codes(df.limit(0))
    assert none.count() == 0 and books is None


def test_query_equals_its_sql_and_an_empty_table(spark, tmp_path):
    got = V.op11_vector_codes(spark, SF)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    assert sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())) == sorted(con.execute(V.OP11_SQL).fetchall())
    table = [(1, [0.5, float("nan")], 1), (2, None, 1), (3, [None, 1.0], None)]
    spark.createDataFrame(table, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert V.op11_vector_codes(spark, str(tmp_path)).count() == 0
    assert topk.scaled(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int"), keep=("label",)).columns == ["vec_id", "label", "v"]
