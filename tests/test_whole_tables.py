"""Queries that run over every row of their tables, on small tables against brute force."""

import re

import duckdb

from tidewell.plans import registry


def test_similar_names_and_sentences_of_whole_tables(spark, tmp_path):
    """Parts of every size at 0.3 against all pairs, and texts with titles of persons."""
    names = ["red tin bolt", "red tin nut", "blue tin nut", "old oak door", "new oak door frame", "", None]
    parts = [(10 * size + i, n, "LARGE" if i % 2 else "SMALL BOX", size) for size in (7, 8, 9) for i, n in enumerate(names)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    sets = {k: frozenset(re.findall("[a-z0-9]+", f"{n or ''} {t}".lower())) for k, n, t, _ in parts}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.3 * len(sets[a] | sets[b])
    want = {(a, min(b for b in sets if sets[b] == sets[a]), sum(alike(a, b) for b in sets if b != a)) for a in sets}
    assert {tuple(r) for r in registry.QUERIES["m23_similar_names"](spark, str(tmp_path)).collect()} == want
    turns = [(1, 1, "I saw Dr. Who. It was fun!"), (1, 2, "Prof. X met Mrs. Y"), (1, 3, "One. Two."), (1, 4, ""), (1, 5, None)]
    spark.createDataFrame(turns, "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.turn: r.n for r in registry.QUERIES["m9_sentences"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    by_sql = {turn: n for _, turn, n in con.execute(registry.ORACLE_SQL["m9_sentences"]).fetchall()}
    assert got == by_sql == {1: 2, 2: 1, 3: 2, 4: 0}


def test_title_pairs_of_whole_titles(spark, tmp_path):
    """Titles that differ only after 80 characters, against all pairs by trigrams."""
    head = "a title that goes on for a good deal more than the eighty characters of its beginning and then "
    titles = [head + "ends", head + "tells of quite other things: " + "zebra quagga okapi " * 4, head + "ends so", "short", None, "x" * 81 + " one", "x" * 81 + " two"]
    spark.createDataFrame([(i, t and t + ". More.") for i, t in enumerate(titles)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    grams = lambda t: {f"${w}$"[i : i + 3] for w in re.findall("[a-z0-9]+", t) for i in range(len(w))}
    sets = {i: grams(t) for i, t in enumerate(titles) if t}
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    want = {(a, b, round(x, 9)) for (a, b), x in alike.items() if x >= 0.85}
    assert (0, 2) in {x[:2] for x in want} and (0, 1) not in {x[:2] for x in want}
    assert {tuple(r) for r in registry.QUERIES["t20_title_pairs"](spark, str(tmp_path)).collect()} == want
