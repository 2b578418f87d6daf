"""Queries of aggregation and evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats
from ..session import table
from ..sources.hits import HITS_SQL, hits, notes
from ..sources.corpus import corpus
from .registry import query
from .search_queries import C


@query("a1_rows_by_scope", C + " SELECT scope, count(*) AS n FROM corpus GROUP BY scope")
def a1(spark, d):
    return corpus(spark, d).groupBy("scope").agg(F.count("*").alias("n"))


NORM = "trim(regexp_replace(lower(coalesce({}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("a3_exact_match_scores", f"""WITH x AS (SELECT source AS category, strpos({NORM.format('text')}, {NORM.format("'licensed under the'")}) > 0 AS hit FROM documents),
p AS (SELECT category, count(*) AS run, count(*) FILTER (WHERE hit) AS correct FROM x GROUP BY category)
SELECT category, run, correct, round(correct / run, 9) AS score FROM p UNION ALL SELECT 'overall', sum(run), sum(correct), round(sum(correct) / sum(run), 9) FROM p
UNION ALL SELECT 'average', sum(run), sum(correct), round(avg(correct / run), 9) FROM p""")
def a3(spark, d):
    hit = stats.exact_match(F.col("text"), F.lit("licensed under the"))
    return stats.scores(table(spark, d, "documents").select(F.col("source").alias("category"), hit.alias("hit")))


@query("a5_bootstrap")
def a5(spark, d):
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    return stats.bootstrap(rows, "quality")


@query("a6_bootstrap_by_category")
def a6(spark, d):
    """Intervals of each event type. No SQL, as with a5: tested against the normal approximation and other partitionings."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("category"), (F.col("value") > 50).cast("int").alias("hit"))
    return stats.bootstrap(rows, "hit", group="category")


@query("a7_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) FILTER (WHERE i >= ceil(n * 0.5)) AS p50, min(value) FILTER (WHERE i >= ceil(n * 0.95)) AS p95 FROM r GROUP BY event_type""")
def a7(spark, d):
    return stats.nearest_rank(table(spark, d, "events"), "event_type", "value", [50, 95])


ALLOC_SQL = "WITH c AS (SELECT event_type AS category, count(*) AS n FROM events GROUP BY 1)"


@query("a8_stratified_allocation", ALLOC_SQL + """, s AS (SELECT *, floor(n * 101 / sum(n) OVER ()) AS fl, n * 101 / sum(n) OVER () AS sh FROM c),
k AS (SELECT *, row_number() OVER (ORDER BY round(sh - fl, 12) DESC, category) AS i, 101 - sum(fl) OVER () AS rest FROM s)
SELECT category, n, CAST(fl + CASE WHEN i <= rest THEN 1 ELSE 0 END AS BIGINT) AS take FROM k""")
def a8(spark, d):
    return stats.allocate(table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")), 101)


@query("a8_sample")
def a8_sample(spark, d):
    """101 events by stratified allocation and seeded draws. No SQL: the allocation has some, the draws are tested against the shuffle itself."""
    events = table(spark, d, "events")
    return stats.seeded_sample(events, "event_type", "event_id", stats.allocate(events.groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")), 101), 7)


@query("a9_draws")
def a9_draws(spark, d):
    """Five orders of each priority by a seeded draw. No SQL, as above."""
    orders = table(spark, d, "orders")
    takes = orders.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count("*").alias("n")).withColumn("take", F.lit(5))
    return stats.seeded_sample(orders, "o_orderpriority", "o_orderkey", takes, 42)


@query("a18_equal_allocation", ALLOC_SQL + " SELECT category, n, CAST(least(n, 103 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY category) <= 103 % count(*) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS take FROM c")
def a18(spark, d):
    return stats.allocate_equal(table(spark, d, "events").groupBy(F.col("event_type").alias("category")).agg(F.count("*").alias("n")), 103)


@query("a10_cost", "SELECT p_brand AS model, round(sum((l_quantity * p_retailprice + l_tax * p_retailprice * 0.1) / 1e6), 6) AS usd FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def a10(spark, d):
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    used = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_tax").alias("t"))  # before the join
    usd = F.sum((F.col("q") * F.col("p_retailprice") + F.col("t") * F.col("p_retailprice") * 0.1) / 1e6)
    return used.join(prices, "l_partkey").groupBy(F.col("p_brand").alias("model")).agg(F.round(usd, 6).alias("usd"))


@query("a11_recall_at_k", """WITH h AS (SELECT o_custkey AS question, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
w AS (SELECT o_custkey AS question, o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT w.question, bool_or(h.id IS NOT NULL) AS passed FROM w LEFT JOIN h ON w.question = h.question AND w.id = h.id AND rank <= 3 GROUP BY 1""")
def a11(spark, d):
    from pyspark.sql.window import Window

    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderpriority")
    hits = orders.select("question", "id", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("o_totalprice"), "id")).alias("rank"))
    return stats.recall_at(hits, orders.where("o_orderpriority = '1-URGENT'").select("question", "id"), 3)


@query("a13_confidence", "SELECT user_id, event_type, CASE WHEN count(*) >= 4 THEN 'high' WHEN count(*) >= 2 THEN 'medium' ELSE 'low' END AS confidence FROM events GROUP BY ALL")
def a13(spark, d):
    n = F.count("*")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.when(n >= 4, "high").when(n >= 2, "medium").otherwise("low").alias("confidence"))


@query("a14_signals", "SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS from_user, count(*) FILTER (WHERE role = 'assistant') AS from_assistant, bool_or(strpos(lower(text), 'license') > 0) AS mentions FROM conversations GROUP BY conv_id")
def a14(spark, d):
    role = lambda r: F.count_if(F.col("role") == r)
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), role("user").alias("from_user"), role("assistant").alias("from_assistant"), F.bool_or(F.lower("text").contains("license")).alias("mentions")
    )


@query("a17_duplicate_titles", C + " SELECT lower(trim(title)) AS title, count(*) AS n FROM corpus GROUP BY 1 HAVING count(*) >= 2")
def a17(spark, d):
    return corpus(spark, d).groupBy(F.lower(F.trim("title")).alias("title")).agg(F.count("*").alias("n")).where("n >= 2")


@query("a20_report_diff", """WITH a AS (SELECT doc_id AS q, quality AS v FROM labels WHERE doc_id % 5 <> 0), b AS (SELECT doc_id AS q, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS v FROM labels WHERE doc_id % 7 <> 0)
SELECT coalesce(a.q, b.q) AS question, CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'removed' WHEN b.v > a.v THEN 'better' WHEN b.v < a.v THEN 'worse' ELSE 'same' END AS change FROM a FULL JOIN b ON a.q = b.q""")
def a20(spark, d):
    x = table(spark, d, "labels")
    a = x.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("question"), F.col("quality").alias("v"))
    b = x.where("doc_id % 7 <> 0").select(F.col("doc_id").alias("question"), F.when(F.col("doc_id") % 4 == 0, 1 - F.col("quality")).otherwise(F.col("quality")).alias("w"))
    change = F.when(F.col("v").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("w") > F.col("v"), "better").when(F.col("w") < F.col("v"), "worse").otherwise("same")
    return a.join(b, "question", "full").select("question", change.alias("change"))


@query("a11_question_recall", f"""WITH {HITS_SQL}, about AS (SELECT CAST(n_nationkey AS INT) AS query_no, p_name FROM nation JOIN part ON p_partkey = n_nationkey),
w AS (SELECT query_no, chunk_id, source_role = 'user' AND state_key <> '' AS must FROM about JOIN notes ON contains(content, ' ' || p_name) WHERE contains(path, 'user-fact')),
h AS (SELECT w.*, rank IS NOT NULL AS hit FROM w LEFT JOIN (SELECT query_no, chunk_id, rank FROM hits WHERE rank <= 10) USING (query_no, chunk_id))
SELECT query_no, count(*) AS wanted, count(*) FILTER (hit) AS found, bool_or(hit) AS passed_any, bool_and(hit OR NOT must) AS passed_all FROM h GROUP BY query_no""")
def a11_questions(spark, d):
    """Recall at ten of the search: of each question the notes of facts about its part, of which the user's keyed states must be found."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("n_nationkey"), "p_name")
    about = table(spark, d, "nation").join(part, "n_nationkey").select(F.col("n_nationkey").cast("int").alias("query_no"), "p_name")
    facts = notes(spark, d).where(F.col("path").contains("user-fact")).select("chunk_id", "item", ((F.col("source_role") == "user") & (F.col("state_key") != "")).alias("must"))
    return stats.recall_of(hits(spark, d), about.join(facts, F.col("item") == F.col("p_name")).select("query_no", "chunk_id", "must"))
