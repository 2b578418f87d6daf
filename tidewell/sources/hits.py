"""Questions, notes and what a search finds: the best rows of the corpus and of the notes for each question, by BM25.

Notes are sentences about orders, one for each order that has lines; questions ask about parts, one for
each supplier. What is searched for is a stated set of questions, one for each nation, against all rows, so that a
search grows with these; each hit holds its row's whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import search
from ..operators.retry import first_terms
from ..session import cut, table
from .corpus import CORPUS_SQL, corpus, scope_of

#: Hits of a question.
K = 60
QUESTIONS = [
    "How many dollars did I spend on the {a} and on the {b} in total?",
    "Can you recommend a {a}? I want some ideas",
    "When did I order the {a}, three weeks ago or last week?",
    "Remind me of the exact {a} you suggested in our previous conversation",
    "How long is my daily commute with the {a}?",
    "Which {a} am I using now?",
    "What should I do with the {a} or the {b}? Any tips",
    "How much did I earn with the {a} and with the {b} last Saturday?",
    "Tell me about the {a}",
    "How many days ago did I buy a {a} when I sold the {b}?",
    "How many different types of {a} have I bought for my workshop?",
    "How many items of the list did I complete, including pieces of the {a}, the {b} and tasks of the garden?",
    "I am stuck with my {a}, where do I find inspiration from Old Town Gallery of Paris or 'quiet {b}'?",
    "What transport did I take with the {a} between March and June?",
    "What is the latest price of the {a} AND the {b} yesterday?",
    "How many days passed between the {a} order and the {b} donation?",
    "What was the second recipe for the {a} you gave me in our previous chat?",
    "Did I donate or sell the {b}, and how many hours did the {a} take overall?",
    "How often do I use the cross-platform {a} products and Second Hand Market tools? It is 2 years old",
    "Looking back at our previous chat, what was the chorus of the song about the {a} you wrote?",
    "In our last conversation you gave me instructions for the {b}, what were the first steps?",
]
NOTES = [
    "I bought {qty} {item}s for ${price} on {month} {day}.",
    "We spent ${price} on the {item} and sold {n} of them.",
    "Summary: overall I spent ${price} in total on {item}s.",
    "The user prefers the {item} and likes quick delivery.",
    "Here are some tips and options for a guide to the {item}.",
    "[date: {iso}]\nI picked up the {item} with customer {cust}.",
    "My daily commute with the {item} is {qty} minutes each way every weekday.",
    "The morning commute is often around {n} hours with the {item}.",
    "I plan to budget ${price} for a new {item}.",
    "What should I do about the {item}? Any advice would help.",
    "I no longer use the {item}; it was replaced by customer {cust}.",
    "I currently use the {item} and still own {n} of them.",
    "Recap of the ledger: ${price} for the {item}.",
    "We donated {qty} {item}s and raised ${price} on {month} {day}.",
    "Superseded by a later note on the {item}.",
    "I spent ${price} on a {item} and {n} hours on the recipe.",
]
KINDS = ["user-fact", "user-fact", "summary", "user-preference", "guide", "milestone", "user-fact", "note", "plan", "question", "note", "user-fact", "ledger", "milestone", "note", "user-fact"]
#: Columns that hits carry besides question, score and rank.
ROW = ["chunk_id", "path", "title", "summary", "tag_text", "content", "scope", "session_id", "source_role", "modified", "superseded_by", "state_key", "state_kind", "state_subject", "valid_from", "valid_to"]


def _pick(values: list[str], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(values) + 1).cast("int"))


def _filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def notes(spark, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """One row of the corpus for each order that has lines: a sentence about its first part, with state metadata. ``only`` (chunk_id, few rows) are made, if it is given."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if only is not None:
        keys = F.broadcast(only.select((-1 - F.col("chunk_id")).alias("_key")))
        orders, lines = orders.join(keys, F.col("o_orderkey") == F.col("_key"), "left_semi"), lines.join(keys, F.col("l_orderkey") == F.col("_key"), "left_semi")
    lines = lines.groupBy("l_orderkey").agg(F.min("l_partkey").alias("part"), F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("qty"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("item"))
    rows = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).join(part, "part")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    values = {"qty": F.col("qty"), "item": F.col("item"), "price": F.format_string("%.2f", "o_totalprice"), "n": F.col("n"), "month": F.date_format(day, "MMMM"), "day": F.dayofmonth(day), "iso": day, "cust": F.col("o_custkey")}
    global_ = F.col("o_custkey") % 3 != 0
    path = F.concat(F.when(global_, "notes/global/").otherwise("notes/project/work/"), _pick(KINDS, k), F.lit("-"), k, F.lit(".md"))
    state = k % len(NOTES) == NOTES.index("I currently use the {item} and still own {n} of them.")
    return rows.select(
        (-1 - k).alias("chunk_id"),
        path.alias("path"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("tag_text"),
        _filled(_pick(NOTES, k), values).alias("content"),
        F.when(global_, "global_notes").otherwise("project_notes").alias("scope"),
        F.concat(F.lit("c"), "o_custkey").alias("session_id"),
        F.when(k % 5 < 3, "user").when(k % 5 == 3, "assistant").otherwise("").alias("source_role"),
        day.alias("modified"),
        F.when((F.col("o_orderstatus") == "F") & (k % 4 == 0), F.concat(k + 1, F.lit(".md"))).otherwise("").alias("superseded_by"),
        F.when(state & (k % 3 > 0), F.concat(F.lit("use."), F.replace("item", F.lit(" "), F.lit(".")))).otherwise("").alias("state_key"),
        F.when(state, "use").otherwise("").alias("state_kind"),
        F.when(state, F.col("item")).otherwise("").alias("state_subject"),
        F.when(state, F.date_format(day, "yyyy-MM-dd")).otherwise("").alias("valid_from"),
        F.when(state & (k % 2 == 0), F.date_format(F.date_add(day, 400), "yyyy/MM/dd")).otherwise("").alias("valid_to"),
        "item",
    )


def searched(spark, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """The rows that are searched: the corpus and the notes; those of ``only`` (chunk_id, few rows), if it is given."""
    none = {c: F.lit("") for c in ("state_key", "state_kind", "state_subject", "valid_from", "valid_to")}
    return corpus(spark, sf_dir, only).withColumns(none).select(*ROW).unionByName(notes(spark, sf_dir, only).select(*ROW))


def _questions(spark, sf_dir: str, name: str, key: str) -> DataFrame:
    k = F.col(key)
    part = lambda x: table(spark, sf_dir, "part").select(F.col("p_partkey").alias(x + "_key"), F.col("p_name").alias(x))
    rows = table(spark, sf_dir, name).join(part("a"), F.col("a_key") == k).join(part("b"), F.col("b_key") == 2 * k + 1)
    day = F.date_add(F.lit("1999-01-01").cast("date"), (k * 13 % 900).cast("int"))
    return rows.select(k.cast("int").alias("query_no"), _filled(_pick(QUESTIONS, k), {"a": F.col("a"), "b": F.col("b")}).alias("question"), day.alias("day"))


def asked(spark, sf_dir: str) -> DataFrame:
    """(query_no, question, day): one question for each supplier, about two parts, and the day on which it is asked."""
    return _questions(spark, sf_dir, "supplier", "s_suppkey")


def posed(spark, sf_dir: str) -> DataFrame:
    """The questions that are searched for, a stated set against all rows: one for each nation, as asked() has them."""
    return _questions(spark, sf_dir, "nation", "n_nationkey")


def hits(spark, sf_dir: str, k: int = K) -> DataFrame:
    """The ``k`` best rows of each question: query_no, question, day, the row's columns, text (path, title, summary and content, lower-cased), score and rank."""
    rows, questions = searched(spark, sf_dir), posed(spark, sf_dir)
    wanted = questions.select("query_no", F.explode(first_terms(F.col("question"))).alias("term"))
    best = cut(search.bm25_best(rows, wanted, k))  # k rows a question
    rows = searched(spark, sf_dir, best.select("chunk_id").distinct())
    return F.broadcast(best.join(questions, "query_no")).join(rows, "chunk_id").withColumn("text", F.lower(F.concat_ws("\n", "path", "title", "summary", "content")))


def _literals(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for v in values) + "]"


def _filled_sql(template: str, values: dict[str, str]) -> str:
    for name, value in values.items():
        template = f"replace({template}, '{{{name}}}', CAST({value} AS VARCHAR))"
    return template


def _pick_sql(values: list[str], i: str) -> str:
    return f"{_literals(values)}[1 + {i} % {len(values)}]"


_STATE = f"o_orderkey % {len(NOTES)} = {NOTES.index('I currently use the {item} and still own {n} of them.')}"
_NOTE = _filled_sql(_pick_sql(NOTES, "o_orderkey"), {"qty": "qty", "item": "p_name", "price": "printf('%.2f', o_totalprice)", "n": "n", "month": "strftime(o_orderdate, '%B')", "day": "day(o_orderdate)", "iso": "CAST(o_orderdate AS DATE)", "cust": "o_custkey"})
#: The notes, and the rows that are searched, in SQL.
SEARCHED_SQL = f"""{CORPUS_SQL},
notes AS (SELECT -1 - o_orderkey AS chunk_id, CASE WHEN o_custkey % 3 <> 0 THEN 'notes/global/' ELSE 'notes/project/work/' END || {_pick_sql(KINDS, "o_orderkey")} || '-' || o_orderkey || '.md' AS path,
    CAST(NULL AS VARCHAR) AS title, CAST(NULL AS VARCHAR) AS summary, CAST(NULL AS VARCHAR) AS tag_text, {_NOTE} AS content, CASE WHEN o_custkey % 3 <> 0 THEN 'global_notes' ELSE 'project_notes' END AS scope,
    'c' || o_custkey AS session_id, CASE WHEN o_orderkey % 5 < 3 THEN 'user' WHEN o_orderkey % 5 = 3 THEN 'assistant' ELSE '' END AS source_role, CAST(o_orderdate AS DATE) AS modified,
    CASE WHEN o_orderstatus = 'F' AND o_orderkey % 4 = 0 THEN (o_orderkey + 1) || '.md' ELSE '' END AS superseded_by,
    CASE WHEN {_STATE} AND o_orderkey % 3 > 0 THEN 'use.' || replace(p_name, ' ', '.') ELSE '' END AS state_key, CASE WHEN {_STATE} THEN 'use' ELSE '' END AS state_kind, CASE WHEN {_STATE} THEN p_name ELSE '' END AS state_subject,
    CASE WHEN {_STATE} THEN strftime(o_orderdate, '%Y-%m-%d') ELSE '' END AS valid_from, CASE WHEN {_STATE} AND o_orderkey % 2 = 0 THEN strftime(CAST(o_orderdate AS DATE) + 400, '%Y/%m/%d') ELSE '' END AS valid_to
  FROM orders JOIN (SELECT l_orderkey, min(l_partkey) AS part, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem GROUP BY l_orderkey) l ON o_orderkey = l_orderkey JOIN part ON p_partkey = part),
searched AS (SELECT chunk_id, path, title, summary, tag_text, content, scope, session_id, source_role, modified, superseded_by, '' AS state_key, '' AS state_kind, '' AS state_subject, '' AS valid_from, '' AS valid_to FROM corpus
  UNION ALL SELECT * FROM notes)"""


def _questions_sql(name: str, key: str) -> str:
    return f"""asked AS (SELECT CAST({key} AS INT) AS query_no, {_filled_sql(_pick_sql(QUESTIONS, key), {"a": "a.p_name", "b": "b.p_name"})} AS question, DATE '1999-01-01' + CAST({key} * 13 % 900 AS INT) AS day
  FROM {name} JOIN part a ON a.p_partkey = {key} JOIN part b ON b.p_partkey = 2 * {key} + 1)"""


#: The questions as ``asked``: those of all suppliers, and those that are searched for.
ASKED_SQL, POSED_SQL = _questions_sql("supplier", "s_suppkey"), _questions_sql("nation", "n_nationkey")
TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}]+')"


def any_word(words: list[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


TERMS_SQL = f"list_distinct(list_filter({TOK.format('question')}, lambda t: strlen(t) > 2 AND t NOT IN {any_word(W.RETRY_STOP)}))"


def bm25_table_sql(rows: str, wanted: str, name: str) -> str:
    """WITH entries down to ``name`` (query_no, chunk_id, score): BM25 of the rows of ``rows`` for the (query_no, term) of ``wanted``."""
    length = " + ".join(f"len({TOK.format(f)})" for f in search.FIELDS)
    every = " UNION ALL ".join(f"SELECT chunk_id, unnest({TOK.format(f)}) AS term, {w} AS w FROM {rows}" for f, w in search.FIELDS.items())
    return f"""{name}_st AS (SELECT count(*) AS n, avg({length}) AS avg_len FROM {rows}), {name}_ln AS (SELECT chunk_id, {length} AS len FROM {rows}),
{name}_tf AS (SELECT chunk_id, term, sum(w) AS f FROM ({every}) WHERE term IN (SELECT term FROM {wanted}) GROUP BY ALL), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name} AS (SELECT query_no, chunk_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 9) AS score
  FROM {name}_tf JOIN {name}_df USING (term) JOIN {name}_ln USING (chunk_id) JOIN {wanted} USING (term), {name}_st GROUP BY query_no, chunk_id)"""


#: The hits in SQL, to stand behind WITH.
HITS_SQL = f"""{SEARCHED_SQL}, {POSED_SQL}, wanted AS (SELECT query_no, unnest({TERMS_SQL}) AS term FROM asked), {bm25_table_sql("searched", "wanted", "bm")},
hits AS MATERIALIZED (SELECT b.query_no, question, day, s.*, lower(concat_ws(chr(10), path, title, summary, content)) AS text, score, CAST(rank AS INT) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_no ORDER BY score DESC, chunk_id) AS rank FROM bm QUALIFY rank <= {K}) b JOIN asked USING (query_no) JOIN searched s USING (chunk_id))"""


#: What turns of the conversations begin with.
TOLD = [
    "I bought a bike for $120.50 at the market on March 3rd.",
    "We spent $30 on books and $12 on tea.",
    "Summary: overall I spent $162.50 in total this month.",
    "The user prefers quiet hotels and likes the sea.",
    "Here are some tips and options for a guide to the city.",
    "[date: 2024-02-10] I visited the museum with Ann.",
    "My daily commute is 45 minutes each way every weekday.",
    "The morning commute is often around 30 minutes.",
    "I plan to budget $200 for a new bike.",
    "What should I do about the garden? Any advice would help.",
    "I no longer take yoga classes downtown; that was replaced by the river studio.",
    "I currently take yoga classes at the river studio.",
    "Recap of the ledger: $162.50 for bike and books.",
    "We sold jam at the fair and earned $75 on June 12th.",
    "superseded by a later note",
]


def talk(spark, sf_dir: str) -> DataFrame:
    """Turns (conv_id, turn, role, text) whose texts begin with a note."""
    c = table(spark, sf_dir, "conversations")
    note = F.element_at(F.array(*[F.lit(v) for v in TOLD + SAID]), ((F.col("conv_id") * 7 + F.col("turn")) % len(TOLD + SAID) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(note, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))


SAID = ["Thanks, that looks good.", "That's wrong, please revert it.", "I have run 12 miles on Monday at 7:30.", "Error: the build failed. Let me retry", "Yesterday I paid £5 for tea."]
TALK_SQL = f"talk AS (SELECT conv_id, turn, role, {_literals(TOLD + SAID)}[1 + (conv_id * 7 + turn) % {len(TOLD + SAID)}] || chr(10) || coalesce(text, '') AS text FROM conversations)"


#: What turns of the transcripts begin with.
RECITED = [
    "Here is the first recipe:\nIngredients: two eggs and a red widget\nInstructions: stir well\nsteps: one, two",
    "Please go on.",
    "Chorus: sing of the blue bolt\nand of the sea\nVerse 2: again",
    "I wrote a poem about the hot gear.",
    "Thanks for the schedule and the email draft.",
    "Second recipe:\ninstructions for the old plate: bake it\n\nOption 2: leave it",
    "No idea.",
]


def transcripts(spark, sf_dir: str) -> DataFrame:
    """(chunk_id, path, content): one row for each session, its turns as '[role]: text' blocks that begin with a line of RECITED."""
    c = table(spark, sf_dir, "conversations")
    said = F.concat(F.lit("["), F.coalesce("role", F.lit("user")), F.lit("]: "), _pick(RECITED, F.col("conv_id") * 3 + F.col("turn")), F.lit("\n"), F.coalesce("text", F.lit("")))
    turns = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", said.alias("said")))).alias("t"))  # a session's turns
    return turns.select(F.col("conv_id").alias("chunk_id"), F.concat(F.lit("raw/eval/"), "conv_id", F.lit(".md")).alias("path"), F.array_join(F.transform("t", lambda x: x["said"]), "\n").alias("content"))
