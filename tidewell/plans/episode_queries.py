"""Queries over sessions as episodes, questions and access tuples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import access, episodes, questions
from ..session import table
from ..functions import words as W
from ..sources.hits import ASKED_SQL, TALK_SQL, any_word, asked, talk
from .intent_queries import FOCUSES, rx
from .probe_queries import PROBES_SQL, bm25_probes, ordered
from .question_sql import HINTS
from .registry import query
from .search_queries import TOK

T = "WITH " + TALK_SQL
OUTCOME = f"""o AS (SELECT conv_id, coalesce(max_by(said, turn) FILTER (said IS NOT NULL), 'partial') AS outcome FROM (SELECT conv_id, turn,
  CASE WHEN role = 'user' THEN CASE WHEN {rx('lower(text)', episodes.SUCCESS)} THEN 'success' WHEN {rx('lower(text)', episodes.FAILURE)} THEN 'failure' END END AS said
  FROM talk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5) GROUP BY conv_id)"""


@query("m15_outcome", f"{T}, {OUTCOME} SELECT user_id AS conv_id, coalesce(outcome, 'unknown') AS outcome FROM (SELECT DISTINCT user_id FROM events UNION SELECT DISTINCT conv_id FROM talk) LEFT JOIN o ON conv_id = user_id")
def m15(spark, d):
    """Outcomes of the sessions that have turns and of those that events speak of."""
    turns = talk(spark, d)
    return episodes.outcome(turns, table(spark, d, "events").select(F.col("user_id").alias("conv_id")).union(turns.select("conv_id")))


TOOLS = "tools AS (SELECT user_id AS conv_id, event_id // 7 AS turn, event_type IN ('purchase', 'signup') AS writes FROM events WHERE event_type <> 'view')"


@query("m13_signals", f"""{T}, {TOOLS}, m AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user' AND {rx('lower(text)', episodes.CORRECTION)}) AS corrections, count(*) FILTER (role <> 'user' AND {rx('lower(text)', episodes.ERROR)}) AS errors FROM talk GROUP BY conv_id),
c AS (SELECT conv_id, count(*) FILTER (writes) AS writes, count(DISTINCT turn) AS rounds FROM tools GROUP BY conv_id)
SELECT m.*, coalesce(writes, 0) AS writes, coalesce(rounds, 0) AS rounds, messages >= 8 AND (coalesce(writes, 0) > 0 OR coalesce(rounds, 0) >= 10 OR corrections > 0) AS reflect, messages >= 4 AND coalesce(writes, 0) > 0 AS record FROM m LEFT JOIN c USING (conv_id)""")
def m13(spark, d):
    """Events other than views are the sessions' tool calls."""
    kind = F.col("event_type")
    tools = table(spark, d, "events").where(kind != "view").select(F.col("user_id").alias("conv_id"), F.floor(F.col("event_id") / 7).alias("turn"), kind.isin("purchase", "signup").alias("writes"))
    return episodes.signals(talk(spark, d), tools)


def _every(pattern: str) -> str:
    return f"regexp_extract_all(text, '{pattern}')"


TAGS = f"list_sort(list_distinct(flatten([{_every(episodes.ISO)}, list_transform({_every(episodes.DAY)}, lambda d: upper(d[1]) || lower(d[2:])), {_every(episodes.CLOCK)}, {_every(episodes.MONEY)}])))"


@query("m10_tags", f"{T} SELECT conv_id, turn, {TAGS} AS tags FROM talk")
def m10(spark, d):
    return talk(spark, d).select("conv_id", "turn", episodes.tags(F.col("text")).alias("tags"))


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\\b(Dr|Mr|Mrs|Ms|Prof)\\.', '\\1' || chr(1), 'g'), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


@query("m3_user_facts", f"{T} SELECT conv_id, turn, unnest(list_filter({SENTENCES}, lambda s: regexp_matches(s, '(?i)\\b(?:i|we|my|our)\\b') AND regexp_matches(s, '\\d'))[1:2]) AS fact FROM talk WHERE role = 'user'")
def m3(spark, d):
    return episodes.user_facts(talk(spark, d))


@query("m11_observed_on", f"{T} SELECT conv_id, turn, CAST(coalesce(try_cast(regexp_extract(text, '{episodes.ISO}') AS DATE), CASE WHEN regexp_matches(text, '(?i)\\byesterday\\b') THEN DATE '2024-03-08' WHEN regexp_matches(text, '(?i)\\blast week\\b') THEN DATE '2024-03-02' END) AS VARCHAR) AS day FROM talk")
def m11(spark, d):
    return talk(spark, d).select("conv_id", "turn", episodes.observed_on(F.col("text"), F.lit("2024-03-09").cast("date")).cast("string").alias("day"))


@query("m8_artefacts", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^```')) // 2 AS INT) AS code, len(regexp_extract_all(text, '(?m)^\\|.*\\|[ \\t]*$')) AS table_rows, len(regexp_extract_all(text, '(?m)^[ \\t]*\\d+[.)] ')) AS numbered, len(regexp_extract_all(text, '(?m)^#{1,6} ')) AS headings FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def m8(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *[c.alias(n) for n, c in episodes.artefacts(F.col("text")).items()])


STEM_OF = "CASE WHEN length(t) > 5 AND ends_with(t, 'ies') THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 5 AND ends_with(t, 'es') THEN left(t, length(t) - 2) WHEN length(t) > 4 AND ends_with(t, 's') AND NOT ends_with(t, 'ss') THEN left(t, length(t) - 1) ELSE t END"


def stems_sql(text: str, most: int) -> str:
    """Distinct stems in order: DuckDB's list_distinct gives no order, so each is kept where it comes first."""
    every = f"list_filter(list_transform({TOK.format(text)}, lambda t: {STEM_OF}), lambda t: length(t) >= 2)"
    return f"list_filter({every}, lambda t, i: list_position({every}, t) = i)[1:{most}]"


EPISODES = f"""{T}, {OUTCOME}, f AS (SELECT conv_id, min_by(text, turn) AS summary FROM talk WHERE role = 'user' GROUP BY conv_id), g AS (SELECT conv_id, list_sort(list_distinct(list(tag))) AS tags FROM (SELECT conv_id, unnest({TAGS}) AS tag FROM talk) GROUP BY conv_id),
ep AS (SELECT e.conv_id, coalesce(summary, '') AS summary, outcome, coalesce(tags, []) AS tags, ended FROM (SELECT conv_id, max(turn) AS ended FROM talk GROUP BY conv_id) e LEFT JOIN f USING (conv_id) JOIN o USING (conv_id) LEFT JOIN g USING (conv_id))"""
SOUGHT = "bikes and books in the market"


@query("m18_find_episodes", f"""{EPISODES}, s AS (SELECT conv_id, ended, 4 * len(list_intersect({stems_sql(f"'{SOUGHT}'", 24)}, {stems_sql('summary', 24)})) + 3 * len(list_intersect({stems_sql(f"'{SOUGHT}'", 24)}, {stems_sql("array_to_string(tags, ' ')", 24)}))
 + len(list_intersect({stems_sql(f"'{SOUGHT}'", 24)}, {stems_sql('outcome', 48)})) + 2 * CAST(contains(lower(summary || chr(10) || outcome || chr(10) || array_to_string(tags, chr(10))), '{SOUGHT}') AS INT) + 2 * CAST(outcome = '{SOUGHT}' AS INT) AS score FROM ep)
SELECT conv_id, score FROM s WHERE score > 0 ORDER BY score DESC, ended DESC, conv_id LIMIT 20""")
def m18(spark, d):
    return episodes.find_episodes(episodes.episodes(talk(spark, d)), SOUGHT)


@query("m32_list_episodes", f"{EPISODES} SELECT conv_id, outcome, tags FROM ep WHERE outcome IN ('success', 'failure') AND len(tags) >= 1 ORDER BY ended DESC, conv_id LIMIT 20")
def m32(spark, d):
    return episodes.list_episodes(episodes.episodes(talk(spark, d)), ["success", "failure"], 1).select("conv_id", "outcome", "tags")


@query("w6_rolling_buffer", f"{T} SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM talk) WHERE s <= 600")
def w6(spark, d):
    return episodes.rolling(talk(spark, d), 600)


@query("q2_operators", f"WITH {ASKED_SQL} SELECT query_no, contains(q, '\"') OR regexp_matches(q, '(^|\\s)(AND|OR|NOT)(\\s|$)') AS has FROM (SELECT query_no, CASE WHEN query_no % 3 = 0 THEN question || ' AND more' ELSE question END AS q FROM asked)")
def q2(spark, d):
    q = F.when(F.col("query_no") % 3 == 0, F.concat("question", F.lit(" AND more"))).otherwise(F.col("question"))
    return asked(spark, d).select("query_no", questions.has_operators(q).alias("has"))


SIGNIFICANT = "list_filter(" + TOK + f", lambda t: strlen(t) > 2 AND t NOT IN {any_word(W.STOP_EN + W.STOP_NL)})"


@query("q8_sanitised", f"SELECT conv_id, turn, CASE WHEN len({SIGNIFICANT.format('text')}) > 0 THEN array_to_string({SIGNIFICANT.format('text')}, ' ') ELSE trim(regexp_replace(regexp_replace(text, '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '\\s+', ' ', 'g')) END AS q FROM conversations WHERE text IS NOT NULL")
def q8(spark, d):
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", questions.sanitised(F.col("text")).alias("q"))


@query("q1_normalised", "SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM conversations WHERE text IS NOT NULL")
def q1(spark, d):
    """Zero-width marks and no-break spaces are put in, so that they must go."""
    marked = F.concat(F.lit("\ufeff"), F.replace("text", F.lit(" "), F.lit("\u200b\u00a0")))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", questions.normalised(marked).alias("q"))


ASKED = f"WITH {ASKED_SQL}, q AS (SELECT * FROM asked)"


@query("q9_date_hints", f"{ASKED} SELECT query_no, list_transform({HINTS}, lambda x: CAST(x AS VARCHAR)) AS hints FROM q")
def q9(spark, d):
    hints = questions.date_hints(F.col("question"), F.col("day"))
    return asked(spark, d).select("query_no", F.transform(hints, lambda x: x.cast("string")).alias("hints"))


@query("q10_augmented", f"{ASKED} SELECT query_no, array_to_string(list_concat([question], flatten(list_transform({HINTS}, lambda x: ['\"' || strftime(x, '%Y/%m/%d') || '\"', '\"' || strftime(x, '%Y-%m-%d') || '\"']))), ' ') AS q FROM q")
def q10(spark, d):
    return asked(spark, d).select("query_no", questions.augmented(F.col("question"), questions.date_hints(F.col("question"), F.col("day"))).alias("q"))


@query("p9_question_date", f"{ASKED} SELECT query_no, CAST(least(day, DATE '2024-01-06') AS VARCHAR) AS until FROM q")
def p9(spark, d):
    return asked(spark, d).select("query_no", questions.until(F.col("day"), F.lit("2024-01-06").cast("date")).cast("string").alias("until"))


TUPLES_SQL = """t AS (SELECT 'u' || (vec_id % 40) AS subject, CASE vec_id % 6 WHEN 0 THEN 'admin' WHEN 1 THEN 'deny:writer' WHEN 2 THEN 'writer' ELSE 'reader' END AS relation,
  CASE vec_id % 3 WHEN 0 THEN 'd' || (vec_id % 90) WHEN 1 THEN 'c' || (vec_id % 30) ELSE 'b' || (vec_id % 5) END AS resource FROM embeddings),
p AS (SELECT 'd' || i AS resource, 'c' || (i % 30) AS parent FROM range(90) r(i) UNION ALL SELECT 'c' || i, 'b' || (i % 5) FROM range(30) r(i)),
q AS (SELECT event_id AS request, 'u' || (user_id % 40) AS subject, ['read', 'write', 'admin', 'fly'][1 + event_id % 4] AS action, 'd' || (event_id % 90) AS resource FROM events)"""


@query("acl_check", f"""WITH {TUPLES_SQL}, chain AS (SELECT request, subject, action, resource AS node FROM q UNION ALL SELECT request, subject, action, p.parent FROM q JOIN p ON q.resource = p.resource
  UNION ALL SELECT request, subject, action, p2.parent FROM q JOIN p ON q.resource = p.resource JOIN p p2 ON p.parent = p2.resource),
k AS (SELECT DISTINCT subject, resource AS node, starts_with(relation, 'deny:') AS denies, CASE replace(relation, 'deny:', '') WHEN 'reader' THEN 1 WHEN 'writer' THEN 2 WHEN 'admin' THEN 3 END AS role FROM t),
m AS (SELECT request, CASE action WHEN 'read' THEN 1 WHEN 'write' THEN 2 WHEN 'admin' THEN 3 END AS needed, max(role) FILTER (denies) AS denied, max(role) FILTER (NOT denies) AS granted FROM chain LEFT JOIN k ON chain.subject = k.subject AND chain.node = k.node GROUP BY request, action)
SELECT request, coalesce(granted >= needed AND coalesce(denied < needed, true), false) AS allowed FROM m""")
def acl(spark, d):
    v, n, e = table(spark, d, "embeddings"), F.col("vec_id"), F.col("event_id")
    kind = F.when(n % 6 == 0, "admin").when(n % 6 == 1, "deny:writer").when(n % 6 == 2, "writer").otherwise("reader")
    place = F.when(n % 3 == 0, F.concat(F.lit("d"), n % 90)).when(n % 3 == 1, F.concat(F.lit("c"), n % 30)).otherwise(F.concat(F.lit("b"), n % 5))
    tuples = v.select(F.concat(F.lit("u"), n % 40).alias("subject"), kind.alias("relation"), place.alias("resource"))
    up = lambda a, b, size, by: spark.range(size).select(F.concat(F.lit(a), "id").alias("resource"), F.concat(F.lit(b), F.col("id") % by).alias("parent"))
    asked = F.element_at(F.array(*[F.lit(x) for x in ("read", "write", "admin", "fly")]), (e % 4 + 1).cast("int"))
    requests = table(spark, d, "events").select(e.alias("request"), F.concat(F.lit("u"), F.col("user_id") % 40).alias("subject"), asked.alias("action"), F.concat(F.lit("d"), e % 90).alias("resource"))
    return access.check(requests, tuples, up("d", "c", 90, 30).union(up("c", "b", 30, 5)))


FOCUS_PROBES = f"list_transform({FOCUSES}, lambda w: array_to_string(w, ' '))"


def in_order(values: str) -> str:
    """Distinct values where they come first."""
    return f"list_filter({values}, lambda t, i: list_position({values}, t) = i)"


FACETS = in_order("list_concat(regexp_extract_all(question, '\"([^\"]+)\"', 1), regexp_extract_all(regexp_replace(question, '^\\S+\\s*', ''), '\\b([A-Z][\\p{L}]+(?: [A-Z][\\p{L}]+)*)', 1))") + "[1:4]"


@query("q17_focus_probes", f"{ASKED} SELECT query_no, {FOCUS_PROBES} AS probes FROM q")
def q17(spark, d):
    return asked(spark, d).select("query_no", questions.focus_probes(F.col("question")).alias("probes"))


@query("q18_facets", f"{ASKED}, f AS (SELECT query_no, question || ' in New York or \"old town\"' AS question FROM q) SELECT query_no, {FACETS} AS facets FROM f")
def q18(spark, d):
    return asked(spark, d).select("query_no", questions.facets(F.concat("question", F.lit(' in New York or "old town"'))).alias("facets"))


@query("q13_probes", f"""WITH {ASKED_SQL}, {PROBES_SQL}, h AS (SELECT *, {HINTS} AS hints FROM probes)
SELECT query_no, {ordered("""list_concat([question, CASE WHEN len(hints) > 0 THEN array_to_string(list_concat([question], flatten(list_transform(hints, lambda x: ['"' || strftime(x, '%Y/%m/%d') || '"', '"' || strftime(x, '%Y-%m-%d') || '"']))), ' ') ELSE question END], facets, priority,
  CASE WHEN len(action_context) > 0 AND len(priority) >= 2 THEN phrases ELSE sub_queries END)""", 8)} AS probes FROM h""")
def q13(spark, d):
    return bm25_probes(spark, d).select("query_no", "probes")


def _fits(*patterns: str) -> str:
    return "(" + " AND ".join(rx("s", p) for p in patterns) + ")"


KINDS = [
    ("milestone", f"({_fits(episodes.MILESTONE)} AND ({_fits(episodes.MILESTONE_WHEN)} OR {_fits(episodes.MILESTONE_WHAT)}))", 2),
    ("event", _fits(episodes.EVENT, episodes.ATTENDED), 2),
    ("preference", _fits(episodes.LIKES), 2),
    ("pending", _fits(episodes.PENDING), 3),
]
MORE = ["I just finished my thesis at last. I also like long walks by the sea.", "I went to a jazz concert and a workshop. I need to pick up the coat!", "Remember to call Ann. I must renew the pass. I have to pay the bill. I should post it."]


@query("m4_extracted", f"""WITH t AS (SELECT conv_id, turn, ['{"', '".join(MORE)}'][1 + turn % 3] || ' ' || coalesce(text, '') AS text FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn, {SENTENCES} AS every FROM t)
""" + " UNION ALL ".join(f"SELECT conv_id, turn, '{kind}' AS kind, unnest({in_order(f'list_filter(every, lambda s: {fits}' + ''.join(f' AND NOT {f}' for _, f, _ in KINDS[:i]) + ')')}[1:{most}]) AS fact FROM s" for i, (kind, fits, most) in enumerate(KINDS)))
def m4(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in MORE]), (F.col("turn") % 3 + 1).cast("int"))
    return episodes.extracted(table(spark, d, "conversations").select("conv_id", "turn", "role", F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text")))
