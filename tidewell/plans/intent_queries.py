"""Queries of intent, order, state and evidence rules over the hits of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import intent as I
from ..operators import probes as P
from ..operators import questions
from ..sources.hits import ASKED_SQL, HITS_SQL, any_word, asked, hits, posed
from .probe_queries import PROBES_SQL, TYPES, bare, each, keep, lit, ordered, past, singular
from .question_sql import HINTS
from .registry import query

H = "WITH " + HITS_SQL
HP = f"{H}, {PROBES_SQL}"
EDGE = "'-"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {lit(pattern)})"


def case(*branches: tuple[str, object], other: object = 1.0) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {other} END"


def focus_sql(text: str, stop: list[str] = W.EVIDENCE_STOP) -> str:
    return f"list_distinct({keep(each(f"regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9''-]*')", lambda t: f"trim({t}, {lit(EDGE)})"), lambda t: f"length({t}) >= 3 AND {t} NOT IN {any_word(stop)}")})"


def in_order(text: str) -> str:
    return ordered(keep(each(f"regexp_extract_all({text}, '[a-z0-9][a-z0-9''-]*')", lambda t: f"trim({t}, {lit(EDGE)})"), lambda t: f"length({t}) >= 3 AND {t} NOT IN {any_word(W.EVIDENCE_STOP)}"))


WORDS_SQL = "list_filter(regexp_split_to_array(trim(lower(regexp_replace(question, '[\\p{P}\\p{S}\\s]+', ' ', 'g'))), ' '), lambda t: strlen(t) >= 3 AND t NOT IN " + any_word(W.RETRY_STOP) + ")"
SHARED = "contains(lower(path), 'notes/global/')"
Q = "lower(question)"
DATED_ACTION = "(contains(lower(question), 'when') AND (" + " OR ".join(rx("question", p) for p, _ in P.ACTIONS) + "))"
PREF = rx(Q, I.PREFERENCE)
FACTQ = "(" + " OR ".join([rx(Q, I.TOTAL), rx(Q, I.PROPERTY), DATED_ACTION, f"({rx(Q, 'remind me|remember')} AND {rx(Q, 'the specific|the exact')})", f"({rx(Q, I.FIRST_PERSON)} AND {rx(Q, I.MONEY_EVENT)})", f"({rx(Q, I.FACT_LOOKUP)} AND {rx(Q, I.FACT_VERB)})"]) + ")"
GENERIC, ROLLUP, QUESTION = rx("text", I.NOTE_GENERIC), rx("text", I.NOTE_ROLLUP), rx("text", I.NOTE_QUESTION)
FACT = f"({rx('lower(path)', 'user-fact-|milestone-')} OR (NOT {ROLLUP} AND ({rx('text', I.NOTE_DATED)} OR {rx('text', I.NOTE_EVENT)})))"
R3 = case((f"{SHARED} AND contains(lower(path), 'user-preference-')", 2.35), (f"{SHARED} AND {rx('text', I.NOTE_PREFERENCE)}", 2.1), (f"source_role = 'assistant' AND {rx(Q, I.OUTPUT)}", 1.35), (f"NOT {SHARED} AND {GENERIC}", 0.82), (ROLLUP, 0.9))
VAGUE = f"({GENERIC} OR {QUESTION})"
R4 = " * ".join([
    case((FACT, 2.2)),
    case((DATED_ACTION, case((rx("text", I.NOTE_MONTH_DAY), 1.45), other=0.78))),
    case((rx("question", I.DURATION), case((rx("text", I.NOTE_MEASURE), 1.35), other=0.72))),
    case((f"{rx('question', I.TOTAL)} AND {rx('question', I.UNIT)}", case((rx("text", I.NOTE_MEASURE), 1.55), (VAGUE, 0.68)))),
    case((rx("question", I.MONEY_EVENT), case((rx("text", I.NOTE_CURRENCY), 1.45), (VAGUE, 0.62)))),
    case((f"{QUESTION} AND {GENERIC}", 0.45)), case((ROLLUP, 0.45)), case((f"NOT {FACT} AND NOT {SHARED} AND {GENERIC}", 0.75)),
])
FOCUSES = "list_transform(list_filter(" + each("regexp_split_to_array(lower(question), '\\b(?:and|or|plus)\\b')", in_order) + ", lambda w: len(w) > 0), lambda w: w[greatest(1, len(w) - 3) : len(w)])"


def plain(text: str) -> str:
    return f"trim(regexp_replace(translate(lower({text}), '-/()[],.:;?!', '            '), '\\s+', ' ', 'g'))"


def shares(phrases: str) -> str:
    """The alignment of each phrase with a hit's text (ft) and its words (fw)."""

    def share(p: str) -> str:
        w = each(f"string_split({plain(p)}, ' ')", singular)
        return f"CASE WHEN {plain(p)} = '' THEN 0 WHEN contains(ft, {plain(p)}) THEN 1 ELSE round(len({keep(w, lambda t: f'list_contains(fw, {t})')}) / len({w}), 9) END"

    return each(phrases, share)


#: Hits beside their question's probes, with the words of their texts.
BESIDE = f"""{HP}, hp AS MATERIALIZED (SELECT h.*, p.phrases, CASE WHEN len(p.priority) > 0 THEN p.priority ELSE p.phrases END AS wanted, {ordered("list_concat(p.facets, p.phrases, p.money)")} AS cover, {plain("text")} AS ft,
  list_distinct(list_concat(string_split({plain("text")}, ' '), {each(f"string_split({plain('text')}, ' ')", singular)})) AS fw FROM hits h JOIN probes p USING (query_no)),
al AS MATERIALIZED (SELECT *, question AS q, coalesce(list_max({shares("wanted")}), 0) AS aligned FROM hp)"""
R5 = case(("len(wanted) = 0", 1.0), (f"{TYPES} AND aligned < 0.25", 0.18), ("aligned >= 0.99", 1.6), ("aligned >= 0.66", 1.25))
ROUTINE = f"{rx(Q, I.DURATION)} AND {rx(Q, I.ROUTINE)}"
PERSONAL = "(contains(lower(path), 'user') OR contains(text, 'user '))"
R6 = case((f"{rx(Q, I.FIRST_PERSON)} OR {rx(Q, I.FACT_LOOKUP)}", " * ".join([
    case((f"{SHARED} AND {FACT}", 1.35), (f"{FACT} AND {PERSONAL}", 1.25), (SHARED, 1.22), (FACT, 0.88), other=0.58),
    case((f"NOT {SHARED} AND {GENERIC}", 0.82)), case(("source_role = 'user'", 1.18), (f"source_role = 'assistant' AND NOT {rx(Q, I.OUTPUT)}", 0.72)),
    case((f"{ROUTINE} AND {rx('text', I.NOTE_ROUTINE)}", 1.25), (f"{ROUTINE} AND {rx('text', I.NOTE_SEGMENT)}", 0.15)),
])))
R7 = case(("superseded_by <> ''", 0.18), (rx("text", I.NOTE_SUPERSEDED), 0.32))
D = lambda x: f"round(CAST({x} AS DOUBLE), 9)"
#: Reweighted hits: rw holds the new score and rank.
REWEIGHTED = f"""{BESIDE}, f AS (SELECT *, round(score * CAST({case((PREF, R3))} AS DOUBLE) * CAST({case((FACTQ, f'({R4}) * ({R5}) * ({R6})'))} AS DOUBLE) * CAST({case((f'{PREF} OR {FACTQ}', R7))} AS DOUBLE), 9) AS s FROM al),
rw AS MATERIALIZED (SELECT * EXCLUDE (score, rank, s), s AS score, row_number() OVER (PARTITION BY query_no ORDER BY s DESC, rank) AS rank FROM f)"""


def probes(spark, d):
    return P.derived(posed(spark, d))


def reweighted(spark, d):
    return I.reweight(hits(spark, d), probes(spark, d))


@query("r1_intents", f"WITH {ASKED_SQL} SELECT query_no, {PREF} AS preference, {FACTQ} AS concrete FROM asked")
def r1(spark, d):
    return asked(spark, d).select("query_no", *[c.alias(n) for n, c in I.intents(F.col("question")).items()])


@query("r3_preference_factor", f"{H} SELECT query_no, chunk_id, {D(R3)} AS factor FROM hits")
def r3(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", F.round(I.preference_factor(F.col("question"), F.col("path"), F.col("source_role"), F.col("text")), 9).alias("factor"))


@query("r4_fact_factor", f"{H} SELECT query_no, chunk_id, {D(R4)} AS factor FROM hits")
def r4(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", F.round(I.fact_factor(F.col("question"), F.col("path"), F.col("text")), 9).alias("factor"))


@query("r5_focus_factor", f"{BESIDE} SELECT query_no, chunk_id, {D('aligned')} AS aligned, {D(R5)} AS factor FROM al")
def r5(spark, d):
    rows = I.aligned(I.with_probes(hits(spark, d), probes(spark, d)), F.col("wanted"), "all").withColumn("aligned", F.coalesce(F.array_max("all"), F.lit(0.0)))
    return rows.select("query_no", "chunk_id", "aligned", I.focus_factor(F.col("question"), F.col("aligned"), F.col("wanted")).alias("factor"))


@query("r6_first_person_factor", f"{H} SELECT query_no, chunk_id, {D(R6)} AS factor FROM hits")
def r6(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", F.round(I.first_person_factor(F.col("question"), F.col("path"), F.col("source_role"), F.col("text")), 9).alias("factor"))


@query("r7_stale_factor", f"{H} SELECT query_no, chunk_id, {D(R7)} AS factor FROM hits")
def r7(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", I.stale_factor(F.col("superseded_by"), F.col("text")).alias("factor"))


@query("r2_reweighted", f"{REWEIGHTED} SELECT query_no, chunk_id, score, rank FROM rw")
def r2(spark, d):
    return reweighted(spark, d).select("query_no", "chunk_id", "score", "rank")


@query("r2_reordered")
def r2_all(spark, d):
    """Reweighted hits after all four orders. No SQL, as one of them is greedy: its parts have SQL or are tested by brute force."""
    return I.reordered(hits(spark, d), probes(spark, d))


def first_sql(source: str, which: str, fit: str, other: str) -> str:
    """Ranks anew: the first fitting row of each ``which``, then the others by class and rank."""
    return f"""w AS (SELECT *, {which} AS which FROM {source}), x AS (SELECT *, coalesce({fit}, false) AS fit, max(rank) OVER (PARTITION BY query_no) AS n FROM w),
y AS (SELECT *, fit AND row_number() OVER (PARTITION BY query_no, fit, which ORDER BY rank) = 1 AS first FROM x)
SELECT query_no, chunk_id, row_number() OVER (PARTITION BY query_no ORDER BY CASE WHEN first THEN 0 ELSE {other} END, rank) AS rank FROM y"""


COMPOSITE = f"({rx('lower(trim(question))', ' and | plus | or ')} AND ({rx(Q, I.TOTAL)} OR {rx(Q, I.PROPERTY)} OR ({rx(Q, I.FACT_LOOKUP)} AND {rx(Q, I.FACT_VERB)})))"
SHARE = "coalesce(list_max(sc), 0)"
WHICH = f"CASE WHEN {SHARE} > 0 THEN list_position(sc, list_max(sc)) ELSE 0 END"
SEVERAL_HITS = "max(rank) OVER (PARTITION BY query_no) >= 3"


@query("r8_composite", f"{REWEIGHTED}, c AS (SELECT *, {shares('phrases')} AS sc, {COMPOSITE} AND len(phrases) >= 2 AND {SEVERAL_HITS} AS active FROM rw), " + first_sql("c", WHICH, f"active AND which > 0 AND {SHARE} >= 0.5", f"CASE WHEN fit THEN 3 WHEN active AND {SHARE} >= 0.25 THEN 2 ELSE 1 END"))
def r8(spark, d):
    p = probes(spark, d)
    return I.composite(I.with_probes(I.reweight(hits(spark, d), p), p)).select("query_no", "chunk_id", "rank")


ADDS = f"({rx(Q, I.TOTAL)} OR (({rx(Q, I.MONEY_EVENT)} OR {rx(Q, I.UNIT)}) AND {rx(Q, I.COMPARES)}))"
CURRENCY, MEASURE = rx("text", I.NOTE_CURRENCY), rx("text", I.NOTE_MEASURE)
STRENGTH = " + ".join([
    case((f"{SHARE} >= 0.99", 2.0), (f"{SHARE} >= 0.66", 1.35), (f"{SHARE} >= 0.5", 0.8), (f"{SHARE} >= 0.25", 0.35), ("len(cover) = 0", 0.6), other=0.0),
    case((f"{rx(Q, I.MONEY_EVENT)} AND {CURRENCY}", 2.4), (f"{rx(Q, I.TOTAL)} AND {rx(Q, I.UNIT)} AND {MEASURE}", 2.0), (rx("text", I.NOTE_NUMBER), 1.0), other=0.0),
    case((FACT, 1.2), other=0.0), case((SHARED, 0.65), other=0.0), case(("source_role = 'user'", 0.8), (f"source_role = 'assistant' AND NOT {rx(Q, I.OUTPUT)}", -0.6), other=0.0),
    case((GENERIC, -0.45), other=0.0), case((QUESTION, -0.75), other=0.0), case((ROLLUP, -0.35), other=0.0), case((f"len(cover) > 0 AND {SHARE} < 0.25 AND NOT {CURRENCY} AND NOT {MEASURE}", -1.5), other=0.0),
])


@query("r10_evidence_strength", f"{BESIDE}, c AS (SELECT *, {shares('cover')} AS sc FROM al) SELECT query_no, chunk_id, CAST({WHICH} AS INT) AS focus, {D(STRENGTH)} AS strength FROM c")
def r10(spark, d):
    return I.strengths(I.with_probes(hits(spark, d), probes(spark, d))).select("query_no", "chunk_id", "focus", "strength")


@query("r9_cover_evidence")
def r9(spark, d):
    """Hits that cover sessions and focuses first. No SQL, as each choice depends on those before: tested by brute force."""
    p = probes(spark, d)
    return I.cover_evidence(I.with_probes(I.reweight(hits(spark, d), p), p))


DIRECT = f"NOT contains(lower(path), 'user-preference-') AND NOT (contains(lower(path), 'notes/project/') AND {GENERIC}) AND {SHARED} AND ({rx('lower(path)', 'user-fact-|user_|user-')} OR contains(text, 'user ') OR contains(text, 'i '))"


@query("r11_personal_context", f"{REWEIGHTED}, c AS (SELECT *, {shares('wanted')} AS sc, {SEVERAL_HITS} AS active FROM rw), " + first_sql("c", WHICH, f"active AND {rx('question', I.PREFERENCE)} AND {DIRECT} AND which > 0 AND {SHARE} >= 0.5", "1"))
def r11(spark, d):
    p = probes(spark, d)
    return I.personal_context(I.with_probes(I.reweight(hits(spark, d), p), p)).select("query_no", "chunk_id", "rank")


def clause(i: int) -> str:
    w = bare(f"regexp_extract(question, {lit(P.DAYS_AGO)}, {i})")
    return f"(len({w}) > 0 AND len(list_filter({w}, lambda t, n: contains(text, t) OR (n = 1 AND contains(text, {past('t')})))) = len({w}))"


@query("r12_event_hits", f"{REWEIGHTED}, c AS (SELECT *, {SEVERAL_HITS} AS active FROM rw), " + first_sql("c", f"CASE WHEN NOT {rx('question', P.DAYS_AGO)} THEN 0 WHEN {clause(1)} THEN 1 WHEN {clause(2)} THEN 2 ELSE 0 END", "active AND which > 0", "1"))
def r12(spark, d):
    return I.event_hits(reweighted(spark, d)).select("query_no", "chunk_id", "rank")


def line_date(text: str) -> str:
    return f"try_cast(replace(left(regexp_extract({text}, {lit(I.LINE_DATE)}, 1), 10), '/', '-') AS DATE)"


@query("r14_candidate_date", f"{H} SELECT query_no, chunk_id, CAST(coalesce(modified, {line_date('text')}) AS VARCHAR) AS day, CAST({line_date('text')} AS VARCHAR) AS said FROM hits")
def r14(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", I.candidate_date(F.col("modified"), F.col("text")).cast("string").alias("day"), I.text_date(F.col("text")).cast("string").alias("said"))


@query("r15_body_date", f"{H}, m AS (SELECT query_no, chunk_id, day, regexp_extract_all(text, {lit(I.BODY_DATE)}, 1) AS ms, regexp_extract_all(text, {lit(I.BODY_DATE)}, 2) AS ds FROM hits), i AS (SELECT *, list_filter(range(1, len(ds) + 1), lambda k: CAST(ds[k] AS INT) BETWEEN 1 AND 31)[1] AS i FROM m) SELECT query_no, chunk_id, CAST(make_date(year(day), list_position({I.MONTHS}, lower(left(ms[i], 3))), 1) + (CAST(ds[i] AS INT) - 1) AS VARCHAR) AS day FROM i")
def r15(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", I.body_date(F.col("text"), F.col("day")).cast("string").alias("day"))


def bound(x: str) -> str:
    return f"try_cast(replace(left({x}, 10), '/', '-') AS DATE)"


def state_shared(other: str) -> str:
    return f"len(list_intersect({focus_sql('question', W.STATE_STOP)}, {focus_sql(other, W.STATE_STOP)}))"


VALID = f"coalesce(day >= {bound('valid_from')}, true) AND coalesce(day <= {bound('valid_to')}, true)"
STATE = f"greatest(0, {case(('state_key <> ' + repr(''), 8), other=0)} + {case(('state_kind <> ' + repr(''), 3), other=0)} + 3 * {state_shared('state_subject')} + {case((rx('text', I.NOTE_STATE), 2), other=0)} + {state_shared('text')} - {case(('superseded_by <> ' + repr(''), 8), other=0)} - {case((rx('text', I.NOTE_STALE), 5), other=0)})"


@query("r21_current_state", f"{H}, s AS (SELECT query_no, chunk_id, rank, CAST(CASE WHEN {rx('question', I.CURRENT_STATE)} AND len({focus_sql('question', W.STATE_STOP)}) > 0 AND {VALID} THEN {STATE} ELSE 0 END AS INT) AS state FROM hits) SELECT query_no, chunk_id, state, row_number() OVER (PARTITION BY query_no ORDER BY state DESC, rank) AS rank FROM s")
def r21(spark, d):
    return I.promote_state(hits(spark, d))


ACTION = case(*[(rx("text", p), f"'{n}'") for n, p in I.ACTIONS], other="''")
_VALUE = "CAST(round(CAST(replace({}, ',', '') AS DOUBLE) * 100) AS BIGINT)"
_UNIT = "CASE lower({0}) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in I.UNITS.items()) + " ELSE regexp_replace(lower({0}), 's$', '') END"
_CURRENCY = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in I.CURRENCIES.items()) + " END"


def _pairs(pattern: str, unit: int, value: int, name: str) -> str:
    every = lambda g: f"regexp_extract_all(text, {lit(pattern)}, {g})"
    return f"list_transform({every(unit)}, lambda u, i: {{'unit': {name.format('u')}, 'value': {_VALUE.format(every(value) + '[i]')}}})"


AMOUNTS = f"list_concat({_pairs(I.MONEY, 1, 2, _CURRENCY)}, {_pairs(I.QUANTITY, 2, 1, _UNIT)})"
KIND = case((f"NOT {rx('text', I.NOTE_DONE)} AND {rx('text', I.NOTE_PLAN)}", "'plan'"), (rx("text", "total|overall|so far|combined|altogether|in all"), "'rollup'"),
            (rx("text", "recap|summary|tracker|ledger|bookkeeping"), "'recap'"), (f"len({AMOUNTS}) > 0 AND ({ACTION} <> '' OR {rx('text', I.NOTE_PAST)})", "'atomic'"), other="'unknown'")
EVIDENCE = f"{H}, e AS MATERIALIZED (SELECT query_no, question, chunk_id, modified, {focus_sql('text')} AS words, {KIND} AS kind, {ACTION} AS action, {AMOUNTS} AS amounts FROM hits)"
MONEY_UNIT = "{}.unit IN " + any_word(list(I.CURRENCIES.values()))


@query("r18_evidence_kind", f"{EVIDENCE} SELECT query_no, chunk_id, kind, action, list_transform(amounts, lambda a: a.unit || ' ' || a.value) AS amounts FROM e")
def r18(spark, d):
    found = I.evidence(F.col("text"))
    said = F.transform(found["amounts"], lambda a: F.concat_ws(" ", a["unit"], a["value"].cast("string")))
    return hits(spark, d).select("query_no", "chunk_id", found["kind"].alias("kind"), found["action"].alias("action"), said.alias("amounts"))


@query("r17_grouped_evidence", f"""{EVIDENCE}, r AS (SELECT * FROM e WHERE {rx('question', I.AGGREGATE)}), a AS (SELECT query_no, words, action, {MONEY_UNIT.format('amounts[1]')} AS money, unnest(amounts) AS a FROM r WHERE kind = 'atomic'),
p AS (SELECT r.query_no, r.chunk_id, r.amounts[1] AS whole, a.a, {MONEY_UNIT.format('r.amounts[1]')} = a.money AS metric, len(list_intersect(r.words, a.words)) AS shared, r.action <> '' AND r.action = a.action AS same FROM r JOIN a ON r.query_no = a.query_no
  WHERE len(r.amounts) = 1 AND (r.kind IN ('rollup', 'recap') OR (r.kind = 'plan' AND NOT {rx('question', I.PLANS_WANTED)}))),
g AS (SELECT query_no, chunk_id FROM p WHERE metric AND CASE WHEN same THEN shared >= 1 ELSE shared >= 2 END GROUP BY query_no, chunk_id, whole
  HAVING bool_or(a = whole AND shared >= 2) OR (count(*) FILTER (a.unit = whole.unit) > 1 AND sum(a.value) FILTER (a.unit = whole.unit) = whole.value))
SELECT r.query_no, r.chunk_id, kind, g.chunk_id IS NOT NULL AS suppressed FROM r LEFT JOIN g ON r.query_no = g.query_no AND r.chunk_id = g.chunk_id""")
def r17(spark, d):
    return I.group_evidence(hits(spark, d))


STRONGEST = f"list_filter({WORDS_SQL}, lambda t: strlen(t) = list_max(list_transform({WORDS_SQL}, lambda u: strlen(u))))[1]"


def quality_sql(source: str, name: str) -> str:
    """Entries down to ``name``: the quality of the hits of ``source`` for every question."""
    return f"""{name}_t AS (SELECT query_no, count(*) AS n_hits, string_agg(text, ' ') FILTER (rank <= 3) AS every, list_filter(list({line_date('text')}), lambda x: x IS NOT NULL) AS dates FROM {source} WHERE rank <= 5 GROUP BY query_no),
{name}_m AS (SELECT a.*, n_hits, coalesce(dates, []) AS dates, {HINTS} AS hints, coalesce(every, '') AS every, list_distinct({WORDS_SQL}) AS ws, {STRONGEST} AS best FROM asked a LEFT JOIN {name}_t USING (query_no)),
{name}_n AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: contains(every, w))) AS matched, list_min(flatten(list_transform(dates, lambda x: list_transform(hints, lambda h: abs(x - h))))) AS nearest FROM {name}_m),
{name}_l AS (SELECT *, CASE WHEN n_hits IS NULL THEN 'empty' WHEN len(dates) > 0 AND (len(list_filter(dates, lambda x: x > day)) = len(dates) OR (len(hints) > 0 AND nearest > 45)) THEN 'date_mismatch' WHEN n = 0 THEN 'good'
  WHEN matched = 0 OR (n >= 4 AND matched < 2) THEN 'generic' WHEN n >= 3 AND matched < 0.34 * n THEN 'weak' ELSE 'good' END AS label FROM {name}_n),
{name} AS (SELECT query_no, CAST(matched AS INT) AS matched, CASE label WHEN 'empty' THEN 0 WHEN 'date_mismatch' THEN 0.1 ELSE CASE WHEN n = 0 THEN 1 ELSE round(least(1, matched / n + CASE WHEN contains(every, best) THEN 0.15 ELSE 0 END), 9) END END::DOUBLE AS score, label, label <> 'good' AS retry FROM {name}_l)"""


def hints():
    return questions.date_hints(F.col("question"), F.col("day"))


@query("r26_quality", f"{H}, {quality_sql('hits', 'ql')} SELECT * FROM ql")
def r26(spark, d):
    return I.quality(posed(spark, d), hits(spark, d), hints())


@query("r16_distinct_hits")
def r16(spark, d):
    """Hits without near repeats. No SQL, as what is kept depends on what was kept before: tested by brute force."""
    return I.distinct_hits(hits(spark, d))


@query("r28_diverse_hits")
def r28(spark, d):
    """Greedy diverse selection. No SQL, as each choice depends on those before: tested by brute force."""
    return I.diverse(hits(spark, d))


@query("i6_valid_states", "SELECT o_orderkey, (TRY_CAST(CASE WHEN o_orderkey % 5 = 0 THEN 'open' ELSE strftime(o_orderdate, '%Y/%m/%d') END[1:4] || '-' || strftime(o_orderdate, '%m-%d') AS DATE) IS NULL OR DATE '1996-06-30' >= CAST(o_orderdate AS DATE)) AND DATE '1996-06-30' <= CAST(o_orderdate AS DATE) + 90 AS valid FROM orders")
def i6(spark, d):
    from ..session import table

    start = F.when(F.col("o_orderkey") % 5 == 0, "open").otherwise(F.date_format("o_orderdate", "yyyy/MM/dd"))
    end = F.date_format(F.date_add(F.to_date("o_orderdate"), 90), "yyyy-MM-dd")
    return table(spark, d, "orders").select("o_orderkey", I.valid_at(F.lit("1996-06-30").cast("date"), start, end).alias("valid"))


def any_of(column: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(rx(column, p) for p in patterns) + ")"


SIGNALS = {"timeline": any_of("trim(question)", I.TIMELINE), "recent": any_of("trim(question)", I.RECENT)}
SIGNALS["temporal"] = f"({SIGNALS['timeline']} OR {SIGNALS['recent']})"
SIGNALS["aggregate"] = f"({SIGNALS['timeline']} OR {any_of('trim(question)', I.SEVERAL)})"
SIGNALS["concrete"] = f"({SIGNALS['temporal']} OR {any_of('trim(question)', I.CONCRETE)})"


@query("r30_signals", f"WITH {ASKED_SQL} SELECT query_no, " + ", ".join(f"{c} AS {n}" for n, c in SIGNALS.items()) + " FROM asked")
def r30(spark, d):
    return asked(spark, d).select("query_no", *[c.alias(n) for n, c in I.signals(F.col("question")).items()])


def recall_sql(text: str, most: int) -> str:
    stems = each(f"regexp_extract_all(lower({text}), '[a-z0-9]+')", lambda t: f"CASE WHEN length({t}) > 5 AND ends_with({t}, 'ies') THEN left({t}, length({t}) - 3) || 'y' WHEN length({t}) > 5 AND ends_with({t}, 'es') THEN left({t}, length({t}) - 2) WHEN length({t}) > 4 AND ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN left({t}, length({t}) - 1) ELSE {t} END")
    return ordered(keep(stems, lambda t: f"length({t}) >= 2 AND {t} NOT IN {any_word(W.RECALL_STOP)}"), most)


BODY = "concat_ws(chr(10), title, summary, tag_text, content)"
EVIDENT = "CASE WHEN modified IS NOT NULL THEN 1.0 ELSE 0.0 END + " + " + ".join(f"CASE WHEN {rx('body', p)} THEN 0.35 ELSE 0.0 END" for p in I.EVIDENT)
ADVISED = f"CASE WHEN {rx('body', I.ADVICE)} THEN CASE WHEN modified IS NOT NULL THEN 0.25 ELSE 1.0 END ELSE 0.0 END"


@query("r29_base_scores", f"""{H}, w AS (SELECT *, {BODY} AS body, {recall_sql('question', 32)} AS words, {recall_sql(BODY, 48)} AS signature, {recall_sql("concat_ws(chr(10), title, summary, tag_text)", 24)} AS topic, min(modified) OVER (PARTITION BY query_no) AS lo, max(modified) OVER (PARTITION BY query_no) AS hi FROM hits),
m AS (SELECT *, len(words) AS n, len(list_intersect(words, signature)) AS t, len(list_intersect(words, topic)) AS p, CASE WHEN modified IS NULL THEN 0.0 WHEN hi > lo THEN date_diff('day', lo, modified)::DOUBLE / date_diff('day', lo, hi) ELSE 1.0 END AS r FROM w)
SELECT query_no, chunk_id, round(CAST(1.35 + CASE WHEN n > 0 THEN t / n * 1.4 + p / n * 0.8 ELSE 0 END + least(t, 3) * 0.15 + CASE WHEN {SIGNALS['temporal']} AND modified IS NOT NULL THEN 0.8 ELSE 0 END + CASE WHEN {SIGNALS['recent']} THEN r * 0.8 ELSE 0 END
  + CASE WHEN {SIGNALS['concrete']} THEN ({EVIDENT}) * 0.55 - ({ADVISED}) * 0.75 ELSE -0.1 * ({ADVISED}) END AS DOUBLE), 9) AS base FROM m""")
def r29(spark, d):
    return I.analysed(hits(spark, d)).select("query_no", "chunk_id", "base")


GROUP = f"concat_ws('|', kind, CASE WHEN len(amounts) > 0 THEN CASE WHEN {MONEY_UNIT.format('amounts[1]')} THEN 'money' ELSE 'quantity' END END, nullif(action, ''), amounts[1].unit || '-' || amounts[1].value, CAST(modified AS VARCHAR), nullif(coalesce(array_to_string(list_sort(words)[1:4], '-'), ''), ''))"


@query("a12_evidence_groups", f"{EVIDENCE} SELECT query_no, count(DISTINCT {GROUP}) AS n_groups FROM e WHERE kind <> 'unknown' GROUP BY query_no")
def a12(spark, d):
    found = I.evidence(F.col("text"))
    rows = hits(spark, d).select("query_no", "modified", "text", *[c.alias(n) for n, c in found.items()]).where("kind <> 'unknown'")
    group = I.evidence_group(F.col("kind"), F.col("action"), F.col("amounts"), F.col("modified"), F.col("text"))
    return rows.groupBy("query_no").agg(F.count_distinct(group).alias("n_groups"))


@query("a16_chunk_relevance", f"{H} SELECT query_no, chunk_id, CAST(len(list_filter(list_distinct({WORDS_SQL}), lambda w: contains(text, w))) AS INT) AS relevance FROM hits")
def a16(spark, d):
    return hits(spark, d).select("query_no", "chunk_id", F.size(F.filter(I.question_words(F.col("question")), lambda w: F.contains("text", w))).alias("relevance"))
