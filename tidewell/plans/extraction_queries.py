"""Queries of the chain of extraction rules and of the keys of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..session import table
from ..sources.hits import any_word
from .episode_queries import SENTENCES
from .probe_queries import each, joined, keep, lit, match
from .registry import query

#: What users' turns of a session begin with.
DIARY = [
    "My visa application took three weeks. It was approved. I like long walks, and tea.",
    "I have written 12 poems this year. Besides jazz, I also like quiet hotels with a view.",
    "I have run 12 miles on Monday. I keep my shoes under the bed.",
    "I just finished my thesis at last. I need to pick up the coat, and then call Ann and pay the bill.",
    "I went to a jazz concert and a workshop. I want to attend a festival.",
    "Can you recommend a hotel? I bought a desk for my office.",
    "I currently own two bikes and still use the old one. I've got to think of it.",
    "Remember to renew the pass. I love the sea! I should ask Ann?",
    "We have filed the asylum claim. Over two years we have waited, and it is still pending.",
]


def diary(spark, d):
    c = table(spark, d, "conversations")
    said = F.element_at(F.array(*[F.lit(x) for x in DIARY]), ((F.col("conv_id") * 5 + F.col("turn")) % len(DIARY) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(said, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


DIARY_SQL = f"diary AS (SELECT conv_id, turn, role, [{', '.join(map(lit, DIARY))}][1 + (conv_id * 5 + turn) % {len(DIARY)}] || ' ' || coalesce(text, '') AS text FROM conversations)"
NONE = "CAST([] AS VARCHAR[])"


def some(x: str, *patterns: str) -> str:
    return "(" + " OR ".join(match(x, p) for p in patterns) + ")"


def application(x: str) -> str:
    return "(" + " AND ".join(match(x, p) for p in (X.OWN, X.DURATION, X.APPLICATION, X.APPLICATION_STEP)) + ")"


def quantified(x: str) -> str:
    return some(x, X.WORD_UNIT, X.DATE, X.MONTH_DAY, X.LONG_TIME, X.NUMBER, X.ORDINAL)


def concrete(x: str) -> str:
    return f"({some(x, X.SETUP, X.STORED, X.ACTED, X.TOOK_ME, X.CREATIVE)} OR {application(x)})"


def user_fact(x: str) -> str:
    clause = f"regexp_extract({x}, '(?s)^([^.!?]*[.!?]?)', 1)"
    request = f"(({match(clause, X.REQUEST)} AND NOT {concrete(clause)}) OR (({match(x, X.REQUEST)} OR ends_with({x}, '?')) AND NOT {concrete(x)}))"
    return f"{match(x, X.OWN)} AND ({quantified(x)} OR {some(x, X.CADENCE, X.STORED, X.SETUP, X.CREATIVE)} OR {application(x)}) AND NOT {request}"


def milestone(x: str) -> str:
    return f"{match(x, X.OWN)} AND NOT {quantified(x)} AND {match(x, X.MILESTONE_WHAT)} AND {some(x, X.MILESTONE, X.MILESTONE_WHEN)}"


def errands(x: str) -> str:
    rest = f"trim(regexp_extract({x}, {lit(X.PENDING)}, 1))"
    parts = keep(each(f"regexp_split_to_array({rest}, '(?i)\\s*(?:,|;|\\bthen\\b|\\band\\b)\\s*')", lambda p: f"trim({p})"), lambda p: f"{p} <> ''")
    found = f"list_reduce(list_concat([{NONE}], {each(parts, lambda p: f'[{p}]')}), lambda a, b: CASE WHEN {match('b[1]', X.PENDING_START)} THEN list_concat(a, b) WHEN len(a) > 0 THEN list_concat(a[1 : len(a) - 1], [a[len(a)] || ' ' || b[1]]) ELSE a END)"
    return f"CASE WHEN {match(x, X.PENDING)} AND NOT ends_with(trim({x}), '?') AND {rest} <> '' THEN CASE WHEN len({found}) > 0 THEN {found} ELSE [{rest}] END ELSE {NONE} END"


def prefers(x: str) -> str:
    part = lambda p, i: f"trim(regexp_extract({x}, {lit(p)}, {i}))"
    return f"CASE WHEN {match(x, X.BESIDES)} THEN 'The user prefers ' || {part(X.BESIDES, 1)} || ' and ' || {part(X.BESIDES, 2)} || '.' WHEN {match(x, X.LIKES)} AND {part(X.LIKES, 1)} <> '' THEN 'The user prefers ' || {part(X.LIKES, 1)} || '.' END"


def slug(x: str) -> str:
    return f"len({keep(f'regexp_extract_all(lower({x}), {lit(X.WORD)})', lambda t: f'{t} NOT IN {any_word(X.SLUG_SKIP)}')}) > 0"


TOLD = {
    "application": keep("list_concat(flatten(list_transform(s, lambda x, i: CASE WHEN i < len(s) THEN [x, x || ' ' || s[i + 1]] ELSE [x, x] END)), CASE WHEN len(s) <= 3 THEN [whole] ELSE [] END)", application),
    "creative": keep("s", lambda x: match(x, X.CREATIVE)),
    "fact": keep(f"list_concat(s, CASE WHEN {some('whole', X.CADENCE, X.STORED, X.SETUP)} THEN [whole] ELSE [] END)", user_fact),
    "milestone": keep("s", milestone),
    "pending": each(f"flatten({each('s', errands)})", lambda a: f"'Pending task: ' || {a}"),
    "event": keep("s", lambda x: f"{match(x, X.EVENT)} AND {match(x, X.ATTENDED)} AND NOT {match(x, X.ASPIRED)}"),
    "preference": keep(each("s", prefers), lambda x: f"{x} IS NOT NULL"),
}


def _steps() -> str:
    steps, before = [], NONE
    for n, (kind, most) in enumerate(X.MOST.items()):
        same = each(kind, lambda x: f"lower(trim({x}))")
        steps.append(f"x{n + 1} AS (SELECT *, list_filter({kind}, lambda x, i: list_position({same}, lower(trim(x))) = i AND NOT list_contains({before}, lower(trim(x))))[1:{most}] AS t_{kind} FROM x{n})")
        before = f"list_concat({before}, {each(f't_{kind}', lambda x: f'lower(trim({x}))')})"
    return ", ".join(steps)


FACTS = f"""WITH {DIARY_SQL}, own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM diary) WHERE n <= {X.RECENT} AND role = 'user'), se AS (SELECT conv_id, turn, trim(text) AS whole, {SENTENCES} AS s FROM own),
td AS MATERIALIZED (SELECT conv_id, turn, {", ".join(f"{keep(c, slug)} AS {k}" for k, c in TOLD.items())} FROM se), x0 AS (SELECT conv_id, {", ".join(f"flatten(list({k} ORDER BY turn)) AS {k}" for k in X.MOST)} FROM td GROUP BY conv_id),
{_steps()}, al AS (SELECT conv_id, list_concat({", ".join("list_transform(t_" + k + ", lambda x: {'kind': '" + k + "', 'fact': x})" for k in X.MOST)}) AS f FROM x{len(X.MOST)}),
facts AS (SELECT conv_id, CAST(i - 1 AS INT) AS pos, f[i].kind AS kind, f[i].fact AS fact FROM al, unnest(range(1, len(f) + 1)) AS u(i))"""


@query("m2_extracted", f"{FACTS} SELECT * FROM facts")
def m2(spark, d):
    return X.extracted(diary(spark, d))


def key_words(text: str, most: int) -> str:
    return "(" + keep(each(f"regexp_extract_all(lower({text}), '[a-z0-9][a-z0-9''-]*')", lambda t: f"trim({t}, {lit(chr(39) + '-')})"), lambda t: f"length({t}) >= 3 AND {t} NOT IN {any_word(X.KEY_SKIP)}") + f")[1:{most}]"


def key(text: str) -> str:
    return f"regexp_replace(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', '.', 'g'), '^\\.+|\\.+$', '', 'g')"


_FIRST = "regexp_split_to_array(trim(fact), '[\\n.!?]+')[1]"
_KIND = "CASE " + " ".join(f"WHEN {match('fact', p)} THEN '{k}'" for k, p in X.STATE_KINDS) + " ELSE 'current_state' END"
_LINE = "trim(regexp_replace(fact, '\\s+', ' ', 'g'))"


@query("m12_enriched", f"""{FACTS}, k AS (SELECT *, {key_words('fact', X.KEY_WORDS)} AS ws, {key_words(_FIRST, X.SUBJECT_WORDS)} AS su, {match('fact', X.STATE)} AS st, {_KIND} AS kd FROM facts), s AS (SELECT *, st AND len(su) > 0 AS st2 FROM k)
SELECT conv_id, pos, CASE WHEN len(ws) > 0 THEN {key(f"'claim.user.' || {joined('ws', '.')}")} END AS claim_key, CASE WHEN len(ws) > 0 THEN 'asserted' END AS claim_status, CASE WHEN st2 THEN {key(f"'state.' || kd || '.' || {joined('su', '.')}")} END AS state_key,
  CASE WHEN st2 THEN kd END AS state_kind, CASE WHEN st2 THEN {joined('su')} END AS state_subject, CASE WHEN st2 THEN CASE WHEN length({_LINE}) > {X.VALUE} THEN left({_LINE}, {X.VALUE}) || '...' ELSE {_LINE} END END AS state_value FROM s""")
def m12(spark, d):
    return X.enriched(X.extracted(diary(spark, d))).drop("kind", "fact")


def _every(p: str, g: int = 0) -> str:
    return f"regexp_extract_all(b, {lit(p)}, {g})"


def _low(p: str) -> str:
    return each(_every(p), lambda x: f"lower({x})")


def _mark(test: str, *tags: str) -> str:
    return f"CASE WHEN {test} THEN [{', '.join(map(lit, tags))}] ELSE {NONE} END"


_DAYS = f"list_filter({each(_every(X.DATE), lambda x: f'try_cast(replace({x}, {lit("/")}, {lit("-")}) AS DATE)')}, lambda x: x IS NOT NULL)"
_TAGS = [
    _every(X.DATE), f"flatten(list_transform({_DAYS}, lambda x: [strftime(x, '%A'), strftime(x, '%B')]))", each(_every(X.WEEKDAY), lambda x: f"upper({x}[1]) || lower({x}[2:])"), _low(X.RELATIVE), _low(X.CLOCK), _every(X.MONEY),
    f"list_transform({_every(X.UNIT_NUMBER, 1)}, lambda n, i: n || ' ' || {_every(X.UNIT_NUMBER, 2)}[i])", _every(X.NUMBER), keep(_every(X.PROPER), lambda x: f"length({x}) >= 3 AND lower({x}) NOT IN {any_word(X.TAG_SKIP)}"),
    _low(X.ERRAND), _low(X.MEDICAL), _low(X.HAPPENING), _low(X.ENTERTAINMENT), _mark(some("b", X.PENDING, X.ERRAND), "pending", "task"), _mark(match("b", X.APPOINTMENT), "appointment"), _mark(match("b", X.HEALER), "medical"),
    _mark(match("b", X.EVENT), "event"), _mark(match("b", X.RECOMMENDED), "recommendation"), _mark(match("b", X.ENTERTAINMENT), "entertainment"),
]
TAGGED = [
    "Book the dentist for 2024-02-29 at 9am, it costs £1,200.50 and 3 weeks.", "Ann and the Old Club meet next Friday at 18:30 for a film. Drop off the book!", "The clinic said 5 km on MONDAY, twice a week, 20 percent.",
    "Can you recommend a concert this weekend? Observed on 2024/13/40.",
]


@query("m10_fact_tags", f"WITH {DIARY_SQL}, t AS (SELECT conv_id, turn, left([{', '.join(map(lit, TAGGED))}][1 + turn % {len(TAGGED)}] || ' ' || text, {X.READ_FOR_TAGS}) AS b FROM diary) SELECT conv_id, turn, list_sort(list_distinct({keep(each(f'flatten([{", ".join(_TAGS)}])', lambda x: f'trim({x})'), lambda x: f'{x} <> {lit("")}')})) AS tags FROM t")
def m10_fact(spark, d):
    first = F.element_at(F.array(*[F.lit(x) for x in TAGGED]), (F.col("turn") % len(TAGGED) + 1).cast("int"))
    return diary(spark, d).select("conv_id", "turn", X.fact_tags(F.concat(first, F.lit(" "), "text")).alias("tags"))
