"""Queries of probes, with their SQL built from the rules: spans, facets and probes by kind of question."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import probes as P
from ..operators import questions, search
from ..session import table
from ..sources.hits import ASKED_SQL, POSED_SQL, SEARCHED_SQL, TOK, any_word, asked, posed, searched
from .registry import query

_fresh = (f"v{i}" for i in itertools.count())


def each(values: str, f) -> str:
    v = next(_fresh)
    return f"list_transform({values}, lambda {v}: {f(v)})"


def keep(values: str, f) -> str:
    v = next(_fresh)
    return f"list_filter({values}, lambda {v}: {f(v)})"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def match(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def joined(values: str, by: str = " ") -> str:
    return f"coalesce(array_to_string({values}, {lit(by)}), '')"


def ordered(values: str, most: int | None = None) -> str:
    """Distinct trimmed values where they come first, without nulls and empty ones."""
    some = each(keep(values, lambda v: f"{v} IS NOT NULL AND trim({v}) <> ''"), lambda v: f"[trim({v})]")
    a, b = next(_fresh), next(_fresh)
    full = f"len({a}) >= {most} OR " if most else ""
    return f"(list_reduce(list_concat([CAST([] AS VARCHAR[])], {some}), lambda {a}, {b}: CASE WHEN {full}list_contains({a}, {b}[1]) THEN {a} ELSE list_concat({a}, {b}) END))"


NONE = "CAST([] AS VARCHAR[])"
ENDS = any_word(W.BOUNDARY)
STOPS = any_word(W.QUESTION_STOP)
SKIPS = any_word(W.FACET_SKIP)


def when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE {NONE} END"


def words(text: str) -> str:
    return keep(each(f"regexp_split_to_array(trim(lower({text})), '\\s+')", lambda t: f"trim({t}, {lit('.,;:!?' + chr(34) + chr(39) + '()[]{}<>')})"), lambda t: f"{t} <> ''")


def bare(text: str, skip: list[str] = ()) -> str:
    more = f" AND {{0}} NOT IN {any_word(list(skip))}" if skip else ""
    return ordered(keep(words(text), lambda t: f"strlen({t}) >= 3 AND {t} NOT IN {STOPS} AND NOT {match(t, r'\p{Nd}')}" + more.format(t)))


def runs(toks: str, ends: str = ENDS) -> str:
    marked = each(toks, lambda t: f"CASE WHEN {t} NOT IN {ends} AND strlen({t}) >= 2 AND NOT {match(t, r'\p{Nd}')} THEN {t} ELSE chr(1) END")
    return keep(each(f"string_split({joined(marked)}, chr(1))", lambda s: f"trim({s})"), lambda s: f"{s} <> ''")


def head_of(span: str, n: int) -> str:
    return joined(f"string_split({span}, ' ')[1:{n}]")


def tail_of(span: str, n: int) -> str:
    return joined(f"string_split({span}, ' ')[-{n}:]")


def best(span: str) -> str:
    w = f"string_split({span}, ' ')"
    four = each(f"range(1, len({w}) - 2)", lambda i: joined(f"{w}[{i}:{i} + 3]"))
    longest = keep(four, lambda p: f"strlen({p}) = list_max({each(four, lambda x: f'strlen({x})')})")
    return f"CASE WHEN len({w}) < 2 THEN NULL WHEN len({w}) <= 4 THEN {span} ELSE ({longest})[1] END"


def two_words(span: str) -> str:
    return f"CASE WHEN contains({span}, ' ') THEN {span} END"


def singular(t: str) -> str:
    ends = lambda x, n=0: f"(ends_with({t}, '{x}')" + (f" AND strlen({t}) > {n})" if n else ")")
    two = " OR ".join(ends(x, n) for x, n in (("oes", 4), ("ches", 5), ("shes", 5), ("xes", 4), ("ses", 4)))
    return f"CASE WHEN {ends('ss')} OR {ends('us')} THEN {t} WHEN {ends('ies', 4)} THEN left({t}, length({t}) - 3) || 'y' WHEN {two} THEN left({t}, length({t}) - 2) WHEN {ends('s', 3)} THEN left({t}, length({t}) - 1) ELSE {t} END"


def owner(t: str) -> str:
    return f"regexp_replace({t}, '(''s|’s)$', '')"


def named(text: str) -> str:
    return keep(each(words(text), owner), lambda t: f"{t} NOT IN {ENDS} AND {t} NOT IN {STOPS} AND {t} NOT IN {SKIPS} AND NOT {match(t, r'\p{Nd}')}")


def entity(text: str) -> str:
    some = keep(each(words(text), lambda t: singular(owner(t))), lambda t: f"{t} <> '' AND {t} NOT IN {ENDS} AND {t} NOT IN {STOPS} AND {t} NOT IN {SKIPS} AND NOT {match(t, r'\p{Nd}')}")
    return f"coalesce(({some})[1], '')"


def past(t: str) -> str:
    known = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in P.PAST.items())
    return f"CASE {t} {known} ELSE CASE WHEN ends_with({t}, 'e') THEN {t} || 'd' WHEN ends_with({t}, 'y') AND strlen({t}) > 1 THEN left({t}, length({t}) - 1) || 'ied' ELSE {t} || 'ed' END END"


def event(span: str) -> str:
    w = f"string_split(regexp_replace({span}, '^(?:(?:many|much|long)(?: |$))+', ''), ' ')"
    return when(f"len({w}) >= 2", f"[{joined(f'{w}[1:4]')}, {joined(f'list_concat([{past(f'{w}[1]')}], {w}[2:4])')}]")


PHRASES = when("len(toks) >= 2", ordered("list_concat(flatten(list_transform(toks, lambda t, i: " + when(f"t IN {any_word(W.CONNECTORS)}", f"[{two_words(tail_of(f'({runs("toks[1:i - 1]")})[-1]', 4))}, {two_words(head_of(f'({runs("toks[i + 1:]")})[1]', 4))}]") + f")), {each(runs('toks'), best)})", 2))
TYPES = f"({match('q', P.TOTAL)} AND {match('q', P.TYPES_OF)})"
WHAT, WHERE = (entity(f"regexp_extract(q, {lit(p)}, 1)") for p in (P.TYPES_OF, P.SCOPE))
DAY_ENDS = any_word([*W.BOUNDARY, *W.DAY_BOUNDARY])
STATED = ordered(f"flatten({each(f'[{joined(bare(f'regexp_extract(q, {lit(P.DAYS_AGO)}, 1)'))}, {joined(bare(f'regexp_extract(q, {lit(P.DAYS_AGO)}, 2)'))}]', event)})", 8)
REST = f"replace(regexp_replace(regexp_replace(rtrim(regexp_extract(q, {lit(P.INCLUDING)}, 1)), '[?.! ]+$', ''), {lit(P.LIST_END)}, ''), ', and ', ', ')"
MEMBERS = f"flatten({each(each(f'string_split({REST}, {lit(",")})', lambda p: f'trim({p})'), lambda p: f'CASE WHEN contains(lower({p}), {lit(" and ")}) AND NOT contains(lower({p}), {lit("flea and tick")}) THEN regexp_split_to_array({p}, {lit("(?i)\\s+and\\s+")}) ELSE [{p}] END')})"


def member(p: str) -> str:
    clean = f"regexp_replace(regexp_replace(lower(trim({p})), {lit(P.PIECES)}, '', 'g'), {lit(P.ITEMS_OF)}, '', 'g')"
    return joined(f"({bare(clean, [*W.BOUNDARY, *W.COUNT_SKIP])})[-4:]")


def money(p: str) -> str:
    w = f"string_split({p}, ' ')"
    heads = any_word(W.HEADS)
    head = f"CASE WHEN len({w}) >= 2 AND {w}[-1] IN {heads} THEN {tail_of(p, 2)} ELSE {w}[-1] END"
    return f"CASE WHEN len({w}) >= 3 AND contains({w}[1], '-') AND {w}[-1] IN {heads} THEN {w}[1] || ' ' || {w}[-1] WHEN ({head}) <> {p} AND len({w}) <= 2 THEN ({head}) || ' cost' ELSE {p} END"


IDEA = "(" + " OR ".join(f"contains(lower(q), '{x}')" for x in W.INSPIRED) + ")"
IDEA_FOCUS = f"({bare('q', W.INSPIRED_SKIP)})[-1]"
TITLED = "(" + " OR ".join(f"contains(lower(q), '{x}')" for x in ("previous chat", "previous conversation", "remind me", "specific")) + ")"


def title(m: str) -> str:
    w = keep(each(words(m), owner), lambda t: f"{t} <> '' AND {t} NOT IN {ENDS} AND {t} NOT IN {STOPS}")
    return f"CASE WHEN len({w}) >= 2 THEN {joined(w)} END"


SEVERAL = "(" + " OR ".join([*[f"contains(lower(q), '{x}')" for x in (" and ", " or ", " including ", " between ", " from ")], *[f"contains(q, {lit(x)})" for x in (",", "'", '"')]]) + ")"
_T = owner("lower(w)")
CODED = f"""list_transform(named_, lambda w, i: chr(1) || CASE WHEN {_T} IN {ENDS} OR {_T} IN {STOPS} OR {_T} IN {any_word(W.CONNECTORS)} THEN CASE WHEN {_T} IN {any_word(W.GLUE)} AND coalesce({match('named_[i + 1]', r'^\p{Lu}')}, false) THEN 'k' ELSE 'b' END
  WHEN {match('w', r'^\p{Lu}')} THEN CASE WHEN {_T} IN {SKIPS} THEN 'c' ELSE 'C' END WHEN strlen({_T}) >= 3 AND {_T} NOT IN {SKIPS} AND NOT {match(_T, r'\p{Nd}')} THEN 't' ELSE 'o' END || w)"""
RUNS = "list_transform(regexp_extract_all(" + joined(CODED, "") + ", '\\x01C[^\\x01]*(?:\\x01[Cck][^\\x01]*)*(?:\\x01t[^\\x01]*)?'), lambda r: trim(regexp_replace(r, '\\x01[a-zA-Z]', ' ', 'g')))[1:4]"
HEAD = f"coalesce({singular(f'({named("parts[1]")})[-1]')}, '')"


def segment(p: str) -> str:
    probe = f"CASE WHEN len({named(p)}) = 1 THEN ({named(p)})[1] WHEN len({named(p)}) > 1 THEN {best(joined(named(p)))} END"
    alone = f"head <> '' AND len({bare(f'coalesce({probe}, {lit("")})')}) = 1"
    return f"list_filter([{probe}, CASE WHEN {alone} THEN head || ' ' || ({probe}) END], lambda x: x IS NOT NULL)"


def facet(c: str) -> str:
    w = f"({named(c)})[1:4]"
    return f"CASE WHEN len({w}) > 1 OR (len({w}) = 1 AND strlen(({w})[1]) >= 4) THEN {joined(w)} END"


def without_question(values: str) -> str:
    return f"({keep(ordered(values), lambda p: f'{p} <> lower(trim(q))')})"


ACTIONS = "[" + ", ".join(f"CASE WHEN {match('q', p)} THEN '{name}' END" for p, name in P.ACTIONS) + "]"
FOCUSED = bare("q", W.ACTION_SKIP)
_PHRASES = f"list_filter(phrases, lambda p: len({bare('p', W.LOW_SIGNAL)}) > 0)"
_FIRST = f"list_concat({when(f'{match('lower(trim(q))', P.EXACT)} AND (contains(lower(q), {lit("recommend")}) OR contains(lower(q), {lit("remind me")}))', 'phrases')}, money, action_context, ideas)"
RANKED = f"list_transform(list_sort(list_transform({bare('CASE WHEN len(phrases) > 0 THEN ' + joined('phrases') + ' ELSE q END')}, lambda t, i: {{'n': -strlen(t), 'i': i, 't': t}})), lambda s: s.t)"
#: The probes of each question in SQL, stage by stage; stands behind ASKED_SQL.
PROBES_SQL = f"""pa AS MATERIALIZED (SELECT *, question AS q, {words('question')} AS toks, regexp_extract_all(question, {lit(P.WORD)}) AS named_, regexp_split_to_array(question, {lit(P.PARTS)}) AS parts FROM asked),
pb AS MATERIALIZED (SELECT *, {PHRASES} AS all_phrases, {HEAD} AS head FROM pa), pc AS MATERIALIZED (SELECT *, {_PHRASES.replace('list_filter(phrases', 'list_filter(all_phrases')} AS phrases FROM pb),
pd AS MATERIALIZED (SELECT *, {when(f"{TYPES} AND {match('q', P.SCOPE)} AND {WHAT} <> '' AND {WHERE} <> '' AND {WHAT} <> {WHERE}", f"[{WHERE} || ' ' || {WHAT}, {WHAT} || ' ' || {WHERE}]")} AS type_context,
  {when(match('lower(q)', P.DAYS_BETWEEN), f"CASE WHEN {match('q', P.DAYS_AGO)} AND len({STATED}) > 0 THEN {STATED} ELSE {ordered(f'flatten({each(runs("toks", DAY_ENDS), event)})', 8)} END")} AS day_spans,
  {when(f"{match('q', P.TOTAL)} AND NOT {match('q', P.MONEY_EVENT)} AND {match('q', P.INCLUDING)}", ordered(each(MEMBERS, member), 8))} AS totals,
  {when(f"{match('q', P.TOTAL)} AND {match('q', P.MONEY_EVENT)}", ordered(each('phrases', money), 2))} AS money, {when("contains(lower(q), 'when')", ordered(ACTIONS, 2))} AS action,
  {when(f"{IDEA} AND {IDEA_FOCUS} IS NOT NULL", f"[{IDEA_FOCUS} || ' inspiration', {IDEA_FOCUS} || ' examples']")} AS ideas, {when(TITLED, ordered(each(f"regexp_extract_all(q, {lit(P.TITLE)})", title), 2))} AS titles,
  {when(SEVERAL, without_question(each(f"list_concat(regexp_extract_all(q, {lit(P.QUOTED)}, 1), {RUNS}, {when('len(parts) > 1', f'(flatten({each("parts", segment)}))[1:4]')})", facet)) + '[1:4]')} AS facets, {FOCUSED} AS focused FROM pc),
pe AS MATERIALIZED (SELECT *, {ordered(f"flatten({each('action', lambda k: each(f"CASE len(focused) WHEN 0 THEN {NONE} WHEN 1 THEN focused WHEN 2 THEN [{joined('focused')}] ELSE [{joined('focused[-2:]')}, {joined('focused[1:2]')}] END", lambda f: f"{f} || ' ' || {k}"))})", 2)} AS action_context FROM pd),
pf AS MATERIALIZED (SELECT *, {without_question(f"list_concat({_FIRST}, phrases)")}[1:2] AS first, {without_question(f"list_concat({_FIRST}, action, list_filter(phrases, lambda p: NOT {IDEA} OR len({bare('p', W.INSPIRED_SKIP)}) > 0), {when(f'len({RANKED}) >= 2', f'list_filter({RANKED}, lambda t: NOT ({IDEA} AND t IN {any_word(W.INSPIRED_SKIP)}))')})")}[1:2] AS sub_queries FROM pe),
probes AS MATERIALIZED (SELECT *, {ordered("list_concat(type_context, day_spans, totals, first, titles)", 8)} AS priority, {ordered("list_concat([q], type_context, facets, phrases)", 3)} AS vector FROM pf)"""
A = f"WITH {ASKED_SQL}, {PROBES_SQL}"


def _derived(spark, d):
    return P.derived(asked(spark, d))


@query("q14_vector_probes", f"{A} SELECT query_no, vector AS probes FROM probes")
def q14(spark, d):
    return _derived(spark, d).select("query_no", F.col("vector").alias("probes"))


@query("q15_priority_probes", f"{A} SELECT query_no, priority AS probes FROM probes")
def q15(spark, d):
    return _derived(spark, d).select("query_no", F.col("priority").alias("probes"))


@query("q16_sub_queries", f"{A} SELECT query_no, sub_queries FROM probes")
def q16(spark, d):
    return _derived(spark, d).select("query_no", "sub_queries")


@query("q17_phrase_probes", f"{A} SELECT query_no, phrases FROM probes")
def q17(spark, d):
    return _derived(spark, d).select("query_no", "phrases")


@query("q18_coverage_facets", f"{A} SELECT query_no, facets FROM probes")
def q18(spark, d):
    return _derived(spark, d).select("query_no", "facets")


@query("q19_probes_by_kind", f"{A} SELECT query_no, type_context, day_spans, totals, money, action, action_context, ideas, titles FROM probes")
def q19(spark, d):
    return _derived(spark, d).select("query_no", "type_context", "day_spans", "totals", "money", "action", "action_context", "ideas", "titles")


def bm25_probes(spark, d):
    rows = asked(spark, d)
    return P.bm25_probes(rows, questions.date_hints(F.col("question"), F.col("day")))


def aliases(spark, d):
    """Part names stand for their brands and types, the last word of each for its type with a hyphen."""
    part = table(spark, d, "part")
    last = F.split_part("p_name", F.lit(" "), F.lit(2))
    one = part.select(F.col("p_name").alias("trigger"), F.col("p_brand").alias("alternative"))
    two = part.select(F.upper("p_name").alias("trigger"), F.concat(F.lit(" "), F.col("p_type")).alias("alternative"))
    three = part.select(last.alias("trigger"), F.concat_ws("-", last, "p_type").alias("alternative"))
    return one.unionByName(two).unionByName(three).unionByName(part.select(F.lit(" ").alias("trigger"), F.col("p_type").alias("alternative"))).distinct()


ALIASES_SQL = """aliases AS (SELECT DISTINCT trim(lower(trigger)) AS trigger, trim(regexp_replace(lower(alternative), '[^\\p{L}\\p{Nd}]+', ' ', 'g')) AS text FROM (
  SELECT p_name AS trigger, p_brand AS alternative FROM part UNION ALL SELECT upper(p_name), ' ' || p_type FROM part UNION ALL SELECT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) || '-' || p_type FROM part) WHERE trim(trigger) <> '')"""


@query("q5_aliases", f"""WITH RECURSIVE {ASKED_SQL}, {ALIASES_SQL}, tk AS (SELECT query_no, {TOK.format('question')} AS toks FROM asked),
lens AS (SELECT DISTINCT len(string_split(trigger, ' ')) AS n FROM aliases), tr AS (SELECT DISTINCT trigger FROM aliases),
g AS (SELECT query_no, i, max(n) AS n FROM tk, lens, unnest(range(1, len(toks) + 1)) AS u(i) JOIN tr ON trigger = array_to_string(toks[i : i + n - 1], ' ') WHERE i + n - 1 <= len(toks) GROUP BY ALL),
w AS (SELECT tk.query_no, 1 AS i, coalesce(g.n, 1) AS n, g.n IS NOT NULL AS hit FROM tk LEFT JOIN g ON g.query_no = tk.query_no AND g.i = 1
  UNION ALL SELECT w.query_no, w.i + w.n, coalesce(g.n, 1), g.n IS NOT NULL FROM w JOIN tk ON tk.query_no = w.query_no LEFT JOIN g ON g.query_no = w.query_no AND g.i = w.i + w.n WHERE w.i + w.n <= len(toks)),
e AS (SELECT w.query_no, i, CASE WHEN hit THEN a.text ELSE toks[i] END AS text FROM w JOIN tk ON tk.query_no = w.query_no LEFT JOIN aliases a ON hit AND a.trigger = array_to_string(toks[i : i + n - 1], ' ')),
f AS (SELECT query_no, CASE WHEN contains(text, ' ') THEN 'phrase' ELSE 'term' END AS kind, text, min(i) AS i FROM e WHERE text IS NOT NULL AND text <> '' GROUP BY ALL)
SELECT query_no, CAST(row_number() OVER (PARTITION BY query_no ORDER BY i, text, kind) AS INT) AS pos, kind, text FROM f""")
def q5(spark, d):
    return questions.expand_aliases(asked(spark, d), aliases(spark, d))


COVERED = ("title", "summary", "tag_text", "content")


def cover_sql(source: str, wanted: str) -> str:
    """Covers by windows: at each occurrence the least of the last places of all terms; a new least ends a cover."""
    parts = [f"SELECT chunk_id, unnest({TOK.format(f)}) AS term, unnest(range(len({TOK.format(f)}))) + {' + '.join(f'len({TOK.format(b)})' for b in COVERED[:n]) or '0'} AS place, {1 / search.COVER_FIELDS[f]} AS inverse FROM {source}" for n, f in enumerate(COVERED)]
    return f"""o AS (SELECT query_no, chunk_id, term, place, inverse FROM ({' UNION ALL '.join(parts)}) JOIN {wanted} USING (term)),
i AS (SELECT *, row_number() OVER w AS i, sum(inverse) OVER w AS upto FROM o WINDOW w AS (PARTITION BY query_no, chunk_id ORDER BY place)), nt AS (SELECT query_no, count(DISTINCT term) AS n FROM {wanted} GROUP BY ALL),
t AS (SELECT DISTINCT query_no, term FROM {wanted}), l AS (SELECT i.query_no, i.chunk_id, i.i, t.term, max(j.i) AS last FROM i JOIN t ON t.query_no = i.query_no ASOF JOIN i j ON j.query_no = i.query_no AND j.chunk_id = i.chunk_id AND j.term = t.term AND i.i >= j.i GROUP BY ALL),
m AS (SELECT query_no, chunk_id, i, min(last) AS low FROM l JOIN nt USING (query_no) GROUP BY query_no, chunk_id, i, n HAVING count(*) = n), f AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY query_no, chunk_id ORDER BY i), 0) AS before FROM m),
c AS (SELECT f.query_no, f.chunk_id, (f.i - f.low + 1) / (e.upto - b.upto + b.inverse) / (1 + e.place - b.place - (f.i - f.low)) AS gain FROM f JOIN i e ON e.query_no = f.query_no AND e.chunk_id = f.chunk_id AND e.i = f.i JOIN i b ON b.query_no = f.query_no AND b.chunk_id = f.chunk_id AND b.i = f.low WHERE low > before)
SELECT query_no, chunk_id, CAST(count(*) AS INT) AS covers, round(sum(gain), 9) AS score FROM c GROUP BY ALL"""


@query("f10_cover_density", f"WITH {SEARCHED_SQL}, {POSED_SQL}, {PROBES_SQL}, sought AS (SELECT DISTINCT query_no, unnest(string_split(phrases[1], ' ')) AS term FROM probes), " + cover_sql("searched", "sought"))
def f10(spark, d):
    first = P.derived(posed(spark, d)).select("query_no", F.explode(F.split(F.try_element_at("phrases", F.lit(1)), " ")).alias("term"))
    return search.cover_density(searched(spark, d), first)
