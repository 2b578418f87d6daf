"""What else is searched for a question: spans around its connectors and boundary words, facets, and probes by its kind.

All rules are column expressions over a table of questions; ``derived`` adds them stage by
stage, as later ones rest on earlier ones.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import words as W

# Most probes of each kind, and words of a span.
MOST_BM25, MOST_VECTOR, MOST_DERIVED, MOST_FACETS = 8, 3, 2, 4
LEAST_WORDS, MOST_WORDS = 2, 4
# Patterns of questions.
TOTAL = r"(?i)\b(?:how many|count|total|in total|sum|add up|list|what are all)\b"
MONEY_EVENT = r"(?i)\b(?:spent|spend|cost|costed|paid|pay)\b"
EXACT = r"(?i)\b(?:specific|exact)\b"
INCLUDING = r"(?i)\bincluding\s+(.+)$"
DAYS_BETWEEN = r"(?i)\bhow many days?\b.*\b(?:when|between|before|after)\b"
TYPES_OF = r"(?i)\b(?:different\s+)?(?:types?|kinds?|varieties)\s+of\s+(.+?)\s+(?:have|has|had|do|does|did|am|are|is|was|were|use|used|using|try|tried|trying|make|made|cook|cooked|in|for|with)\b"
SCOPE = r"(?i)\b(?:in|for|with)\s+(?:my|our|the|a|an)?\s*(.+?)(?:[?.!]|$)"
TITLE = r"\b[A-Z][A-Za-z0-9'’.-]*(?:\s+[A-Z][A-Za-z0-9'’.-]*){1,4}\b"
DAYS_AGO = r"(?i)\bhow many days?\s+ago\s+did\s+i\s+(.+?)\s+when\s+i\s+(.+?)(?:[?.!]|$)"
ACTIONS = [
    (r"(?i)\bsubmit(?:ted)?\b", "submission date"),
    (r"(?i)\bbook(?:ed|ing)?\b", "booking date"),
    (r"(?i)\b(?:buy|bought|purchase(?:d)?|order(?:ed)?)\b", "purchase date"),
    (r"(?i)\b(?:join(?:ed)?|joined)\b", "join date"),
    (r"(?i)\b(?:start(?:ed)?|begin|began)\b", "start date"),
    (r"(?i)\b(?:finish(?:ed)?|complete(?:d)?)\b", "completion date"),
    (r"(?i)\baccept(?:ed|ance)?\b", "acceptance date"),
]
PAST = {"buy": "bought", "begin": "began", "catch": "caught", "drive": "drove", "ride": "rode", "see": "saw", "sell": "sold", "take": "took", "travel": "travelled"}
QUOTED = "[\"'“”‘’]([^\"'“”‘’]{2,80})[\"'“”‘’]"
WORD = r"\b[A-Za-z0-9][A-Za-z0-9'’.-]*\b"
PARTS = r"(?i)\b(?:and|or|including|between|from|to)\b|[,;:]"
LIST_END = r"(?i)\b(?:since|from|across|over|during|when|where)\b.*$"
PIECES = r"(?i)\bpieces?\s+for\s+(?:the\s+)?"
ITEMS_OF = r"(?i)\b(?:pieces?|items?|parts?|entries?|tasks?|things?)\s+of\s+"
#: What a word has at its ends and is not part of it.
MARKS = r"""^[.,;:!?"'()\[\]{}<>]+|[.,;:!?"'()\[\]{}<>]+$"""

_NONE = "cast(array() as array<string>)"


def none() -> Column:
    return F.expr(_NONE)


def phrase_tokens(text: Column) -> Column:
    """Lower-cased words without the marks around them."""
    return F.filter(F.transform(F.split(F.trim(F.lower(text)), r"\s+"), lambda t: F.regexp_replace(t, MARKS, "")), lambda t: t != "")


def _digit(t: Column) -> Column:
    return t.rlike(r"\p{Nd}")


def _bare(toks: Column) -> Column:
    return F.array_distinct(F.filter(toks, lambda t: (F.octet_length(t) >= 3) & ~t.isin(W.QUESTION_STOP) & ~_digit(t)))


def question_tokens(text: Column) -> Column:
    """Distinct words of three bytes or more, without stop words and words with digits."""
    return _bare(phrase_tokens(text))


def without(text: Column, skip: list[str]) -> Column:
    return F.filter(question_tokens(text), lambda t: ~t.isin(skip))


def spans(toks: Column, ends: list[str]) -> Column:
    """Runs of words that no word of ``ends``, no single letter and no word with a digit breaks, each joined by spaces."""
    inside = lambda t: ~t.isin(ends) & (F.octet_length(t) >= 2) & ~_digit(t)
    joined = F.array_join(F.transform(toks, lambda t: F.when(inside(t), t).otherwise("\x01")), " ")
    return F.filter(F.transform(F.split(joined, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def _first(span: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(span, " "), 1, n), " ")


def _last(span: Column, n: int) -> Column:
    w = F.split(span, " ")
    return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - (n - 1)), F.lit(n)), " ")


def _phrase(span: Column) -> Column:
    """The span if it has two words at least."""
    return F.when(span.contains(" "), span)


def best_phrase(span: Column) -> Column:
    """A span of two to four words as it is; of a longer one its four neighbouring words with the most letters, the first of these."""
    w = F.split(span, " ")
    four = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (MOST_WORDS - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(MOST_WORDS)), " "))
    most = F.array_max(F.transform(four, lambda p: F.octet_length(p)))
    return F.when(F.size(w) < LEAST_WORDS, F.lit(None).cast("string")).when(F.size(w) <= MOST_WORDS, span).otherwise(F.try_element_at(F.filter(four, lambda p: F.octet_length(p) == most), F.lit(1)))


def distinct(values: Column, most: int | None = None) -> Column:
    """Distinct trimmed values in order, without empty ones, ``most`` at most."""
    out = F.array_distinct(F.filter(F.transform(F.array_compact(values), lambda v: F.trim(v)), lambda v: v != ""))
    return out if most is None else F.slice(out, 1, most)


def phrase_probes(toks: Column) -> Column:
    """Two phrases at most: those left and right of each connector, then the best of each span between boundary words."""

    def beside(t: Column, i: Column) -> Column:
        left = _last(F.try_element_at(spans(F.slice(toks, F.lit(1), i), W.BOUNDARY), F.lit(-1)), MOST_WORDS)
        right = _first(F.try_element_at(spans(F.slice(toks, i + 2, F.size(toks)), W.BOUNDARY), F.lit(1)), MOST_WORDS)
        return F.when(t.isin(W.CONNECTORS), F.array(_phrase(left), _phrase(right))).otherwise(none())

    every = F.concat(F.flatten(F.transform(toks, beside)), F.transform(spans(toks, W.BOUNDARY), best_phrase))
    return F.when(F.size(toks) >= LEAST_WORDS, distinct(every, MOST_DERIVED)).otherwise(none())


def singular(t: Column) -> Column:
    """A word without a plural ending."""
    n = F.octet_length(t)
    cut = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    return (
        F.when(t.endswith("ss") | t.endswith("us"), t)
        .when(t.endswith("ies") & (n > 4), F.concat(cut(3), F.lit("y")))
        .when((t.endswith("oes") & (n > 4)) | (t.endswith("ches") & (n > 5)) | (t.endswith("shes") & (n > 5)) | (t.endswith("xes") & (n > 4)) | (t.endswith("ses") & (n > 4)), cut(2))
        .when(t.endswith("s") & (n > 3), cut(1))
        .otherwise(t)
    )


def _facet_token(t: Column) -> Column:
    return F.regexp_replace(t, "('s|’s)$", "")


def _facet_tokens(text: Column) -> Column:
    """The words of a facet: no boundary, stop or skipped word, no digits."""
    skipped = lambda t: t.isin(W.BOUNDARY) | t.isin(W.QUESTION_STOP) | t.isin(W.FACET_SKIP) | _digit(t)
    return F.filter(F.transform(phrase_tokens(text), _facet_token), lambda t: ~skipped(t))


def first_entity(text: Column) -> Column:
    """The first word of a text that can name something, in the singular."""
    kept = F.filter(
        F.transform(phrase_tokens(text), lambda t: singular(_facet_token(t))),
        lambda t: (t != "") & ~(t.isin(W.BOUNDARY) | t.isin(W.CONNECTORS) | t.isin(W.QUESTION_STOP) | t.isin(W.FACET_SKIP) | _digit(t)),
    )
    return F.coalesce(F.try_element_at(kept, F.lit(1)), F.lit(""))


def asks_types(question: Column) -> Column:
    """Whether a question counts the kinds of something."""
    return question.rlike(TOTAL) & question.rlike(TYPES_OF)


def type_context(question: Column) -> Column:
    """What is counted with where it is, in both orders."""
    what, where = first_entity(F.regexp_extract(question, TYPES_OF, 1)), first_entity(F.regexp_extract(question, SCOPE, 1))
    both = F.array(F.concat_ws(" ", where, what), F.concat_ws(" ", what, where))
    return F.when(asks_types(question) & question.rlike(SCOPE) & (what != "") & (where != "") & (what != where), both).otherwise(none())


def past(t: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in PAST.items() for x in pair])
    regular = F.when(t.endswith("e"), F.concat(t, F.lit("d"))).when(t.endswith("y") & (F.octet_length(t) > 1), F.concat(F.regexp_replace(t, "y$", ""), F.lit("ied"))).otherwise(F.concat(t, F.lit("ed")))
    return F.coalesce(F.try_element_at(known, t), regular)


def _event(span: Column) -> Column:
    """An event's first four words, as they stand and with the first one in the past."""
    w = F.split(F.regexp_replace(span, r"^(?:(?:many|much|long)(?: |$))+", ""), " ")
    four = F.slice(w, 1, MOST_WORDS)
    before = F.concat(F.array(past(F.try_element_at(four, F.lit(1)))), F.slice(four, 2, MOST_WORDS))
    return F.when(F.size(w) >= LEAST_WORDS, F.array(F.array_join(four, " "), F.array_join(before, " "))).otherwise(none())


def day_spans(question: Column, toks: Column) -> Column:
    """For questions about days between events: the events' words."""
    clauses = F.array(*[F.array_join(question_tokens(F.regexp_extract(question, DAYS_AGO, i)), " ") for i in (1, 2)])
    stated = distinct(F.flatten(F.transform(clauses, _event)), MOST_BM25)
    found = distinct(F.flatten(F.transform(spans(toks, [*W.BOUNDARY, *W.DAY_BOUNDARY]), _event)), MOST_BM25)
    events = F.when(question.rlike(DAYS_AGO) & (F.size(stated) > 0), stated).otherwise(found)
    return F.when(F.lower(question).rlike(DAYS_BETWEEN), events).otherwise(none())


def count_totals(question: Column) -> Column:
    """For questions that count: the members of the list after 'including'."""
    rest = F.regexp_replace(F.rtrim(F.regexp_extract(question, INCLUDING, 1)), r"[?.! ]+$", "")
    rest = F.replace(F.regexp_replace(rest, LIST_END, ""), F.lit(", and "), F.lit(", "))
    members = F.flatten(F.transform(F.transform(F.split(rest, ","), lambda p: F.trim(p)), lambda p: F.when(F.lower(p).contains(" and ") & ~F.lower(p).contains("flea and tick"), F.split(p, r"(?i)\s+and\s+")).otherwise(F.array(p))))

    def member(p: Column) -> Column:
        w = F.filter(question_tokens(F.regexp_replace(F.regexp_replace(F.lower(F.trim(p)), PIECES, ""), ITEMS_OF, "")), lambda t: ~t.isin(W.BOUNDARY) & ~t.isin(W.COUNT_SKIP))
        return F.array_join(F.slice(w, F.greatest(F.lit(1), F.size(w) - (MOST_WORDS - 1)), F.lit(MOST_WORDS)), " ")

    asks = question.rlike(TOTAL) & ~question.rlike(MONEY_EVENT) & question.rlike(INCLUDING)
    return F.when(asks, distinct(F.transform(members, member), MOST_BM25)).otherwise(none())


def recall_titles(question: Column) -> Column:
    """For questions about an earlier conversation: runs of capitalised words, two at most."""
    lower = F.lower(question)
    asks = lower.contains("previous chat") | lower.contains("previous conversation") | lower.contains("remind me") | lower.contains("specific")

    def title(m: Column) -> Column:
        w = F.filter(F.transform(phrase_tokens(m), _facet_token), lambda t: (t != "") & ~t.isin(W.BOUNDARY) & ~t.isin(W.QUESTION_STOP))
        return F.when(F.size(w) >= 2, F.array_join(w, " "))

    return F.when(asks, distinct(F.transform(F.regexp_extract_all(question, F.lit(TITLE), F.lit(0)), title), MOST_DERIVED)).otherwise(none())


def money_focuses(question: Column, phrases: Column) -> Column:
    """For questions that add up money: what it was spent on, two at most."""

    def focus(p: Column) -> Column:
        w = F.split(p, " ")
        first, last = F.try_element_at(w, F.lit(1)), F.try_element_at(w, F.lit(-1))
        head = F.when((F.size(w) >= 2) & last.isin(W.HEADS), _last(p, 2)).otherwise(last)
        edge = (F.size(w) >= 3) & first.contains("-") & last.isin(W.HEADS)
        return F.when(edge, F.concat_ws(" ", first, last)).when((head != p) & (F.size(w) <= 2), F.concat(head, F.lit(" cost"))).otherwise(p)

    return F.when(question.rlike(TOTAL) & question.rlike(MONEY_EVENT), distinct(F.transform(phrases, focus), MOST_DERIVED)).otherwise(none())


def action_dates(question: Column) -> Column:
    """For questions of when something was done: the kinds of date, two at most."""
    kinds = F.array(*[F.when(question.rlike(p), F.lit(name)) for p, name in ACTIONS])
    return F.when(F.lower(question).contains("when"), distinct(kinds, MOST_DERIVED)).otherwise(none())


def action_contexts(question: Column, kinds: Column) -> Column:
    """The question's last and first two words of focus before each kind of date, two at most."""
    w = without(question, W.ACTION_SKIP)
    n = F.size(w)
    two = lambda start: F.array_join(F.slice(w, start, F.lit(2)), " ")
    focuses = F.when(n == 0, none()).when(n <= 2, F.array(two(F.lit(1)))).otherwise(F.array(two(n - 1), two(F.lit(1))))
    return distinct(F.flatten(F.transform(kinds, lambda k: F.transform(focuses, lambda f: F.concat_ws(" ", f, k)))), MOST_DERIVED)


def inspired(question: Column) -> Column:
    return functools.reduce(operator.or_, [F.lower(question).contains(x) for x in W.INSPIRED])


def inspirations(question: Column) -> Column:
    """For questions that look for ideas: the last word of focus with 'inspiration' and 'examples'."""
    focus = F.try_element_at(without(question, W.INSPIRED_SKIP), F.lit(-1))
    return F.when(inspired(question) & focus.isNotNull(), F.array(F.concat(focus, F.lit(" inspiration")), F.concat(focus, F.lit(" examples")))).otherwise(none())


def facets(question: Column) -> Column:
    """Four facets at most: quoted phrases, capitalised runs, segments between connectors and commas; none unless the question can hold several."""
    lower = F.lower(question)
    several = functools.reduce(operator.or_, [*[lower.contains(x) for x in (" and ", " or ", " including ", " between ", " from ")], *[question.contains(x) for x in (",", "'", '"')]])
    quoted = F.regexp_extract_all(question, F.lit(QUOTED), F.lit(1))

    # each word behind a letter for what it is: C capitalised and significant, c capitalised only, k a glue word before a capital, t a word that may end a run
    each = F.regexp_extract_all(question, F.lit(WORD), F.lit(0))

    def coded(word: Column, i: Column) -> Column:
        t = _facet_token(F.lower(word))
        upper, ends = word.rlike(r"^\p{Lu}"), t.isin(W.BOUNDARY) | t.isin(W.QUESTION_STOP) | t.isin(W.CONNECTORS)
        follows = F.coalesce(F.try_element_at(each, i + 2).rlike(r"^\p{Lu}"), F.lit(False))
        tail = (F.octet_length(t) >= 3) & ~t.isin(W.FACET_SKIP) & ~_digit(t)
        kind = F.when(ends, F.when(t.isin(W.GLUE) & follows, "k").otherwise("b")).when(upper, F.when(t.isin(W.FACET_SKIP), "c").otherwise("C")).when(tail, "t").otherwise("o")
        return F.concat(F.lit("\x01"), kind, word)

    runs = F.regexp_extract_all(F.array_join(F.transform(each, coded), ""), F.lit("\x01C[^\x01]*(?:\x01[Cck][^\x01]*)*(?:\x01t[^\x01]*)?"), F.lit(0))
    names = F.slice(F.transform(runs, lambda r: F.trim(F.regexp_replace(r, "\x01[a-zA-Z]", " "))), 1, MOST_FACETS)

    parts = F.split(question, PARTS)
    heads = _facet_tokens(F.try_element_at(parts, F.lit(1)))
    head = F.coalesce(singular(F.try_element_at(heads, F.lit(-1))), F.lit(""))

    def segment(p: Column) -> Column:
        w = _facet_tokens(p)
        probe = F.when(F.size(w) == 1, w[0]).when(F.size(w) > 1, best_phrase(F.array_join(w, " ")))
        alone = (head != "") & (F.size(question_tokens(F.coalesce(probe, F.lit("")))) == 1)
        return F.array_compact(F.array(probe, F.when(alone, F.concat_ws(" ", head, probe))))

    segments = F.when(F.size(parts) > 1, F.slice(F.flatten(F.transform(parts, segment)), 1, MOST_FACETS)).otherwise(none())

    def facet(c: Column) -> Column:
        w = F.slice(_facet_tokens(c), 1, MOST_WORDS)
        return F.when((F.size(w) > 1) | ((F.size(w) == 1) & (F.octet_length(F.try_element_at(w, F.lit(1))) >= 4)), F.array_join(w, " "))

    every = distinct(F.transform(F.concat(quoted, names, segments), facet))
    return F.when(several, F.slice(F.filter(every, lambda p: p != F.trim(lower)), 1, MOST_FACETS)).otherwise(none())


def derived(questions: DataFrame, question: str = "question") -> DataFrame:
    """Adds the probes of each question: phrases, type_context, day_spans, totals, money, action, action_context, ideas,
    titles, facets, priority (eight at most), sub_queries (two), and vector (three, the question first).

    Null and empty questions have none but, for vector, themselves if they are not empty.
    """
    q = F.coalesce(F.col(question), F.lit(""))
    out = questions.withColumn("_tokens", phrase_tokens(q))
    out = out.withColumn("phrases", phrase_probes(F.col("_tokens")))
    out = out.withColumn("phrases", F.filter("phrases", lambda p: F.size(without(p, W.LOW_SIGNAL)) > 0))
    out = out.withColumns(
        {
            "type_context": type_context(q),
            "day_spans": day_spans(q, F.col("_tokens")),
            "totals": count_totals(q),
            "money": money_focuses(q, F.col("phrases")),
            "action": action_dates(q),
            "ideas": inspirations(q),
            "titles": recall_titles(q),
            "facets": facets(q),
        }
    )
    out = out.withColumn("action_context", action_contexts(q, F.col("action")))
    lower = F.lower(F.trim(q))
    exact = lower.rlike(EXACT) & (lower.contains("recommend") | lower.contains("remind me"))
    first = F.concat(F.when(exact, F.col("phrases")).otherwise(none()), "money", "action_context", "ideas")
    other = lambda values: F.slice(F.filter(distinct(values), lambda p: p != lower), 1, MOST_DERIVED)
    source = F.when(F.size("phrases") > 0, F.array_join("phrases", " ")).otherwise(q)
    # tokens by length, the longest first; equal ones keep their order
    ranked = F.array_sort(F.transform(question_tokens(source), lambda t, i: F.struct((-F.octet_length(t)).alias("n"), i.alias("i"), t.alias("t"))))
    tokens = F.when(F.size(ranked) >= 2, F.filter(F.transform(ranked, lambda s: s["t"]), lambda t: ~(inspired(q) & t.isin(W.INSPIRED_SKIP)))).otherwise(none())
    plain = F.filter("phrases", lambda p: ~inspired(q) | (F.size(without(p, W.INSPIRED_SKIP)) > 0))
    out = out.withColumns({"_first": other(F.concat(first, F.col("phrases"))), "sub_queries": other(F.concat(first, F.col("action"), plain, tokens))})
    return out.withColumns(
        {
            "priority": distinct(F.concat("type_context", "day_spans", "totals", "_first", "titles"), MOST_BM25),
            "vector": distinct(F.concat(F.array(q), "type_context", "facets", "phrases"), MOST_VECTOR),
        }
    ).drop("_tokens", "_first")


def bm25_probes(questions: DataFrame, hints: Column, question: str = "question") -> DataFrame:
    """Adds probes, what is searched for a question (eight at most): itself, itself with its dates, facets, priority probes, then
    sub-queries, or for questions of when something was done and two priority probes its phrases."""
    from .questions import augmented

    q = F.col(question)
    dated = F.when(F.size(hints) > 0, augmented(q, hints)).otherwise(q)
    out = derived(questions, question)
    rest = F.when((F.size("action_context") > 0) & (F.size("priority") >= 2), F.col("phrases")).otherwise(F.col("sub_queries"))
    return out.withColumn("probes", distinct(F.concat(F.array(q, dated), "facets", "priority", rest), MOST_BM25))


def focus_text(text: Column) -> Column:
    """Lower case, marks as spaces, runs of white space as one."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), "-/()[],.:;?!", "            "), r"\s+", " "))


def focus_words(text: Column) -> Column:
    """The words of a focus text, and the singular of each."""
    w = F.split(text, " ")
    return F.array_distinct(F.concat(w, F.transform(w, singular)))


def alignment(text: Column, words: Column, phrase: Column) -> Column:
    """How much of a phrase a text holds: 1 if it stands there as it is, else the share of its words; ``text`` by focus_text, ``words`` by focus_words."""
    p = focus_text(phrase)
    w = F.transform(F.split(p, " "), singular)
    share = F.size(F.filter(w, lambda t: F.array_contains(words, t))) / F.size(w)
    return F.when(p == "", 0.0).when(text.contains(p), 1.0).otherwise(share)
