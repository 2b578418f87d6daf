"""Facts out of sessions: an ordered chain of rules over users' sentences, each of which sees what earlier ones stored, and the keys of what they claim."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_bounds, metadata_key
from .conversations import sentences

# Messages of a session that are read, and what each rule stores at most.
RECENT = 80
MOST = {"application": 2, "creative": 2, "fact": 2, "milestone": 2, "pending": 3, "event": 2, "preference": 2}
# Patterns of sentences.
OWN = r"(?i)\b(i|i'm|i’ve|i've|me|my|we|we're|we’ve|we've|our)\b"
DATE = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b"
MONTH_DAY = r"(?i)\b(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{1,2}(?:st|nd|rd|th)?(?:,?\s+\d{4})?\b"
NUMBER = r"\b\d{1,6}(?:\.\d+)?\b"
WORD_UNIT = r"(?i)\b(?:a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(minutes?|mins?|hours?|hrs?|seconds?|secs?|days?|weeks?|months?|years?)\b"
LONG_TIME = r"(?i)\b(?:\d{1,4}-day|[a-z]+-day|[a-z]+-week|[a-z]+-month|[a-z]+-year|week-long|month-long|year-long)\b"
ORDINAL = r"(?i)\b(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\b"
CADENCE = r"(?i)\b(?:(?:every|each)\s+(?:other\s+)?(?:day|morning|afternoon|evening|night|weekday|weekend|week|month|year|monday|tuesday|wednesday|thursday|friday|saturday|sunday)|(?:biweekly|fortnightly|usually|normally|annually|yearly)|(?:once|twice)\s+(?:a|per)\s+(?:day|week|month|year)|\d+\s+times?\s+(?:a|per)\s+(?:day|week|month|year))\b"
STORED = r"(?i)\b(?:i|i'm|i’ve|i've|i have)\s+(?:been\s+)?(?:keep(?:ing)?|kept|stor(?:e|ing|ed)|stash(?:ed|ing)?|leave|left|put|placed)\b[^.!?\n]*\b(?:under|inside|in|on|at|behind|beside|next to)\b"
SETUP = r"(?i)\b(?:i|i'm|i’ve|i've|i have|my|we|we're|we’ve|we've|we have|our)\b[^.!?\n]{0,180}\b(?:recently\s+|just\s+)?(?:bought|purchased|got|received|installed|set\s+up|noticed|found|have|has|upgraded|replaced|fixed)\b[^.!?\n]{0,180}\b(?:to|for|because|so|with|without|inside|under|on|near|next to|beside|behind|around|in|at|by)\b"
REQUEST = r"(?i)\b(?:(?:can|could|would)\s+you|help\s+me|need\s+help|recommend|suggest|looking\s+for|look\s+for|what\s+should\s+i|which\s+should\s+i|where\s+should\s+i|what\s+to\s+watch|what\s+to\s+read|what\s+to\s+serve)\b"
ACTED = r"(?i)\b(?:i|i'm|i've|i have|i’ve|me|my|we|we're|we've|we have|we’ve|our)\b[^.!?\n]{0,180}\b(?:bought|purchased|got|received|installed|set\s+up|noticed|found|upgraded|settled\s+on|finished|completed|took\s+me|have\s+been|been\s+keeping|keep|kept|stor(?:e|ing|ed)|stash(?:ed|ing)?|left|put|placed)\b"
TOOK_ME = r"(?i)\btook\s+me\b"
DURATION = r"(?i)\b(?:(?:over|more\s+than|less\s+than|almost|about|around|nearly|roughly)\s+)?(?:\d{1,4}|a|an|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)\s+(?:days?|weeks?|months?|years?)\b"
_CASE = "application|asylum|immigration|visa|residen(?:cy|ce)|citizenship|naturalisation|naturalization|permit|appeal|case|claim|paperwork"
_STEP = "approv(?:ed|al)|accept(?:ed|ance)|grant(?:ed)?|process(?:ed|ing)|pending|submitted|filed|decid(?:ed|ing)?|wait(?:ed|ing)?|took"
APPLICATION = rf"(?i)\b(?:{_CASE})\b"
APPLICATION_STEP = rf"(?i)\b(?:{_CASE})\b[^.!?\n]{{0,200}}\b(?:{_STEP})\b|\b(?:{_STEP})\b[^.!?\n]{{0,200}}\b(?:{_CASE})\b"
_WORKS = r"(?:\d{1,4}|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty)\s+(?:short\s+stories|stories|poems|drafts|chapters|scenes|songs|essays|articles|posts|pieces|paintings|drawings|illustrations|tracks|scripts|screenplays|novels|pages)"
CREATIVE = rf"(?i)\b(?:i|i'm|i've|i have|i’ve|my|we|we're|we've|we have|we’ve|our)\b[^.!?\n]{{0,160}}\b(?:written|completed|finished|drafted|revised|edited|published|created|made)\b[^.!?\n]{{0,120}}\b{_WORKS}\b"
MILESTONE = r"(?i)\b(?:(?:just|recently)\s+)?(?:completed|submitted|graduated|finished|started|joined|accepted|presented)\b"
MILESTONE_WHEN = r"(?i)\b(?:today|yesterday|recently|just|last\s+(?:week|month|year|summer|spring|fall|autumn|winter))\b"
MILESTONE_WHAT = r"(?i)\b(?:degree|thesis|dissertation|paper|research|conference|course|class|project|internship|job|role|group|club|community|network|forum|association|society|linkedin)\b"
PENDING = r"(?i)^\s*(?:i(?:'ve)?(?:\s+still)?\s+(?:need|have)\s+to|i(?:'ve)?\s+got\s+to|i\s+must|i\s+should|i\s+need\s+to\s+remember\s+to|remember\s+to|don't\s+let\s+me\s+forget\s+to)\s+([^.!?]+)"
PENDING_START = r"(?i)^(?:pick\s+up|drop\s+off|return|exchange|collect|book|schedule|call|email|pay|renew|cancel|buy|send|post|fix|follow\s+up)\b"
EVENT = r"(?i)\b(?:workshop|conference|concert|gig|show|screening|play|musical|exhibition|festival|meetup|class|course|webinar|lecture|seminar|service|mass|worship|prayer|tournament)\b"
ATTENDED = r"(?i)\b(?:attend(?:ed|ing)?|went to|go(?:ing)? to|joined|join(?:ing)?|participat(?:e|es|ed|ing)|volunteer(?:ed|ing)|present(?:ed|ing)|watch(?:ed|ing)|listen(?:ed|ing)\s+to|got back from|completed)\b"
ASPIRED = r"(?i)\b(?:(?:want|hope|wish|dream|aspire)\s+to|(?:would|i'd)\s+like\s+to)\s+(?:attend|go\s+to|join|participat(?:e|es|ed|ing)|volunteer|present|watch|listen\s+to)\b"
BESIDES = r"(?i)\bbesides\s+([^.!?]+?),\s*i\s+(?:also\s+)?like\s+([^.!?]+?)(?:[.!?]|$)"
LIKES = r"(?i)\bi\s+(?:also\s+)?(?:like|love|prefer|enjoy)\s+([^.!?]+?)(?:[.!?]|$)"
WORD = r"[a-z][a-z-]{2,}"
SLUG_SKIP = "been city definitely feels following getting have just last lately miles months really routine sticking their weeks".split()
# What states and claims are made of.
STATE = r"(?i)\b(?:current(?:ly)?|now|still|no longer|changed|switched|settled on|replaced|own(?:s)?|have|has|use|attend|go to|take|learn(?:ing)?|play(?:ing)?|prefer|favo(?:u)?rite)\b"
STATE_KINDS = [
    ("owned_item_set", r"(?i)\b(?:own(?:s)?|have|has)\b"),
    ("location", r"(?i)\b(?:attend|go to|take|venue|studio|centre|center|class)\b"),
    ("current_activity", r"(?i)\b(?:learn(?:ing)?|play(?:ing)?|practis(?:e|ing)|practic(?:e|ing))\b"),
    ("preference", r"(?i)\b(?:prefer|favo(?:u)?rite|settled on)\b"),
]
KEY_SKIP = "about after also and assistant been before content currently date from have kind message mixed now observed ordinal section session source still that the this user with".split()
KEY_WORDS, SUBJECT_WORDS, VALUE = 6, 5, 220


def _any(s: Column, *patterns: str) -> Column:
    return functools.reduce(operator.or_, [s.rlike(ascii_bounds(p)) for p in patterns])


def application(s: Column) -> Column:
    """Tells how long an application of one's own took or what became of it."""
    return s.rlike(ascii_bounds(OWN)) & s.rlike(ascii_bounds(DURATION)) & s.rlike(ascii_bounds(APPLICATION)) & s.rlike(ascii_bounds(APPLICATION_STEP))


def quantified(s: Column) -> Column:
    return _any(s, WORD_UNIT, DATE, MONTH_DAY, LONG_TIME, NUMBER, ORDINAL)


def concrete(s: Column) -> Column:
    return _any(s, SETUP, STORED, ACTED, TOOK_ME, CREATIVE) | application(s)


def user_fact(s: Column) -> Column:
    """Speaks of oneself with a number, a habit, a place where something is kept or what was got, and is no request."""
    clause = F.regexp_extract(s, r"(?s)^([^.!?]*[.!?]?)", 1)
    request = (clause.rlike(ascii_bounds(REQUEST)) & ~concrete(clause)) | ((s.rlike(ascii_bounds(REQUEST)) | s.endswith("?")) & ~concrete(s))
    signal = quantified(s) | _any(s, CADENCE, STORED, SETUP, CREATIVE) | application(s)
    return s.rlike(ascii_bounds(OWN)) & signal & ~request


def milestone(s: Column) -> Column:
    return s.rlike(ascii_bounds(OWN)) & ~quantified(s) & s.rlike(ascii_bounds(MILESTONE_WHAT)) & _any(s, MILESTONE, MILESTONE_WHEN)


def event(s: Column) -> Column:
    return s.rlike(ascii_bounds(EVENT)) & s.rlike(ascii_bounds(ATTENDED)) & ~s.rlike(ascii_bounds(ASPIRED))


def pending(s: Column) -> Column:
    """What a sentence says is still to do: its clauses from one that begins with an errand to the next, or all of it."""
    rest = F.trim(F.regexp_extract(s, PENDING, 1))
    parts = F.filter(F.transform(F.split(rest, r"(?i)\s*(?:,|;|\bthen\b|\band\b)\s*"), lambda p: F.trim(p)), lambda p: p != "")
    none = F.array().cast("array<string>")
    last = lambda a: F.try_element_at(a, F.lit(-1))
    grow = lambda a, p: F.when(p.rlike(ascii_bounds(PENDING_START)), F.concat(a, F.array(p))).when(F.size(a) > 0, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat_ws(" ", last(a), p)))).otherwise(a)
    found = F.aggregate(parts, none, grow)
    return F.when(s.rlike(ascii_bounds(PENDING)) & ~F.trim(s).endswith("?") & (rest != ""), F.when(F.size(found) > 0, found).otherwise(F.array(rest))).otherwise(none)


def preference(s: Column) -> Column:
    """'The user prefers ...', of a sentence that says what one likes; null of others."""
    part = lambda p, i: F.trim(F.regexp_extract(s, p, i))
    both = F.concat(F.lit("The user prefers "), part(BESIDES, 1), F.lit(" and "), part(BESIDES, 2), F.lit("."))
    return F.when(s.rlike(ascii_bounds(BESIDES)), both).when(s.rlike(ascii_bounds(LIKES)) & (part(LIKES, 1) != ""), F.concat(F.lit("The user prefers "), part(LIKES, 1), F.lit(".")))


def slug(text: Column) -> Column:
    """The first five words of three letters or more that say something, with hyphens."""
    w = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), lambda t: ~t.isin(SLUG_SKIP))
    return F.array_join(F.slice(w, 1, 5), "-")


def _same(text: Column) -> Column:
    return F.lower(F.trim(text))


def extracted(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, kind, fact) of the RECENT newest messages of each session (conv_id, turn, role, text): what the rules store of users' turns, in the rules' order.

    Rules run one after the other over a session: applications (also over two sentences together, and whole short turns), finished works, facts about oneself (also whole turns
    that tell of habits or places), milestones, errands, events attended and preferences. A rule takes its first sentences in order that no
    rule before it stored, MOST of its kind. Sentences without a word of three letters are none; null texts have none. A session's messages are all that a group holds.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    own = turns.withColumn("_n", F.row_number().over(newest)).where((F.col("_n") <= RECENT) & (F.col("role") == "user") & F.col("text").isNotNull())
    whole = F.trim("text")
    rows = own.withColumn("s", sentences(F.col("text")))
    two = F.flatten(F.transform("s", lambda x, i: F.array_compact(F.array(x, F.concat_ws(" ", x, F.try_element_at("s", i + 2))))))
    short = F.when(F.size("s") <= 3, F.array(whole)).otherwise(F.array().cast("array<string>"))
    broad = F.when(_any(whole, CADENCE, STORED, SETUP), F.array(whole)).otherwise(F.array().cast("array<string>"))
    told = {
        "application": F.filter(F.concat(two, short), application),
        "creative": F.filter("s", lambda x: x.rlike(ascii_bounds(CREATIVE))),
        "fact": F.filter(F.concat("s", broad), user_fact),
        "milestone": F.filter("s", milestone),
        "pending": F.transform(F.flatten(F.transform("s", pending)), lambda a: F.concat(F.lit("Pending task: "), a)),
        "event": F.filter("s", event),
        "preference": F.array_compact(F.transform("s", preference)),
    }
    by_turn = rows.select("conv_id", F.struct("turn", *[F.filter(c, lambda x: slug(x) != "").alias(k) for k, c in told.items()]).alias("t"))
    session = by_turn.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    session = session.select("conv_id", *[F.flatten(F.col(f"t.{k}")).alias(k) for k in MOST])
    stored: list[str] = []
    for kind, most in MOST.items():
        before = F.concat(*[F.transform(F.col(f"_{k}"), _same) for k in stored], F.array().cast("array<string>"))
        names = F.transform(kind, _same)
        first = F.filter(kind, lambda x, i: (F.array_position(names, _same(x)) == i + 1) & ~F.array_contains(before, _same(x)))  # noqa: B023
        session = session.withColumn(f"_{kind}", F.slice(first, 1, most))
        stored.append(kind)
    every = F.concat(*[F.transform(F.col(f"_{k}"), lambda x: F.struct(F.lit(k).alias("kind"), x.alias("fact"))) for k in MOST])  # noqa: B023
    return session.select("conv_id", F.posexplode(every).alias("pos", "f")).select("conv_id", "pos", "f.*")


def key_words(text: Column, most: int) -> Column:
    """The first words of three letters or more that a key is made of."""
    found = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9'-]*"), F.lit(0)), lambda t: F.regexp_replace(t, "^['-]+|['-]+$", ""))
    return F.slice(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(KEY_SKIP)), 1, most)


def enriched(facts: DataFrame, role: Column | None = None) -> DataFrame:
    """``facts`` (with fact) with claim_key and claim_status, and for facts of a current state state_key, state_kind, state_subject and state_value.

    What an assistant says is a state only if it speaks of the user; a fact without key words has no keys.
    """
    fact, role = F.col("fact"), role if role is not None else F.lit("user")
    words, subject = key_words(fact, KEY_WORDS), key_words(F.try_element_at(F.split(F.trim(fact), r"[\n.!?]+"), F.lit(1)), SUBJECT_WORDS)
    claim = F.when(F.size(words) > 0, metadata_key(F.concat(F.lit("claim.user."), F.array_join(words, "."))))
    kind = functools.reduce(lambda rest, k: F.when(fact.rlike(ascii_bounds(k[1])), k[0]).otherwise(rest), reversed(STATE_KINDS), F.lit("current_state"))
    is_state = fact.rlike(ascii_bounds(STATE)) & (F.size(subject) > 0) & ((role != "assistant") | F.lower(fact).contains("user"))
    one_line = F.trim(F.regexp_replace(fact, r"\s+", " "))
    value = F.when(F.length(one_line) > VALUE, F.concat(F.substring(one_line, 1, VALUE), F.lit("..."))).otherwise(one_line)
    return facts.withColumns(
        {
            "claim_key": claim,
            "claim_status": F.when(claim.isNotNull(), "asserted"),
            "state_key": F.when(is_state, metadata_key(F.concat_ws(".", F.lit("state"), kind, F.array_join(subject, ".")))),
            "state_kind": F.when(is_state, kind),
            "state_subject": F.when(is_state, F.array_join(subject, " ")),
            "state_value": F.when(is_state, value),
        }
    )


# What facts are tagged by, and the characters of a text that are read for tags.
READ_FOR_TAGS = 4096
WEEKDAY = r"(?i)\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
RELATIVE = r"(?i)\b(?:today|tomorrow|tonight|this morning|this afternoon|this evening|this weekend|next weekend|next week|next month|coming week|next\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|this\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday)|coming\s+(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday))\b"
CLOCK = r"(?i)\b\d{1,2}(?::\d{2})?\s?(?:am|pm)\b|\b\d{1,2}:\d{2}\b"
MONEY = r"[\$£€]\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?"
UNIT_NUMBER = r"(?i)\b(\d{1,6}(?:\.\d+)?)\s+(minutes?|mins?|hours?|hrs?|seconds?|secs?|days?|weeks?|months?|years?|km|kilometres?|miles?|metres?|meters?|kg|kilograms?|pounds?|lbs?|grams?|percent|%|kbps|mbps|gbps|tbps|kb/s|mb/s|gb/s|tb/s)\b"
PROPER = r"\b[A-Z][a-zA-Z]+\b"
ERRAND = r"(?i)\b(?:pick\s+up|drop\s+off|return|exchange|collect|book|schedule|renew|cancel|follow\s+up)\b"
MEDICAL = r"(?i)\b(?:appointment|check-?up|consultation|follow-?up|doctor|gp|dentist|dermatologist|orthodontist|hygienist|therapist|physio(?:therapist)?|optometrist|ophthalmologist|paediatrician|pediatrician|gynaecologist|gynecologist|cardiologist|neurologist|oncologist|surgeon|vet|veterinarian|clinic|hospital|prescription)\b"
HAPPENING = r"(?i)\b(?:workshop|conference|concert|gig|show|screening|play|musical|exhibition|festival|meetup|class|course|webinar|lecture|seminar|tournament)\b"
ENTERTAINMENT = r"(?i)\b(?:film|movie|show|series|book|novel|game|podcast|cinema)\b"
APPOINTMENT = r"(?i)\b(?:appointment|check-?up|consultation|follow-?up|therapy session|scan|surgery|dentist|doctor|gp|dermatologist|orthodontist|hygienist|therapist|counsellor|counselor|psychiatrist|psychologist|physio(?:therapist)?|optometrist|ophthalmologist|paediatrician|pediatrician|gynaecologist|gynecologist|cardiologist|neurologist|oncologist|surgeon|vet|veterinarian)\b"
HEALER = r"(?i)\b(?:gp|doctor|dentist|dermatologist|orthodontist|hygienist|therapist|counsellor|counselor|psychiatrist|psychologist|physio(?:therapist)?|optometrist|ophthalmologist|paediatrician|pediatrician|gynaecologist|gynecologist|cardiologist|neurologist|oncologist|surgeon|vet|veterinarian|clinic|hospital|prescription)\b"
RECOMMENDED = r"(?i)\b(?:recommend|suggest|looking for|look for|what should i|which should i|where should i stay|what to watch|what to read|what to serve)\b"
TAG_SKIP = "the this that these those when where what who why how observed date mon tue wed thu fri sat sun user assistant".split()


def fact_tags(text: Column) -> Column:
    """Sorted distinct tags of the first READ_FOR_TAGS characters of a text: dates with their weekdays and months, weekdays, relative days, clock times, money, amounts
    with and without units, names, errands, and words of health, events and entertainment with the kinds they stand for."""
    body = F.substring(F.coalesce(text, F.lit("")), 1, READ_FOR_TAGS)
    every = lambda p, g=0: F.regexp_extract_all(body, F.lit(ascii_bounds(p)), F.lit(g))
    low = lambda p: F.transform(every(p), lambda x: F.lower(x))
    days = F.filter(F.transform(every(DATE), lambda x: F.try_to_date(F.replace(x, F.lit("/"), F.lit("-")), "yyyy-MM-dd")), lambda x: x.isNotNull())
    named = F.flatten(F.transform(days, lambda x: F.array(F.date_format(x, "EEEE"), F.date_format(x, "MMMM"))))
    units = F.zip_with(every(UNIT_NUMBER, 1), every(UNIT_NUMBER, 2), lambda n, u: F.concat_ws(" ", n, u))
    names = F.filter(every(PROPER), lambda x: (F.length(x) >= 3) & ~F.lower(x).isin(TAG_SKIP))
    mark = lambda test, *tags: F.when(test, F.array(*[F.lit(t) for t in tags])).otherwise(F.array().cast("array<string>"))
    kinds = [
        mark(body.rlike(ascii_bounds(PENDING)) | body.rlike(ascii_bounds(ERRAND)), "pending", "task"), mark(body.rlike(ascii_bounds(APPOINTMENT)), "appointment"), mark(body.rlike(ascii_bounds(HEALER)), "medical"),
        mark(body.rlike(ascii_bounds(EVENT)), "event"), mark(body.rlike(ascii_bounds(RECOMMENDED)), "recommendation"), mark(body.rlike(ascii_bounds(ENTERTAINMENT)), "entertainment"),
    ]
    found = F.concat(every(DATE), named, F.transform(every(WEEKDAY), lambda x: F.initcap(x)), low(RELATIVE), low(CLOCK), every(MONEY), units, every(NUMBER), names, low(ERRAND), low(MEDICAL), low(HAPPENING), low(ENTERTAINMENT), *kinds)
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")))
