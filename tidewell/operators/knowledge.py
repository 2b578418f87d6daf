"""Documents of the knowledge base: type, title, frontmatter, chunks, lint and duplicates."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import jaccard, strip_html, token_estimate, trigrams
from ..session import cut


def content_type(path: Column, text: Column) -> Column:
    """By extension; else by what the text begins with."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return (
        F.when(ext.isin("md", "markdown"), "text/markdown")
        .when(ext.isin("html", "htm"), "text/html")
        .when((ext == "pdf") | text.startswith("%PDF"), "application/pdf")
        .when(ext == "json", "application/json")
        .when(F.lower(F.substring(text, 1, 400)).rlike(r"<(!doctype html|html)\b"), "text/html")
        .otherwise("text/plain")
    )


def title(text: Column, path: Column) -> Column:
    """The first level-one heading, else the first line that is not blank (120 characters), else the file's name."""
    heading = F.trim(F.regexp_extract(text, r"(?m)^# +(.+)$", 1))
    line = F.trim(F.substring(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*(\S.*)$", 1)), 1, 120))
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[A-Za-z0-9]+$", "")
    return F.when(heading != "", heading).when(line != "", line).otherwise(name)


def looks_like_markdown(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?m)^(#{1,6} |> |[-*+] |[0-9]+\. )"), F.lit(False))


def frontmatter(text: Column) -> Column:
    """Map of the keys in a block fenced by --- lines at the start, the last of repeated keys; null without a closing fence."""
    block = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z_]+:"))
    unquote = lambda v: F.regexp_replace(F.trim(v), r"^([\"'])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^([A-Za-z_]+):", 1), unquote(F.regexp_extract(x, r"^[A-Za-z_]+:(.*)$", 1))))
    keys = F.transform(pairs, lambda p: p["col1"])
    last = F.filter(pairs, lambda p, i: F.array_position(F.reverse(keys), p["col1"]) == F.size(keys) - i)
    return F.when(text.rlike(r"(?s)\A---\n.*?\n---(?:\n|\z)"), F.map_from_entries(last))


def windows(rows: DataFrame, key: str, text: str, size: int = 2048, stride: int = 1792) -> DataFrame:
    """(key, ordinal, chunk): overlapping windows that cover each text; the last one ends it."""
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(stride)))).cast("int")
    chunk = lambda i: F.struct(i.alias("ordinal"), F.substring(F.col(text), i * stride + 1, F.lit(size)).alias("chunk"))
    return rows.where(n > 0).select(key, F.inline(F.transform(F.sequence(F.lit(0), last), chunk)))


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, section): texts split before each heading line; blank sections are left out."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^#{1,6} )"), lambda s: F.trim(s) != "")
    return rows.select(key, F.posexplode(parts).alias("ordinal", "section"))


def lint(rows: DataFrame, stub: int = 200) -> DataFrame:
    """(path, issue) of rows (path, title, body): missing title, empty body, stub, no links, broken link, duplicate title."""
    words = F.size(F.regexp_extract_all("body", F.lit(r"\S+"), F.lit(0)))
    own = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("title", F.lit(""))) == "", "missing_field"),
            F.when(words == 0, "empty_body"),
            F.when((words > 0) & (words < stub), "stub"),
            F.when(~F.coalesce(F.col("body").contains("[["), F.lit(False)), "zero_links"),
        )
    )
    alone = rows.select("path", F.explode(own).alias("issue"))
    links = rows.select("path", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\[\[([^\]\[|]+)"), F.lit(1)))).alias("target"))
    broken = links.join(rows.select(F.col("path").alias("target")), "target", "left_anti").select("path", F.lit("broken_link").alias("issue")).distinct()
    key = F.lower(F.trim("title"))
    twice = rows.where(key != "").groupBy(key.alias("t")).agg(F.count("*").alias("n")).where("n > 1")
    doubled = rows.join(twice.select("t"), key == F.col("t"), "left_semi").select("path", F.lit("duplicate_title").alias("issue"))
    return functools.reduce(DataFrame.union, [alone, broken, doubled])


#: Words of 64 bits that stand for a title's grams.
SLOTS = 8


def _parts(total: Column, least: float) -> Column:
    """Into how many parts the grams of two sets are dealt, by the sum of their sizes: more parts than alike sets have grams
    that only one of them holds. Large numbers are rounded up, by an eighth at most, so that a set is dealt few times."""
    more = F.floor(total * ((1 - least) / (1 + least)) + 1e-3) + 1
    step = F.greatest(F.lit(1), F.pow(F.lit(2), F.floor(F.log2(more)) - 3).cast("int"))
    return (F.ceil(more / step) * step).cast("int")


def _bits(places: str, slot: int) -> Column:
    """One word of the bits that stand for hashed grams, of the places of all their bits."""
    own = lambda p: (F.shiftright(p, 6) == slot).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(F.call_function("shiftleft", own(p), p % 64)))


def _signatures(titles: DataFrame, least: float, grams_of: Callable[[Column], Column]) -> DataFrame:
    """(key, m, k, n, bits): for each number m of parts that a title may share with one alike, the contents of each part, hashed; empty parts, too."""
    parts, bits = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions")), [f"bits_{i}" for i in range(SLOTS)]
    own = titles.repartition(parts, "k").select("k", F.transform(grams_of(F.col("t")), lambda w: F.xxhash64(w)).alias("h"))  # in tasks by number, as each title makes many rows
    own = own.select("k", "h", F.transform("h", lambda w: F.pmod(w, F.lit(64 * SLOTS)).cast("int")).alias("places"))
    n = F.coalesce(F.size("h"), F.lit(0))  # never null, else grams are made once more to see whether it is
    partners = F.sequence((n + F.ceil(n * least - 1e-3)).cast("int"), (n + F.floor(n / F.lit(least) + 1e-3)).cast("int"))  # sums of sizes
    counts = F.when(n > 0, F.array_distinct(F.transform(partners, lambda s: _parts(s, least))))
    wide = own.select("k", n.alias("n"), *[_bits("places", i).alias(b) for i, b in enumerate(bits)], "h", F.explode_outer(counts).alias("m"))  # outer for the same reason
    # one row without a gram for each part, then the grams
    dealt = wide.select("k", "n", *bits, "m", F.posexplode(F.concat(F.sequence(F.lit(0), F.col("m") - 1).cast("array<long>"), "h")).alias("at", "w"))
    mark = F.col("at") < F.col("m")
    part = F.when(mark, F.col("at").cast("long")).otherwise(F.pmod("w", F.col("m").cast("long")))
    held = F.bit_xor(F.when(mark, F.lit(0).cast("long")).otherwise(F.col("w")))
    each = dealt.groupBy("k", "n", *bits, "m", part.alias("part")).agg(held.alias("held"))
    return each.select(F.xxhash64("m", "part", "held").alias("key"), "m", "k", "n", *bits)


def _alike(titles: DataFrame, least: float, grams_of: Callable[[Column], Column]) -> DataFrame:
    """Pairs (a, b, similarity) of stored titles (k, id, t), k and t being distinct, a and b their ids.

    The grams are dealt, by their hash, into more parts than two titles that are alike may have grams that only one of them holds; so
    one part at least is the same in both, and titles meet by what their parts hold. How many meet by chance hardly depends on how
    frequent single grams are. Only keys, sizes and bits of hashed grams go through the candidates' join; bits that one has and the other lacks
    are grams that they do not share, so that most candidates end there, none of them alike. The texts come to the distinct pairs that are left.
    """
    signed = _signatures(titles, least, grams_of)
    x, y = (signed.select("key", "m", *[F.col(c).alias(f"{c}_{s}") for c in signed.columns[2:]]) for s in "ab")
    lacks = lambda s, t: functools.reduce(operator.add, [F.bit_count(F.col(f"bits_{i}_{s}").bitwiseAND(F.bitwise_not(F.col(f"bits_{i}_{t}")))) for i in range(SLOTS)])
    total = F.col("n_a") + F.col("n_b")
    most = F.least(F.col("n_a") - lacks("a", "b"), F.col("n_b") - lacks("b", "a"))
    enough = most >= least / (1 + least) * total - 1e-9
    met = x.join(y.hint("merge"), ["key", "m"]).where((F.col("k_a") < F.col("k_b")) & enough & (F.col("m") == _parts(total, least)))
    parts = int(titles.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as a pair is small and its sets are not
    pairs = met.select("k_a", "k_b").repartition(parts, "k_a", "k_b").distinct()
    for side in "ab":
        pairs = pairs.join(titles.select(*[F.col(c).alias(f"{c}_{side}") for c in ("k", "id", "t")]), f"k_{side}")
    least_id, greatest_id = F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")
    sets = pairs.repartition(parts, "k_a", "k_b").select("k_a", "k_b", least_id, greatest_id, grams_of(F.col("t_a")).alias("g_a"), grams_of(F.col("t_b")).alias("g_b"))
    found = sets.where("a < b").groupBy("k_a", "k_b", "a", "b").agg(F.max(F.round(jaccard(F.col("g_a"), F.col("g_b")), 9)).alias("similarity"))  # a group is one pair, judged where it was sent
    return found.where(F.col("similarity") >= least).select("a", "b", "similarity")


def title_pairs(rows: DataFrame, key: str, text: str, least: float = 0.85, grams_of: Callable[[Column], Column] = trigrams) -> DataFrame:
    """Pairs (a, b, similarity) of distinct titles by trigram Jaccard similarity, each title under its least key."""
    each = rows.groupBy(F.col(text).alias("t")).agg(F.min(key).alias("id"))
    return _alike(cut(each.select(F.monotonically_increasing_id().alias("k"), "id", "t")), least, grams_of)


def title_key(title: Column) -> Column:
    """Lower case, runs of other than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def plain_trigrams(text: Column) -> Column:
    """Distinct 3-grams of a text as it stands; a shorter text is one."""
    at = lambda c, i: F.coalesce(F.get(c, i), F.lit(""))
    every = lambda c: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(c) - 3)), lambda i: F.concat(at(c, i), at(c, i + 1), at(c, i + 2)))
    chars = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))  # once a text, as a substring counts characters from its start
    return F.when(text == "", F.array().cast("array<string>")).when(text != "", F.array_distinct(F.transform(F.array(chars), every)[0]))


def keep_first(rows: DataFrame, key: str, title: str, body: str, least: float = 0.85) -> DataFrame:
    """(id, keep, score, reason): one row for each row of ``rows``, by distinct whole-number ids: each stays (keep is its own id) unless an earlier one that stays has
    the same body (trimmed), the same title key, or a title with ``least`` trigram similarity; then keep is the first such one.

    The rule is one after the other; here rounds decide all rows at once whose earlier rows are decided: a row is kept if the first row
    that is alike and not yet merged is itself, and merged if that one is kept. Equal bodies and titles are groups, looked up by the least ids in them
    (which combine before the shuffle), only similar titles are pairs of distinct titles; texts go no further than to these numbers. Null titles and bodies are empty; empty titles are like none.
    """
    own = cut(rows.select(F.col(key).cast("long").alias("id"), title_key(F.col(title)).alias("t"), F.unhex(F.sha2(F.trim(F.coalesce(body, F.lit(""))), 256)).alias("h")))
    names = cut(own.where("t <> ''").groupBy("t").agg(F.min("id").alias("id")).select(F.col("id").alias("k"), "id", "t"))
    bodies = own.groupBy("h").agg(F.min("id").alias("same"))
    found = own.join(bodies, "h").join(names.select("t", F.col("id").alias("named")), "t", "left")
    state = cut(found.select("id", "same", "named", F.lit(0).alias("status"), F.lit(None).cast("long").alias("keep")))
    pairs = _alike(names, least, plain_trigrams)
    near = cut(pairs.select(F.col("a").alias("named"), F.col("b").alias("other"), "similarity").union(pairs.select("b", "a", "similarity")))
    while not state.where("status = 0").isEmpty():
        live = state.where("status < 2")
        # of a group the first row that is not merged, and the first that is kept
        firsts = lambda by: live.groupBy(by).agg(F.min("id").alias(f"first_{by}"), F.min(F.when(F.col("status") == 1, F.col("id"))).alias(f"kept_{by}"))  # noqa: E731, B023
        named = firsts("named").where("named is not null")
        beside = near.join(named.withColumnRenamed("named", "other"), "other").groupBy("named").agg(F.min("first_named").alias("first_near"), F.min("kept_named").alias("kept_near"))
        open_ = state.where("status = 0").join(firsts("same"), "same").join(named, "named", "left").join(beside, "named", "left")
        first, kept = (F.least(*[F.col(f"{x}_{by}") for by in ("same", "named", "near")]) for x in ("first", "kept"))
        now = F.when(first == F.col("id"), 1).when(first == kept, 2).otherwise(0)
        decided = open_.select("id", "same", "named", now.alias("status"), F.when(now > 0, first).alias("keep"))
        state = cut(state.where("status > 0").union(decided))
    kept = state.select(F.col("id").alias("keep"), F.col("same").alias("kept_same"), F.col("named").alias("kept_named"))
    both = state.drop("status").join(kept, "keep").join(near.withColumnRenamed("other", "kept_named"), ["named", "kept_named"], "left")
    same, equal = F.col("same") == F.col("kept_same"), F.coalesce(F.col("named") == F.col("kept_named"), F.lit(False))
    merged = F.col("id") != F.col("keep")
    score = F.when(merged, F.when(same | equal, 1.0).otherwise(F.col("similarity")))
    reason = F.when(merged, F.when(same & (equal | F.col("similarity").isNotNull()), "both").when(same, "content_hash").otherwise("title"))
    return both.select("id", "keep", score.alias("score"), reason.alias("reason"))


def isolate(text: Column, tag: str) -> Column:
    """Text wrapped in an element whose closing tag inside is escaped."""
    return F.concat(F.lit(f"<{tag}>\n"), F.regexp_replace(text, f"(?i)</{tag}>", f"&lt;/{tag}&gt;"), F.lit(f"\n</{tag}>"))


def session_date(meta: Column) -> Column:
    """session_date, else observed_on, else modified, of a frontmatter map."""
    return F.coalesce(*[F.try_element_at(meta, F.lit(k)) for k in ("session_date", "observed_on", "modified")])


def render(hits: DataFrame, k: int) -> DataFrame:
    """(query_no, passages): the best ``k`` hits of each question as numbered passages with date, session and role, whole."""
    line = F.concat(F.col("rank"), F.lit(". ["), F.coalesce(F.col("modified").cast("string"), F.lit("undated")), F.lit("] ("), "session_id", F.lit(", "), "source_role", F.lit(") "), "text")
    lines = hits.where(F.col("rank") <= k).groupBy("query_no").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))  # k lines a question
    return lines.select("query_no", F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("passages"))


def ingest(pages: DataFrame) -> DataFrame:
    """(page_id, kind, text, checksum, tokens) of pages (page_id, url, html): the type, the text that it gives, its hash and about how many tokens it has."""
    kind = content_type(F.col("url"), F.col("html"))
    rows = pages.select("page_id", kind.alias("kind"), F.when(kind == "text/html", strip_html(F.col("html"))).otherwise(F.coalesce("html", F.lit(""))).alias("text"))
    return rows.select("page_id", "kind", "text", F.sha2("text", 256).alias("checksum"), token_estimate(F.col("text")).alias("tokens"))


def note_fields(text: Column, names: list[str]) -> Column:
    """A struct of the fields ``names``, tags and body of a text that begins with a block between lines of '---'; without a closing line the whole text is the body.

    A field's last non-empty value counts, one pair of quotes goes. Tags stand behind their key, set apart by commas, or as '- ' lines below it; other lists are not read.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    fence = F.transform(lines, lambda x, i: (F.trim(x) == "---") & (i > 0))
    close = F.array_position(fence, True).cast("int")
    opened = (F.trim(lines[0]) == "---") & (close > 0)
    block = F.when(opened, F.slice(lines, 2, F.greatest(close - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    key = lambda x: F.regexp_extract(x, r"^\s*([A-Za-z_]+)\s*:", 1)
    value = lambda x: F.regexp_replace(F.trim(F.regexp_extract(x, r"^\s*[A-Za-z_]+\s*:(.*)$", 1)), r"^([\"'])(.*)\1$", "$2")
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("tags"))

    def read(a: Column, x: Column) -> Column:
        item = (a["at"] != "") & F.trim(x).startswith("- ")
        own = F.when(item & (a["at"] == "tags"), F.array(F.trim(F.regexp_replace(F.trim(x), "^- ", "")))).when(~item & (key(x) == "tags"), F.filter(F.transform(F.split(value(x), ","), lambda t: F.trim(t)), lambda t: t != ""))
        at = F.when(item, a["at"]).when(value(x) == "", key(x)).otherwise("")
        return F.struct(at.alias("at"), F.concat(a["tags"], F.coalesce(own, F.array().cast("array<string>"))).alias("tags"))

    def field(n: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(F.transform(F.filter(block, lambda x: key(x) == n), value), lambda v: v != ""), F.lit(-1)), F.lit(""))

    rest = F.when(opened, F.regexp_replace(F.array_join(F.slice(lines, close + 1, F.size(lines)), "\n"), r"^\s+|\s+$", "")).otherwise(F.coalesce(text, F.lit("")))
    return F.struct(*[field(n).alias(n) for n in names], F.aggregate(block, start, read)["tags"].alias("tags"), rest.alias("body"))


def lint_sources(articles: DataFrame, files: DataFrame) -> DataFrame:
    """(path, issue, about) of articles (path, sources, modified): 'stale_source' for each source among ``files`` (path, modified) that changed after an article of the wiki,
    and 'orphan_draft' for drafts without a wiki article of their name. Unknown and empty sources, and files or articles without a date, say nothing."""
    wiki = articles.where(F.col("path").startswith("wiki/"))
    used = wiki.select("path", F.col("modified").alias("_own"), F.explode(F.transform("sources", lambda s: F.trim(s))).alias("about")).where("about <> ''")
    stale = used.join(files.select(F.col("path").alias("about"), F.col("modified").alias("_then")), "about").where(F.col("_then") > F.col("_own")).select("path", F.lit("stale_source").alias("issue"), "about")
    name = F.regexp_extract("path", r"^(?:wiki|drafts)/(.*?)(?:\.md)?$", 1)
    drafts = articles.where(F.col("path").startswith("drafts/")).select("path", name.alias("about"))
    orphans = drafts.join(wiki.select(name.alias("about")).distinct(), "about", "left_anti").select("path", F.lit("orphan_draft").alias("issue"), "about")
    return stale.unionByName(orphans)
