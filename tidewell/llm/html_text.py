"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides each block by
itself: boilerplate containers (menus, headers, footers, sidebars, notices, adverts,
forms, comments) are bad, the other blocks of an article or main element are good, and
elsewhere link density, stop-word density and length decide; short blocks and blocks of
middling density or length stay open. Stop words are known of
English, French, German and Spanish; where none of these reaches the densities on a page,
length and link density alone decide. The second pass gives open blocks the labels of
their nearest decided neighbours; on a page without a good block, those of middling
length or density that the page's own density lets stand are good.

Inside an article the class words that make a container bad must be all that its name says
('related-posts', not 'related-work'), and a paragraph, heading or list item is dropped
for adverts, reader comments and hiding only.
"""

from __future__ import annotations

import html as _html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Frequent function words of four languages, for stop-word density.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can could do for from had has have he her his if in into is it its more my no not of on or
    our she so that the their them there they this to up was we were what when which who will with would you your
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur une un vous y été
    aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer es für hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wie wir wird zu zum zur
    al como con de del el ella en entre es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre son su sus también un una y ya""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math canvas object select xmp noembed noframes audio video".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html
    li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul caption""".split()
)
BAD_TAGS = frozenset("nav footer aside form head dialog menu button fieldset".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar".split())
BAD_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies
    consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login comment comments disqus respond replies reply share sharing social related recommended
    widget toolbar pagination pager skip hidden copyright legal disclaimer teaser""".split()
)
GOOD_NAMES = frozenset("content article main post entry story".split())
#: Words beside which a bad word is all that a name says, and bad words that count for a text element of an article too.
NEUTRAL = frozenset("box block section container wrapper wrap list bar button buttons link links posts articles stories area inner outer panel unit slot top bottom left right item items row col form".split())
TEXT_TAGS = frozenset("p li h1 h2 h3 h4 h5 h6 blockquote pre td th dd dt figcaption span em strong b i a".split())
TEXT_NAMES = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo comment comments disqus hidden cookie cookies".split())
#: An open element of the key is closed by a start tag of the values.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table article main section div body aside nav header footer form blockquote".split())

SHORT, LONG, DENSE, SPARSE, MAX_LINKS = 70, 200, 0.32, 0.20, 0.33

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[^\W\d_]+")
#: Characters of scripts that write a word in one or two; each is as long as three.
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")


def _is_bad(name: str, attrs: str, in_main: bool) -> bool:
    if name in BAD_TAGS or (name == "header" and not in_main):
        return True
    if not attrs or name in ("html", "body", "article", "main"):
        return bool(attrs) and name == "article" and _bad_names(attrs, "article", False)
    return _bad_names(attrs, name, in_main) or bool(re.search(r"(?:^|\s)hidden(?:\s|/|=|$)", attrs.lower()))


def _bad_names(attrs: str, tag: str, in_main: bool) -> bool:
    got = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(attrs)}
    if got.get("role", "").lower() in BAD_ROLES or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        return True
    names = [n for k in ("class", "id") for n in got.get(k, "").split()]
    if any(n.lower() in GOOD_NAMES for n in names):
        return False
    for n in names:
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", n)]
        if not parts or parts[0] in ("has", "no", "with", "without", "is"):
            continue
        if in_main:
            words = TEXT_NAMES if tag in TEXT_TAGS else BAD_NAMES
            if words.intersection(parts) and all(x in BAD_NAMES or x in NEUTRAL or x.isdigit() for x in parts):
                return True
        elif BAD_NAMES.intersection(parts):
            return True
    return False


class _Block:
    __slots__ = ("parts", "link", "bad", "main", "heading")

    def __init__(self, bad: bool, main: bool, heading: bool):
        self.parts, self.link, self.bad, self.main, self.heading = [], 0, bad, main, heading


def blocks(page: str) -> list[tuple[str, bool, bool, bool, float]]:
    """(text, bad container, in article or main, heading, link density) of each block with text, in page order."""
    out: list[tuple[str, bool, bool, bool, float]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # name, bad, main, link
    cur = _Block(False, False, False)
    breaks = 0

    def flush() -> None:
        nonlocal cur
        text = " ".join("".join(cur.parts).split())
        if text:
            out.append((text, cur.bad, cur.main, cur.heading, min(1.0, cur.link / len(text))))
        top = stack[-1] if stack else ("", False, False, False)
        cur = _Block(top[1], top[2], any(x[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for x in stack[-2:]))

    def add(chunk: str) -> None:
        nonlocal breaks
        if not chunk:
            return
        chunk = _html.unescape(chunk)
        if not chunk.isspace():
            breaks = 0
            top = stack[-1] if stack else ("", False, False, False)
            if top[1] != cur.bad:  # an inline element of another kind is a block of its own
                flush()
            if top[3]:
                cur.link += len(" ".join(chunk.split()))
        cur.parts.append(chunk)

    def close(names: tuple[str, ...], within: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BLOCK:
                if name in ("article", "main", "section", "div", "body", "html", "nav", "aside", "header", "footer", "form", "table", "ul", "ol"):
                    close((name,))
                else:
                    close((name,), SCOPE)
                flush()
            elif name not in VOID:
                close((name,), BLOCK)
            continue
        if name in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if name == "br":
            breaks += 1
            if breaks > 1:
                flush()
            else:
                cur.parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in BLOCK:
            close(("p",), SCOPE)
            if name in CLOSES:
                close(CLOSES[name], SCOPE - {name})
        top = stack[-1] if stack else ("", False, False, False)
        bad = top[1] or _is_bad(name, m[3], top[2])
        stack.append((name, bad, top[2] or name in ("article", "main") or 'role="main"' in m[3], top[3] or name == "a"))
        if name in BLOCK:
            flush()
            breaks = 0
    flush()
    return out


def _density(text: str) -> float:
    """Share of stop words among the words of ``text``."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def _size(text: str) -> int:
    return len(text) + 2 * len(_WIDE.findall(text))


def labelled(page: str) -> list[tuple[str, bool]]:
    """(text, kept) of each block."""
    return decided(blocks(page))


def decided(found: list[tuple[str, bool, bool, bool, float]]) -> list[tuple[str, bool]]:
    """(text, kept) of each block of blocks(): labels by themselves first, then by the nearest decided neighbours."""
    has_main = any(main and not bad for _, bad, main, _, _ in found)
    open_blocks = [not (bad or main or has_main or links > MAX_LINKS) for _, bad, main, _, links in found]
    density = [_density(text) if x and _size(text) >= SHORT else 0.0 for (text, *_), x in zip(found, open_blocks)]
    weighed = [(_size(text), d) for (text, *_), d, x in zip(found, density, open_blocks) if x and _size(text) >= SHORT]
    # a page of a listed language: its text has the density on the whole, and some block has that of running text
    listed = any(d >= DENSE for _, d in weighed) and sum(n * d for n, d in weighed) >= SPARSE * sum(n for n, _ in weighed)
    first: list[str] = []
    for (text, bad, main, heading, links), d in zip(found, density):
        size = len(text) if listed else _size(text)
        if bad or (has_main and not main) or (links > MAX_LINKS and not main):
            first.append("bad")
        elif main:
            first.append("good")
        elif size < SHORT:
            first.append("heading" if heading else "short" if links == 0 else "bad")
        elif listed:
            first.append(("good" if size > LONG else "near") if d >= DENSE else "near" if d >= SPARSE else "bad")
        else:
            first.append("good" if size > LONG else "near")
    if "good" not in first:
        first = ["good" if x == "near" else x for x in first]
    n = len(found)
    before, after = ["bad"] * n, ["bad"] * n  # the nearest decided label on each side; the page's ends are bad
    for i in range(1, n):
        before[i] = first[i - 1] if first[i - 1] in ("good", "bad") else before[i - 1]
    for i in range(n - 2, -1, -1):
        after[i] = first[i + 1] if first[i + 1] in ("good", "bad") else after[i + 1]
    out = []
    for i, (text, *_) in enumerate(found):
        label = first[i]
        if label == "near":
            kept = "good" in (before[i], after[i])
        elif label == "heading":
            kept = after[i] == "good"
        elif label == "short":
            near = (before[i] == "good") + (after[i] == "good")
            kept = near == 2 or (near == 1 and "near" in first[max(0, i - 1) : i + 2])
        else:
            kept = label == "good"
        out.append((text, kept))
    return out


def main_text(page: str | None) -> str:
    return "\n".join(text for text, kept in labelled(page) if kept) if page else ""


@F.pandas_udf(T.StringType())
def main_text_of(page: pd.Series) -> pd.Series:
    return page.map(main_text)


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add text (the kept blocks, one a line) and n_chars (its code points).

    A null or empty page, or one without a kept block, has an empty text. Columns named
    text or n_chars are replaced.
    """
    return pages.drop("text", "n_chars").withColumn("text", main_text_of(F.coalesce(F.col(html), F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
