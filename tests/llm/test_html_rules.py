"""The two passes of block rules against a plain reading of them, block by block."""

import random

from tidewell.llm import html_text as H

PROSE = "the cat and the dog are in the house and it is not so that they will be there for you "
PLAIN = "zorp quex blit vrak mondo pliw tark "


def brute(found):
    main_there = any(m and not b for _, b, m, _, _ in found)
    free = [not b and not m and not main_there and links <= H.MAX_LINKS for _, b, m, _, links in found]
    long_free = [t for (t, *_), f in zip(found, free) if f and H._size(t) >= H.SHORT]
    density = lambda t: sum(w in H.STOP_WORDS for w in H._WORD.findall(t.lower())) / max(1, len(H._WORD.findall(t.lower())))
    known = any(density(t) >= H.DENSE for t in long_free) and sum(H._size(t) * density(t) for t in long_free) >= H.SPARSE * sum(H._size(t) for t in long_free)

    def first(i):
        text, bad, main, heading, links = found[i]
        if bad or (main_there and not main):
            return "bad"
        if main:
            return "good"
        if links > H.MAX_LINKS:
            return "bad"
        size = len(text) if known else H._size(text)
        if size < H.SHORT:
            return "heading" if heading else "bad" if links else "short"
        if not known:
            return "good" if size > H.LONG else "near"
        d = density(text) if H._size(text) >= H.SHORT else 0.0
        if d >= H.DENSE:
            return "good" if size > H.LONG else "near"
        return "near" if d >= H.SPARSE else "bad"

    labels = [first(i) for i in range(len(found))]
    if not any(x == "good" for x in labels):
        labels = [{"near": "good"}.get(x, x) for x in labels]

    def neighbour(i, step):
        i += step
        while 0 <= i < len(labels):
            if labels[i] in ("good", "bad"):
                return labels[i]
            i += step
        return "bad"

    out = []
    for i, (text, *_) in enumerate(found):
        sides = [neighbour(i, -1), neighbour(i, 1)]
        beside_near = "near" in labels[max(0, i - 1) : i + 2]
        kept = {
            "good": True, "bad": False, "near": "good" in sides, "heading": sides[1] == "good",
            "short": sides == ["good", "good"] or ("good" in sides and beside_near),
        }[labels[i]]
        out.append((text, kept))
    return out


def test_random_pages():
    r = random.Random(7)
    seen = set()
    for n in range(3000):
        prose = PROSE if n % 3 else PLAIN
        main = n % 5 == 0
        found = []
        for _ in range(r.randrange(12)):
            text = (prose if r.random() < 0.7 else PLAIN) * r.choice([0, 1, 1, 3]) + r.choice(["Menu", "Read on", "x"])
            found.append((text, r.random() < 0.15, main and r.random() < 0.6, r.random() < 0.2, r.choice([0.0, 0.0, 0.0, 0.2, 0.5, 1.0])))
        want = brute(found)
        assert H.decided(found) == want
        seen.add(tuple(k for _, k in want))
    assert len(seen) > 100


def test_pages_without_an_article():
    body = f"<p>{PROSE * 4}</p><p>Short one.</p><p>{PROSE * 4}</p>"
    page = f"<html><body><div class='nav'><a href='/'>Home</a> <a href='/x'>More</a></div><h2>Title</h2>{body}<div><a href='/a'>{PROSE}</a></div></body></html>"
    text = H.main_text(page)
    assert text.split("\n") == ["Title", (PROSE * 4).strip(), "Short one.", (PROSE * 4).strip()]


PARAGRAPH = (PROSE * 2).strip()[:162]


def test_pages_of_middling_paragraphs():
    """No block is long; the page's own density lets them stand, and the heading with them."""
    for n in (1, 2, 6):
        for open_, close in (("<body>", "</body>"), ("<div class='post'>", "</div>")):
            text = H.main_text(f"{open_}<h1>News</h1>{f'<p>{PARAGRAPH}</p>' * n}{close}")
            assert text.split("\n") == ["News", *[PARAGRAPH] * n]
    plain = (PLAIN * 4).strip()
    assert H.main_text(f"<body><p>{plain}</p><p><a href=1>{plain}</a></p></body>") == plain


def test_inside_an_article():
    """Links, and class words that are not all of a name or stand on a paragraph, drop nothing; adverts, comments and boxes go."""
    kept = ["<p>Start.</p>", "<p><a href=1>One link</a></p>", "<ul><li><a href=2>Item</a></li></ul>", "<section class='related-work'><p>Earlier work.</p></section>", "<p class='legal'>By law.</p>", "<p class=notice>Note this.</p>", "<p>End.</p>"]
    gone = ["<div class='related-posts'><p>More to read</p></div>", "<div class='ad-box'>Buy</div>", "<p class='ad'>Buy</p>", "<section id='comments'><p>First!</p></section>", "<div class='cookie-notice'>We use cookies</div>", "<ul class='share-links'><li>Share</li></ul>", "<form><p>Sign up</p></form>", "<p hidden>x</p>"]
    mixed = "".join(k + g for k, g in zip(kept, [*gone[: len(kept)]])) + gone[-1]
    text = H.main_text(f"<html><body><nav>Menu</nav><article>{mixed}</article><footer>f</footer></body></html>")
    assert text.split("\n") == ["Start.", "One link", "Item", "Earlier work.", "By law.", "Note this.", "End."]
    assert H.main_text("<article><p><a href=1>Only</a></p></article>") == "Only"


def plain_text(page):
    """The whole extraction by other means: a DOM of Python's parser, walked block by block, for well-formed pages."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.path, self.blocks, self.text = [], [], ""

        def end(self):
            text = " ".join(self.text.split())
            if text:
                names = [t for t, _ in self.at]
                bad = any(t in ("nav", "footer", "aside", "form", "script", "style", "head") or c in ("ad", "comments") or (t == "header" and "article" not in names[:i]) for i, (t, c) in enumerate(self.at))
                self.blocks.append((text, bad, "article" in names))
            self.text = ""

        def handle_starttag(self, tag, attrs):
            if tag in ("b", "i", "a", "em"):
                return
            if tag == "br":
                self.text += " "
                return
            self.at = list(self.path)
            self.end()
            self.path.append((tag, dict(attrs).get("class") or dict(attrs).get("id") or ""))

        def handle_endtag(self, tag):
            if tag in ("b", "i", "a", "em", "br"):
                return
            self.at = list(self.path)
            self.end()
            self.path.pop()

        def handle_data(self, data):
            if not self.path or self.path[-1][0] not in ("script", "style", "title"):
                self.text += data

    r = Reader()
    r.feed(page)
    r.at = []
    r.end()
    return "\n".join(t for t, bad, main in r.blocks if main and not bad)


def test_whole_pages_against_another_reading():
    r = random.Random(11)
    words = ["and", "caf&eacute;", "a &lt; b", "  two  ", "<b>bold</b>", "x<br>y", "&#8364;5", "z&nbsp;z", "end."]
    for _ in range(300):
        some = lambda: " ".join(r.choices(words, k=r.randrange(1, 30)))
        part = lambda: r.choice(["<p>{}</p>", "<h2>{}</h2>", "<div><p>{}</p></div>", "<ul><li>{}</li></ul>", "<div class='ad'>{}</div>", "<section id='comments'><p>{}</p></section>", "<header>{}</header>", "<footer>{}</footer>", "<aside>{}</aside>", "<script>var a = 1;</script><p>{}</p>"]).format(some())
        page = f"<html><head><title>t</title><style>p</style></head><body><header><h1>{some()}</h1></header><nav>{some()}</nav>{part() if r.random() < 0.5 else ''}<article>{''.join(part() for _ in range(r.randrange(1, 8)))}<p>last {some()}</p></article><footer>{some()}</footer></body></html>"
        assert H.main_text(page) == plain_text(page)


def test_given_pages_against_another_reading():
    import duckdb

    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        import html as h
        import re

        inner = re.sub(r"(?s)<(script|style).*?</\1>|<!--.*?-->", "", inner)
        inner = re.sub(r'(?s)<div class="ad">.*?</div>|<(footer|aside|form|nav)\b.*?</\1>|<section id="comments">.*?</section>', "\n", inner)
        blocks = re.split(r"</?(?:p|div|h\d|ul|li|section|blockquote|figure|figcaption|table|tr|td)\b[^>]*>", inner)
        text = [" ".join(h.unescape(re.sub(r"<[^>]+>", " " if b.count("<br") else "", re.sub("<br>", " ", b))).split()) for b in blocks]
        assert H.main_text(page) == "\n".join(t for t in text if t)
