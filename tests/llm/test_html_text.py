from tidewell.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and you will like it.</div>
<article><h1>Head &amp; line</h1><p><b>One  two&nbsp;three.<br><p>x</p><div class="ad">Buy now</div><p>Fin &eacute; &#8364;<!-- no --> <a href="#">link</a></p>
<footer>by me</footer><section id="comments"><p>First!</p></section></article><aside><p>The most read of the week and of the month</p></aside><form><p>Sign up</p></form><footer>(c)</footer>"""


def test_article_only():
    assert H.main_text(PAGE) == "Head & line\nOne two three.\nx\nFin é € link"


def test_rules_without_article():
    long = "This is the text of a page that has been written by the people who were there and it is as long as it must be, so that the rules can tell. " * 2
    page = f"<div><a href=1>one</a> <a href=2>two</a> <a href=3>three</a></div><h2>Title</h2><p>{long}</p><p>Short.</p><p>{long}</p><div>xq zq wq {'qq ' * 60}</div><p>End.</p>"
    text = " ".join(long.split())
    assert H.main_text(page) == f"Title\n{text}\nShort.\n{text}"


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "<article>" + "<p>a" * 3000), (5, "<p"), (6, "<article>a < b & c</article>"), (6, "<article>a < b & c</article>")]
    got = H.extract_main_text(spark.createDataFrame([(i, h, "t") for i, h in rows], "page_id long, html string, text string"))
    found = sorted((r.page_id, r.text, r.n_chars) for r in got.collect())
    assert [f[0] for f in found] == [1, 2, 3, 4, 5, 6, 6]
    assert found[0][1:] == ("", 0) and found[1][1:] == ("", 0)
    assert found[3][1] == "\n".join("a" * 3000) and found[5][1] == "a < b & c"
    assert H.extract_main_text(spark.createDataFrame([], "page_id long, html string")).count() == 0
