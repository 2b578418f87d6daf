from tidewell.llm import url_filters as U

URLS = [
    (1, "https://www.Example.com/en/a?x"), (2, "http://example.com/en/b"), (3, "http://blog.example.com/en/"), (4, "http://a.net/es/1#t"), (5, "http://net/fr/"),
    (6, "no scheme"), (7, None), (8, "http://example.com"), (9, "http://notexample.com/en/"), (10, "x://a.b.www.example.com/en/z"), (11, "http://EXAMPLE.net/de/"),
    (11, "http://EXAMPLE.net/de/"), (12, ""), (13, "http://com/"), (14, "http://Ä.COM/en/\n"),
]


def brute(url, rules=U.RULES):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "old") for i, u in URLS], "page_id long, url string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.url_filter(pages, U.rules_frame(spark)).collect())
    assert got == sorted((i, *brute(u)) for i, u in URLS)


def test_nested_rules_of_one_host(spark):
    rules = [("a.com", "/", "block"), ("b.a.com", "/x/", "allow"), ("b.a.com", "/", "allow"), ("a.com", "/x/y/", "block"), ("z", "/", "block"), ("z", "/", "allow")]
    urls = ["http://b.a.com/x/y/z", "http://c.b.a.com/x/", "http://a.com/x/", "http://ab.com/", "http://z/", "http://y.z/q", "http://b.a.com/"]
    got = U.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    once = [r for r in rules if r != ("z", "/", "allow")]  # of repeated rules block wins
    assert sorted((r.page_id, r.rule, r.verdict) for r in got.collect()) == [(i, *brute(u, once)[2:]) for i, u in enumerate(urls)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(none, U.rules_frame(spark)).count() == 0
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    one = U.url_filter(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string"), rules, default="block").first()
    assert (one.rule, one.verdict) == (None, "block")
