import random
import re

from cardweave.llm.urlfilter import filter_urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "/en/x", "allow"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "", "allow"), ("a.net", "/fr/", "block"), ("xn--a", "/", "block")]


def brute(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in raw)
    fit = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def check(spark, urls, ranges=None):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in filter_urls(pages, rules, ranges=ranges).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate(urls)}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    hosts = ["example.com", "WWW.Example.com", "www.example.com", "b.www.example.com", "notexample.com", "example-a.com", "com", "a.net", "b.a.net", "net", "x.org", "", "com:80", "a..com", "é.com"]
    paths = ["", "/", "/en/", "/en/x1", "/en", "/fr/2", "/es/", "/es/3#t", "?q=/en/", "/en/?a://b.net/fr/"]
    urls = [rnd.choice(["http://", "https://", "s3://", "//", ""]) + rnd.choice(hosts) + rnd.choice(paths) for _ in range(600)] + [None, "", "no url", "://x.com/a", "http://a\nb.com/"]
    check(spark, urls)
    check(spark, urls, ranges=40)
    check(spark, ["http://www.example.com/en/1"] * 300, ranges=10)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert filter_urls(pages, rules).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert tuple(filter_urls(one, rules.limit(0)).first()) == (1, "a.com", "/x", None, "allow")


def test_odd_rows(spark):
    """Null ids, repeated rows, ties between rules, extra columns of clashing names, a very long url."""
    urls = [(None, "http://www.example.com/en/x"), (1, "http://a.net/fr/1"), (1, "http://a.net/fr/1"), (2, None), (None, None), (3, "http://b.org/" + "p" * 200_000)]
    pages = spark.createDataFrame([(i, u, "x", "y", "z", "w", "v") for i, u in urls], "page_id long, url string, host string, path string, rule string, verdict string, key string")
    # "a.net" + "/fr/" and "net" + longer path are as long as each other for no url; equal rules count once, allow first.
    rules = spark.createDataFrame([*RULES, ("a.net", "/fr/", "allow"), ("a.net", "/fr/", "block"), (None, "/", "block"), ("", "/", "block"), ("b.org", None, "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, filter_urls(pages, rules, ranges=3).collect()), key=repr)
    want = []
    for i, u in urls:
        host, path, rule, verdict = brute(u, [r for r in RULES if r[:2] != ("a.net", "/fr/")] + [("a.net", "/fr/", "allow"), ("b.org", "", "block")])
        want.append((i, host, path, rule, verdict))
    assert got == sorted(want, key=repr)
