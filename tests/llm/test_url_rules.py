import random
import re

from hirelake.llm import url_rules as ur

LOWER = str.maketrans(ur.UPPER, ur.LOWER)


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = host.translate(LOWER)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, default)))


def run(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    table = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    rows = ur.filter_urls(pages, table).collect()
    assert len(rows) == len(urls)
    return {r.page_id: tuple(r)[1:] for r in rows}


def test_contract_rules(spark):
    urls = [None, "", "no url", "http://", "https://EXAMPLE.org/es/a?x#y", "http://a.b.example.org/en/1/2", "http://org",
            "http://org/", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "ftp://com/de/#f",
            "http://example.org?/es/", "http://example.org#/es/", "a://b://c/de/", "http://X.COM/DE/", "http://.com/de/",
            "http://com./de/", "http://www.example.org/en/2", "//example.org/es/"] * 3
    got = run(spark, urls, ur.RULES)
    assert got == {i: brute(u, ur.RULES) for i, u in enumerate(urls)}


def test_random_nested_rules(spark):
    rng = random.Random(11)
    labels, parts = ["a", "b", "ab", "é", "c-d"], ["/", "/a", "/a/", "/ab", "/b/c", ""]
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = list({(h, p): (h, p, v) for h, p, v in [
        (host(), rng.choice(parts), rng.choice(["allow", "block"])) for _ in range(60)]}.values()) + [("", "/b/c/d", "block")]
    urls = [f"http://{host()}{rng.choice(parts)}{rng.choice(parts)}{rng.choice(['', '?q', '#a'])}" for _ in range(500)]
    urls += ["http://a.b/ab/hot"] * 400  # one host with a third of the pages
    got = run(spark, urls, rules)
    for i, u in enumerate(urls):
        want = brute(u, rules)
        assert got[i] == want, (u, got[i], want)


def test_odd_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame([("a", "/", "block"), ("a", "/", "allow"), ("A", "/", "allow")], "host string, path string, verdict string")
    assert ur.filter_urls(none, rules).count() == 0
    pages = spark.createDataFrame([(None, "x://a/"), (1, "x://a/"), (1, "x://a/")], "page_id long, url string")
    assert [r.verdict for r in ur.filter_urls(pages, rules).collect()] == ["block"] * 3
    assert {r.rule for r in ur.filter_urls(pages, rules.where("false")).collect()} == {None}
