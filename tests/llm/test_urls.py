"""URL filters against plain Python rules, and the index."""

import re

from pyspark.sql import functions as F

from floodgauge.llm import urls
from floodgauge.llm.urls import Rule

URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/1?x#y", "http://blog.example.com/en/", "http://example.com/EN/", "http://example.com", "http://xexample.com/en/a",
    "http://a.net/es/1", "http://a.net/fr", "ftp://net/es/", "http://notnet/es/", "http://a.org/de/1://b.com/en/", "http://casino-win.example.net/en/1", "http://cheap-pills.example.org/",
    "http://a.org/wp-login.php", "http://a.org/x/cart/y", "http://a.org/carts/", "http://a.org?u=http://b.com/", "http://a.com.org/\nen/", "http://user@a.com:80/en/", "http://é.com/x",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def brute(url, rules):
    host, path = parts(url)
    fits = []
    for r in rules:
        if r.site:
            h, _, p = r.text.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append(r)
    site = max(fits, key=lambda r: (len(r.text), r.verdict, r.text), default=None)
    named = [r for r in rules if not r.site and re.search(urls.regex_of(r), host + path)]
    pattern = max(named, key=lambda r: (len(r.text), r.verdict, r.text), default=None)
    return host, path, site and site.text, (site or pattern or Rule("", "allow")).verdict, pattern and pattern.text


def compare(spark, rules):
    df = spark.createDataFrame(list(enumerate(URLS + URLS[:5])), "page_id bigint, url string").withColumn("host", F.lit("x")).withColumn("token", F.lit(1))
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(df.repartition(3), rules).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(URLS + URLS[:5])}
    assert urls.judged(df.limit(0), rules).count() == 0


def test_rules_equal_plain_python(spark):
    compare(spark, urls.SITE_RULES + urls.PATTERN_RULES)


def test_wildcards_and_rules_without_token(spark):
    compare(spark, (*urls.SITE_RULES, Rule("*", "block"), Rule("cas*win", "allow"), Rule("||a.org^*y", "block"), Rule("/x", "block"), Rule("org/x", "allow", True)))
    compare(spark, ())


def test_tokens_are_held_by_every_fitting_url():
    assert urls.tokens_of(Rule("||ads^", "block")) == ["ads"]
    assert urls.tokens_of(Rule("||ads", "block")) == []
    assert urls.tokens_of(Rule("cas*win/", "block")) == []
    assert urls.tokens_of(Rule("/wp-login.php", "block")) == ["wp", "login"]
    assert urls.tokens_of(Rule("example.com/en/", "block", True)) == ["example", "com", "en"]


def test_rules_are_filed_under_the_rarest_token(spark):
    df = spark.createDataFrame([(i, f"http://www.example.com/en/{i}") for i in range(20)] + [(99, "http://b.net/es/")], "page_id bigint, url string")
    index = {r.rule: r.token for r in urls.rule_index(urls.subjects(df), urls.SITE_RULES + (Rule("*", "block"),)).collect()}
    assert index["net/es/"] == "net" or index["net/es/"] == "es"
    assert index["*"] is None and index["com/"] == "com"
