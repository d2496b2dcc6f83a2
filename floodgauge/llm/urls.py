"""URL filters: pattern rules are indexed by their rarest literal token; a URL's tokens fetch the rules worth a regular expression.

A rule is either a site rule, ``host/path`` (the host and its subdomains, paths that start with the given one), or a pattern
in the notation of common block lists: ``||`` anchors at a label of the host, ``*`` is any text, ``^`` is one
separator or the end; the rest is literal. Rules are a list of the caller's; the index is a table that is joined, by
broadcast only below a checked size. Everything is a column expression.

Edge cases: a null URL or one without ``://`` has an empty host and path, and no rule but ``*`` fits it. Among site rules the longest
wins, at equal length block before allow, then the greater text. Repeated pages are judged one by one. Without any rule all are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import lower_ascii, query, table
from floodgauge.session import broadcast_if_small


class Rule(NamedTuple):
    text: str
    verdict: str
    site: bool = False


TOKEN = "[0-9A-Za-z]+"
#: The base rules of the query.
SITE_RULES = (
    Rule("com/", "allow", True), Rule("example.com/en/", "block", True), Rule("www.example.com/en/", "allow", True),
    Rule("net/es/", "block", True), Rule("net/fr/", "block", True),
)
#: The patterns that judge pages which no site rule fits.
PATTERN_RULES = tuple(Rule(text, "block") for text in (
    "||ads^", "||ads-", "||adserver.", "||doubleclick.", "-track.", "||tracker.", "||tracking.", "||spam-", "-spam.", "||casino-",
    "||casino.", "-casino.", "-casino^", "||poker-", "-poker.", "||adult-", "||adult.", "-adult.", "||porn.", "-porn.", "||xxx.",
    "||sex.", "-sex.", "||cheap-", "-pills.", "||pills-", "||viagra.", "-viagra.", "||free-bets.", "-bets.", "||betting.", "||payday-",
    "-loans.", "||torrent.", "||warez.", "/wp-login.php", "/wp-admin/", "/cgi-bin/", "/cart/", "/checkout/", "/login/", "/signin/",
    "/signup/", "/xmlrpc.php", "/feed/rss", "/porn/", "/casino/", "/viagra/",
))
SCHEMA = "rule string, verdict string, site boolean, regex string, size int, token string"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def regex_of(rule: Rule) -> str:
    """Expression that finds the rule in host and path written one after the other."""
    if rule.site:
        return r"^(?:[^/]*\.)?" + re.escape(rule.text)
    text, head = (rule.text[2:], r"^(?:[^/]*\.)?") if rule.text.startswith("||") else (rule.text, "")
    pieces = {"*": r"[\s\S]*", "^": r"(?:[^0-9A-Za-z_.%-]|$)"}
    return head + "".join(pieces.get(c) or re.escape(c) for c in text)


def tokens_of(rule: Rule) -> list[str]:
    """Whole tokens that every URL which the rule fits must hold: both of their ends are fixed by the rule."""
    anchored = rule.site or rule.text.startswith("||")
    text = ("." if anchored else "*") + rule.text.removeprefix("||") + ("*" if not rule.text.endswith("^") else "")
    return list(dict.fromkeys(m[0] for m in re.finditer(TOKEN, text) if text[m.start() - 1] != "*" and text[m.end()] != "*"))


def subjects(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    url = F.col(url_column).cast("string")
    return pages.select(F.col(id_column).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))


def rule_index(named: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule with the token it is filed under: the one that the fewest pages hold; null if it has none.

    Only counts of tokens that rules hold are gathered, at most one for each of them.
    """
    spark = named.sparkSession
    held = {rule: tokens_of(rule) for rule in dict.fromkeys(rules)}
    wanted = sorted({t for found in held.values() for t in found})
    known = spark.createDataFrame([(t,) for t in wanted], "token string")
    tokens = named.select(F.explode(url_tokens()).alias("token"))
    counts = dict(tokens.join(broadcast_if_small(known), "token", "left_semi").groupBy("token").count().collect())
    rows = [
        (rule.text, rule.verdict, rule.site, regex_of(rule), len(rule.text), min(found, key=lambda t: (counts.get(t, 0), -len(t), t), default=None))
        for rule, found in held.items()
    ]
    return spark.createDataFrame(rows, SCHEMA)


def url_tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), 1))


def fitting(named: DataFrame, index: DataFrame) -> DataFrame:
    """Per distinct host and path: the site rule that wins, the pattern that wins, and their verdicts.

    A URL's tokens are joined with the rules filed under them; regular expressions run on these pairs only. Pairs are
    reduced before the shuffle, so a URL that many pages share costs one row per task.
    """
    subject = F.concat("host", "path")
    tokens = named.select("host", "path", F.explode(F.concat(url_tokens(), F.array(F.lit("")))).alias("token"))
    rules = broadcast_if_small(index.fillna("", ["token"]))
    pairs = tokens.join(rules, "token").where(F.rlike(subject, F.col("regex")))
    rank = F.struct("size", "verdict", "rule")  # the longest, at equal length block, which sorts after allow
    best = lambda own: F.max(F.when(own, rank))
    return pairs.groupBy("host", "path").agg(best(F.col("site")).alias("site_rule"), best(~F.col("site")).alias("pattern_rule"))


def judged(pages: DataFrame, rules: Sequence[Rule] = SITE_RULES + PATTERN_RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, pattern`` of every page. Site rules decide; else the pattern; else allow."""
    named = subjects(pages, id_column, url_column)
    found = fitting(named, rule_index(named, rules))
    return named.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("site_rule.rule").alias("rule"),
        F.coalesce("site_rule.verdict", "pattern_rule.verdict", F.lit("allow")).alias("verdict"),
        F.col("pattern_rule.rule").alias("pattern"),
    )


def _sql() -> str:
    values = ", ".join("({}, '{}', {}, '{}')".format(*("'" + r.text + "'", r.verdict, str(r.site).upper(), regex_of(r).replace(r"[\s\S]", "(?s:.)"))) for r in SITE_RULES + PATTERN_RULES)
    return rf"""
WITH rules(rule, verdict, site, regex) AS (VALUES {values}),
p AS (SELECT row_number() OVER () AS r, page_id,
  translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT r, rule, verdict, site, row_number() OVER (PARTITION BY r, site ORDER BY length(rule) DESC, verdict DESC, rule DESC) AS k
  FROM p JOIN rules ON regexp_matches(host || path, regex))
SELECT page_id, host, path, s.rule AS rule, coalesce(s.verdict, t.verdict, 'allow') AS verdict, t.rule AS pattern
FROM p LEFT JOIN (SELECT * FROM m WHERE site AND k = 1) s USING (r) LEFT JOIN (SELECT * FROM m WHERE NOT site AND k = 1) t USING (r)
"""


@query("op2_url_filters", _sql())
def op2_url_filters(spark, folder):
    """Verdict on the URL of every page by the base rules and, where none fits, by the patterns."""
    return judged(table(spark, folder, "pages").select("page_id", "url"))
