"""Quality rules kept as a ledger of bits: every rule is evaluated once per document, policies are masks over the bits.

The ledger holds the measurements and one bit for each failed rule. A policy is a version name and the rules that
reject; applying it, or leaving a rule out of it, never looks at the text again. Everything is a column expression.

Edge cases: a null or empty text has no words, all measurements are 0, and the rules on word counts fail; ratios over no words are 0.
Repeated rows are judged one by one. An empty table gives an empty ledger. Other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import fresh, query, table

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_distinct_words")

#: Rules in the order of their bits. The first two are the base rules; every text is a condition on the measurements, in SQL.
#: The distinct words of a language grow about with the root of the length, so few of them are a tenth up to 400 words and twice the root beyond.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "exclamations": "3 * n_marks > n_words",
    "capitals": "n_words > 0 AND 2 * n_upper > word_chars",
    "long_words": "word_chars > 20 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "repeated_lines": "n_lines > 3 AND 2 * n_dup_lines > n_lines",
    "few_distinct_words": "10 * n_distinct_words < n_words AND n_distinct_words * n_distinct_words < 4 * n_words",
}
BASE_RULES = ("few_words", "repeated_windows")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE_RULES,
    "v1": tuple(RULES),
    "v1_lenient": (*BASE_RULES, "symbols", "long_words", "short_words"),
}


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask(rules: Iterable[str]) -> int:
    return sum(bit(rule) for rule in dict.fromkeys(rules))


def removed(text: Column, characters: str) -> Column:
    """Number of the text's code points that are among these characters."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeated_words(windows: Column, ranked: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``ranked``: (hash, position) in order, null if all differ."""
    last = F.size(ranked) - 1
    twice = F.filter(
        ranked,
        lambda x, i: ((i > 0) & (F.get(ranked, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(ranked, i + 1)["h"] == x["h"])),
    )
    places = F.array_sort(F.transform(twice, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        places, start,
        lambda a, p: F.struct((p + WINDOW).alias("end"), (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(ranked.isNull(), F.lit(0)).otherwise(covered)


def measured(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Identifier and measurements of every document.

    Windows of eight words are compared by 64-bit hashes inside one document.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.transform(F.col("words"), lambda w: F.xxhash64(w))
    windows = F.when(
        F.size("hashes") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    pairs = F.array_sort(F.transform(F.col("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    step = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    step = step.select("doc_id", "text", F.array_remove(F.split(text, SPACE, -1), "").alias("words"), lines.alias("lines"))
    step = step.select("*", hashes.alias("hashes"))
    step = step.select("*", windows.alias("windows"))
    step = step.select("*", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), pairs).alias("ranked"))
    long = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate(text, SPACES, "")),
        "n_symbols": removed(text, SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeated_words(F.col("windows"), F.col("ranked")),
        "n_lines": F.size("lines"),
        "n_marks": removed(text, "!"),
        "n_upper": removed(text, ASCII_UPPER),
        "n_distinct_words": F.size(F.array_distinct("hashes")),
    }
    return step.select("doc_id", *(long[name].cast("long").alias(name) for name in MEASURES))


def ledger(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Measurements and ``failed``: the bits of the rules that the document fails. Each rule is evaluated once."""
    bits = [F.when(F.expr(condition), F.lit(bit(rule))).otherwise(F.lit(0)) for rule, condition in RULES.items()]
    failed = bits[0]
    for more in bits[1:]:
        failed = failed.bitwiseOR(more)
    return measured(documents, id_column, text_column).withColumn("failed", failed.cast("long"))


def passes(failed: Column, rules: Iterable[str]) -> Column:
    return failed.bitwiseAND(F.lit(mask(rules))) == 0


def verdicts(of: DataFrame, policies: Mapping[str, Iterable[str]] = POLICIES) -> DataFrame:
    """The ledger with one boolean ``kept_<version>`` for each policy."""
    return of.withColumns({f"kept_{version}": passes(F.col("failed"), rules) for version, rules in policies.items()})


def ablations(of: DataFrame, policies: Mapping[str, Iterable[str]] = POLICIES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, that only it rejects, and that stay without it.

    The ledger is first counted by its bit sets, of which there are 2^rules at most whatever the number of documents.
    """
    counted = of.groupBy("failed").agg(F.count("*").alias("n"))
    cases = [
        F.struct(F.lit(version).alias("policy"), F.lit(rule).alias("rule"), F.lit(bit(rule)).alias("bit"), F.lit(mask(rules)).alias("mask"))
        for version, rules in policies.items() for rule in rules
    ]
    each = counted.select("failed", "n", F.explode(F.array(*cases)).alias("c")).select("failed", "n", "c.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "rule").agg(
        F.sum(F.when(F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def keep_good(documents: DataFrame, policy: str = "v1", text_column: str = "text") -> DataFrame:
    """The documents that pass the policy, with their columns as they were. No join: the ledger travels with the row."""
    row = fresh(documents, "row")
    carried = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(row), F.col(text_column).alias("text"))
    # The number keeps the filter where it is: pushed down, it would repeat the measurements' expressions many times over.
    judged = ledger(carried, row, "text").withColumn("number", F.monotonically_increasing_id())
    return judged.where(passes(F.col("failed"), POLICIES[policy]) & (F.col("number") >= 0)).select("doc_id.*")


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_BASE = "coalesce(d.n_words < 20 OR 100 * d.n_repeat_words > 30 * d.n_words, FALSE)"
SQL = rf"""
WITH rows AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
starts AS (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM rows WHERE len(words) >= 8),
win AS (SELECT r, i, array_to_string(words[i:i+7], ' ') AS w FROM starts),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n FROM (
  SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (SELECT r, doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_marks,
    CAST(length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_distinct(words)) AS BIGINT) AS n_distinct_words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows),
d AS (SELECT m.* EXCLUDE (lines), CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM m LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_BASE} AS base_failed,
  NOT ({" OR ".join(f"({c})" for c in RULES.values())}) AS kept,
  CAST({" + ".join(f"CASE WHEN {c} THEN {bit(r)} ELSE 0 END" for r, c in RULES.items())} AS BIGINT) AS failed
FROM d
"""


@query("op10_quality_rules", SQL)
def op10_quality_rules(spark, folder):
    """Base measurements, the base verdict and the verdict of policy v1 for every document."""
    judged = ledger(table(spark, folder, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~passes(F.col("failed"), BASE_RULES)).alias("base_failed"), passes(F.col("failed"), POLICIES["v1"]).alias("kept"), "failed",
    )
