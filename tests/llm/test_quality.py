"""Quality rules against brute force; policies and ablations against the ledger."""

import re
from collections import Counter

from pyspark.sql import functions as F

from floodgauge.llm import quality as q


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}), "n_lines": len(lines), "n_marks": text.count("!"),
        "n_upper": sum("A" <= c <= "Z" for c in text), "n_distinct_words": len(set(words)),
    }
    rules = {r: eval(c.replace("AND", "and"), {}, dict(m)) for r, c in q.RULES.items()}  # the conditions read the same in both languages
    return m | {"failed": sum(q.bit(r) for r, bad in rules.items() if bad)}


TEXTS = [
    None, "", " \t\n\x0b\x0c\r", "a b c d e f g h a b c d e f g h", "a " * 15, "one two three four five six seven eight " * 3 + "x y", "line\nline\n\nline \nline",
    "ÄÖ \x1c中文 *#$%&|<> 1\xa02", "WORDS!! " * 40, "x" * 3000, " ".join(f"w{i}" for i in range(30_000)), "dup line here\n" * 20 + "end", "\r\n".join(["a b", "a b", ""]),
    " ".join(f"w{i % 9}" for i in range(40)), "same same " * 20_000,
]


def frame(spark):
    return spark.createDataFrame([(i if i % 5 else None, t) for i, t in enumerate(TEXTS)], "doc_id bigint, text string").withColumn("n_words", F.lit("x")).withColumn("failed", F.lit("x"))


def test_ledger_equals_brute_force(spark):
    got = q.ledger(frame(spark)).collect()
    want = [brute(t) for t in TEXTS]
    key = lambda m: tuple(m[c] for c in (*q.MEASURES, "failed"))
    assert sorted(key(r.asDict()) for r in got) == sorted(map(key, want))
    assert q.ledger(frame(spark).limit(0)).count() == 0


def test_policies_and_ablations(spark):
    ledger = q.verdicts(q.ledger(frame(spark)))
    rows = ledger.collect()
    for r in rows:
        for version, rules in q.POLICIES.items():
            assert r[f"kept_{version}"] == (r.failed & q.mask(rules) == 0)
    got = {(r.policy, r.rule): (r.n_failed, r.n_only, r.n_kept_without) for r in q.ablations(ledger).collect()}
    for version, rules in q.POLICIES.items():
        for rule in rules:
            others = q.mask(x for x in rules if x != rule)
            assert got[version, rule] == (
                sum(r.failed & q.bit(rule) > 0 for r in rows), sum(r.failed & q.mask(rules) == q.bit(rule) for r in rows), sum(r.failed & others == 0 for r in rows),
            )


def test_kept_documents_have_their_columns(spark):
    kept = q.keep_good(frame(spark), "base").collect()
    assert sorted(r.text for r in kept) == sorted(t for t in TEXTS if brute(t)["failed"] & q.mask(q.BASE_RULES) == 0)
    assert set(kept[0].asDict()) == {"doc_id", "text", "n_words", "failed"} and kept[0].n_words == "x"


def test_few_distinct_words_at_every_length(spark):
    """Two words repeated fail whatever the length; as many distinct words as three times the root of the length do not."""
    sizes = (200, 1_600, 2_400, 50_000)
    rows = [(n, " ".join(f"ab{i % 7 % 2}" for i in range(n))) for n in sizes] + [(-n, " ".join(f"w{i * i % (3 * int(n**0.5) + 20)}_{i % 3}" for i in range(n))) for n in sizes]
    got = {r.doc_id: r for r in q.ledger(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for n, r in got.items():
        few = 10 * r.n_distinct_words < r.n_words and r.n_distinct_words**2 < 4 * r.n_words
        assert bool(r.failed & q.bit("few_distinct_words")) == few and (n < 0 or few)
    assert not all(r.failed & q.bit("few_distinct_words") for n, r in got.items() if n < 0)
