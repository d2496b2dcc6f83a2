"""Divergence audit against plain dictionaries."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgauge.llm import divergence
from floodgauge.llm.divergence import audit, gallop, merged

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, top=200, least=3):
    """The audit by the shortest way; rows are (text, lang, source)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in {k[0] for k in counts}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        groups = {s: c for (la, s), c in counts.items() if la == lang}

        def prices(count, kept=kept):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (n + len(kept)) for t in kept}

        own = {s: prices(c) for s, c in groups.items()}
        whole = prices(sum(groups.values(), Counter()))
        for s, c in groups.items():
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o) for o in groups if o != s]
            terms = [(-((own[s][t] - whole[t]) ** 2 // whole[t]), t) for t in kept if c[t] > 0 and own[s][t] > whole[t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, item) in enumerate(found, 1)}
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def sample():
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)] + ["Äpfel", "ÉTÉ", "naïve", "日本"]
    rows = []
    for i in range(300):
        lang, source = ["en", "de", "fr"][i % 3], f"s{int(rng.integers(0, 9)) if i % 5 else 0}"
        rows.append((" ".join(rng.choice(words, rng.integers(0, 40)) if lang != "fr" else [f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"]) + " 12 A1b-C", lang, source))
    rows += [(None, "en", "silent"), ("", "xx", None), ("word word word", None, None), ("word", None, "a"), ("WORD word2", "", ""), ("x", "one", "alone")]
    return rows + rows[:20]


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 7, "block_groups": 2}, {"block_groups": 1, "top": 3}])
def test_equals_dictionaries(spark, how):
    rows = sample()
    found = audit(made(spark, rows), **how)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert rows_of(found) == plain(rows, how.get("top", 200))


def test_small_memory_and_pieces_change_nothing(spark, monkeypatch):
    rows = sample()[:60] + [("Long " * 5000 + "tail", "en", "s1")]
    batch = made(spark, rows).select("lang", "source", "text").fillna("").toArrow().combine_chunks().to_batches()[0]

    def total():
        counts = Counter()
        for part in divergence._counted(iter([batch])):
            for r in part.to_pylist():
                counts[r["lang"], r["source"], r["term"], "c"] += r["count"]
                counts[r["lang"], r["source"], r["term"], "d"] += r["docs"]
        return counts

    whole = total()
    monkeypatch.setattr(divergence, "HELD", 5)
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert total() == whole and whole["en", "s1", "long", "c"] >= 5000


def test_no_terms_one_source_and_empty(spark):
    rows = [("a b", "en", "x"), ("a", "en", "y"), ("c", "de", "z")]
    assert rows_of(audit(made(spark, rows))) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    assert audit(made(spark, rows).limit(0)).count() == 0


def test_clashing_columns(spark):
    rows = sample()[:90]
    clash = made(spark, rows).withColumns({c: F.lit("7") for c in ("term", "count", "docs", "total", "bucket", "p", "q", "value", "item", "rank", "ids", "i", "j")})
    assert rows_of(audit(clash)) == plain(rows)


def test_hot_source_and_ties(spark):
    rows = [("same words here", "en", "hot")] * 400 + [("same words here", "en", f"s{i:03}") for i in range(70)]
    assert rows_of(audit(made(spark, rows).repartition(16))) == plain(rows)


def test_prices_of_large_counts(spark):
    got = spark.createDataFrame([(9_000_000_000_000, 9_000_000_000_001, 3)], "c long, n long, v long").select(divergence.price("c", "n", "v")).first()[0]
    assert got == 1 + 10**9 * 9_000_000_000_001 // 9_000_000_000_004


def test_gallop_and_merge():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 4000, rng.integers(0, 1500))) for _ in range(2))
        assert (gallop(a, b) == np.searchsorted(b, a)).all()
        p, q = rng.integers(1, 10**9, len(a)), rng.integers(1, 10**9, len(b))
        dense_a, dense_b = np.full(4000, 17), np.full(4000, 23)
        dense_a[a], dense_b[b] = p, q
        want = tuple(int(((x - y) ** 2 // y).sum()) for x, y in ((dense_a, dense_b), (dense_b, dense_a)))
        assert merged((a, p, 17), (b, q, 23), 4000) == want
