"""Decontamination against brute force."""

import random

from pyspark.sql import functions as F

from floodgauge.llm import decontamination as dc
from floodgauge.llm.common import plain_words


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        words, hit, names = plain_words(text), set(), set()
        for name, item in items:
            w = plain_words(item)
            size = min(window, len(w))
            grams = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if size else set()
            for k in range(len(words) - size + 1):
                if size and tuple(words[k : k + size]) in grams:
                    hit |= set(range(k, k + size))
                    names.add(name)
        out.append((i, len(words), len(hit), sorted(names)))
    return out


def cases(seed=3):
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") * draw.choice((1, 2))
    items = [(str(k), " ".join(word() for _ in range(draw.choice((3, 9, 10, 11, 40))))) for k in range(25)]
    items += [("7", items[3][1]), ("30", ""), ("31", None), ("32", "Zz!"), ("", "without an id one two three")]
    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(30))]
        for _ in range(draw.choice((0, 1, 3))):
            w = (draw.choice(items[:25])[1] or "").split()
            a = draw.randrange(max(1, len(w) - 9))
            parts.append(", ".join(w[a : a + draw.choice((9, 10, 14))]).upper())
            parts.append(" ".join(word() + "x" for _ in range(4)))
        docs.append((k, "\n".join(parts)))
    docs += [(100, None), (101, ""), (102, "zZ"), (102, "zZ"), (103, "é zz é"), (104, ("long " * 40_000) + items[4][1])]
    return docs, items


def frames(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_words", F.lit("x")).withColumn("n_chars", F.length("text"))
    return d.repartition(3), spark.createDataFrame(items, "item_id string, text string").withColumn("items", F.lit(1))


def test_matches_equal_brute_force_in_one_and_many_blocks(spark):
    docs, items = cases()
    d, i = frames(spark, docs, items)
    want = sorted(map(str, brute(docs, items)))
    for block_words in (dc.BLOCK_WORDS, 150):
        got = dc.matches(d, i, block_words=block_words).collect()
        assert sorted(str((r.id, r.n_words, sum(s.b - s.a for s in r.spans), r["items"])) for r in got) == want


def test_cleaned_documents_hold_no_window(spark):
    docs, items = cases(9)
    d, i = frames(spark, docs, items)
    got = dc.decontaminated(d, i).collect()
    assert all(n == 0 for _, _, n, _ in brute([(r.doc_id, r.text) for r in got], items))
    before = {r[0]: r for r in brute(docs, items)}
    untouched = {k: t for k, t in docs}
    for r in got:
        if before[r.doc_id][2] == 0:
            assert r.text == untouched[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))
    clean = {k for k, b in before.items() if b[2] == 0}
    assert clean <= {r.doc_id for r in got}
    assert {r.doc_id for r in got}.isdisjoint(k for k, b in before.items() if b[2] > 0.5 * b[1])
    assert d.columns == list(got[0].asDict())


def test_nothing_to_find(spark):
    docs, items = cases()
    d, i = frames(spark, docs, items)
    assert dc.matches(d.limit(0), i).count() == 0
    assert dc.matches(d, i.limit(0)).where(F.size("spans") > 0).count() == 0
    assert dc.decontaminated(d, i.limit(0)).count() == len(docs)


def test_cleaning_does_not_depend_on_the_blocks(spark):
    docs, items = cases(9)
    # Items of different blocks that overlap in a text, and one that only a cut joins.
    left, right = [f"l{k}" for k in range(12)], [f"r{k}" for k in range(12)]
    items = [("a", " ".join(left)), *items, ("b", " ".join(left[6:] + right))]
    items = [("c", " ".join(f"j{k}" for k in range(12))), *items]
    docs += [(200, " ".join([f"x{k}" for k in range(40)] + left + right)), (201, " ".join([f"y{k}" for k in range(60)] + [f"j{k}" for k in range(6)] + left[6:] + right + [f"j{k}" for k in range(6, 12)]))]
    d, i = frames(spark, docs, items)
    one, many = (sorted(map(str, dc.decontaminated(d, i.coalesce(1), block_words=n).collect())) for n in (dc.BLOCK_WORDS, 150))
    assert one == many
    assert all(n == 0 for _, _, n, _ in brute([(r.doc_id, r.text) for r in dc.decontaminated(d, i, block_words=150).collect()], items))
