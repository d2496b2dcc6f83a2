"""N-gram join against all pairs, and its edge cases."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from floodgauge.llm import ngram_join
from floodgauge.llm.ngram_join import combined, joined, least_common, sketch, tokens

SCHEMA = "doc_id long, text string"


def words_of(text):
    return (text or "").encode().lower().split()


def plain(rows, percent=90, shingle=3):
    """Set sizes and components by comparing all pairs; rows are (id, text)."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set()))
    home = list(range(len(rows)))

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            home[max(root(a), root(b))] = min(root(a), root(b))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(root(i))) for i, (doc, _) in enumerate(rows)), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("id", "n", "component").collect()), key=repr)


def near_copies(seed, bases=12, each=14, lengths=(1, 2, 3, 9, 12, 17, 25, 38, 43, 70, 84, 150)):
    """Texts of every band, changed word by word several times over, so that chains of links arise."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    texts = []
    for b in range(bases):
        text = list(rng.choice(vocabulary, lengths[b % len(lengths)]))
        for _ in range(each):
            texts.append(" ".join(text))
            if rng.random() < 0.3:
                text = text + [str(rng.choice(vocabulary))]
            elif rng.random() < 0.7:
                text = list(text)
                text[int(rng.integers(0, len(text)))] = str(rng.choice([*vocabulary, f"own{rng.integers(0, 9)}"]))
    order = rng.permutation(len(texts))
    return [(int(i), texts[int(o)]) for i, o in enumerate(order)]


@pytest.mark.parametrize("percent,shingle,crowd", [(90, 3, None), (90, 3, 2), (80, 3, 3), (60, 2, 3), (90, 1, None)])
def test_equals_all_pairs(spark, monkeypatch, percent, shingle, crowd):
    if crowd:
        monkeypatch.setattr(ngram_join, "PAIRED", crowd)
        monkeypatch.setattr(ngram_join, "BLOCK", crowd)
        monkeypatch.setattr(ngram_join, "CLASSES", (2, 5))
    rows = near_copies(percent + shingle)
    assert got(joined(spark.createDataFrame(rows, SCHEMA), percent=percent, shingle=shingle)) == plain(rows, percent, shingle)


def test_group_without_its_original(spark):
    """Near copies that are linked to few others, and more that differ from one another by just too much."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(110)]
    texts = []
    for i in range(120):
        text = list(base)
        for at in rng.choice(110, 1 + i % 2, replace=False):
            text[at] = f"x{i}" if i % 3 else f"y{i % 5}"
        texts.append(" ".join(text))
    rows = list(enumerate(texts))
    assert got(joined(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_null_empty_repeated_and_clashing(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One"), (3, "one"), (3, "one two"), (None, long), (None, long + " tail"), (9, long.upper()), (9, long.upper()), (2, long + " tail"), (None, "alone"), (None, None), (11, "eins zwei drei")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert got(joined(frame)) == plain(rows)
    clash = frame.withColumns({c: F.lit(1) for c in ("id", "n", "h", "node", "key", "label", "component", "a", "b", "t", "df")})
    assert got(joined(clash)) == plain(rows)
    assert got(joined(frame.limit(0))) == []
    assert got(joined(frame.where("text is null"))) == plain([r for r in rows if r[1] is None])


def test_shared_passage_links_nothing(spark):
    rng = np.random.default_rng(8)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i, " ".join([passage, *(f"o{i}x{k}" for k in range(int(rng.integers(20, 60))))])) for i in range(300)] + [(300, passage), (301, passage + " end")]
    found = {r[0]: r[2] for r in got(joined(spark.createDataFrame(rows, SCHEMA)))}
    assert found == {**{i: i for i in range(300)}, 300: 300, 301: 300}


def test_ids_of_text(spark):
    rows = [("b", "x y z"), ("a", "x y z"), ("c", "q")]
    frame = spark.createDataFrame(rows, "doc_id string, text string")
    assert got(joined(frame)) == [("a", 1, "a"), ("b", 1, "a"), ("c", 1, "c")]


def test_tokens_of_pieces(monkeypatch):
    text = " ".join(f"word{i % 37}" for i in range(400)) + " \n end"
    whole = tokens(text)
    assert len(whole) == len({tuple(words_of(text)[i : i + 3]) for i in range(len(words_of(text)) - 2)})
    monkeypatch.setattr(ngram_join, "PIECE", 11)
    assert (tokens(text) == whole).all() and (tokens("a b") == tokens(" A\tB ")).all() and len(tokens("a b")) == 1


def test_linked_sets_share_a_combination_and_sketches_bound_the_difference():
    rng = np.random.default_rng(9)
    df = {int(t): int(rng.choice([1, 2, 10, 40, 300])) for t in np.unique(rng.integers(0, 2**62, 400))}
    pool = np.array(list(df))
    for _ in range(400):
        base = rng.choice(pool, rng.integers(1, 120), replace=False)
        for percent in (60, 80, 90):
            x, y = (set(base[rng.random(len(base)) < rng.choice([0.85, 0.95, 1])].tolist()) for _ in range(2))
            common = {t: df[t] if t in x & y or df[t] == 1 else df[t] for t in x | y}
            for t in x & y:
                common[t] = max(2, common[t])
            keys = []
            for s in (x, y):
                order = sorted((common[t], t) for t in s if common[t] > 1)
                values = np.array([t for _, t in order], np.int64)
                if not s or 100 * len(order) < percent * len(s):
                    keys.append(set())
                    continue
                keys.append(set(combined(values, np.array([d for d, _ in order]), len(s), percent)))
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                assert keys[0] & keys[1]
            a, b = (np.array(sorted(s), np.int64) for s in (x, y))
            if len(a) and len(b):
                p, q = sketch(a), sketch(b)
                words = min(len(p), len(q))
                assert np.bitwise_count(ngram_join._folded(p, words) ^ ngram_join._folded(q, words)).sum() <= len(x ^ y)
    assert least_common(9, 90) == 9 and least_common(10, 90) == 9
