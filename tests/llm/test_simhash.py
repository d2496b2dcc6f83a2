"""SimHash against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

from floodgauge.llm import simhash
from floodgauge.llm.components import stars


def brute_fingerprint(text, shingle=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(codes, budget):
    """Smallest code reachable from each."""
    codes = sorted(set(codes))
    root = {c: c for c in codes}

    def find(c):
        while root[c] != c:
            c = root[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


def clustered_codes(seed=7, n=60):
    """Random codes, chains of small steps, and many codes under one long common prefix."""
    draw = random.Random(seed)
    codes = {draw.getrandbits(64) for _ in range(n)}
    for c in list(codes)[:20]:
        for _ in range(8):
            for b in draw.sample(range(64), draw.choice((1, 1, 2, 3))):
                c ^= 1 << b
            codes.add(c)
    base = draw.getrandbits(64)
    codes |= {base ^ draw.getrandbits(9) ^ (draw.getrandbits(5) << 40) for _ in range(250)}
    return [c - 2**64 if c >= 2**63 else c for c in codes]


def components_of(spark, codes, **how):
    nodes = spark.createDataFrame([(c,) for c in codes], "f0 bigint").repartition(3)
    roots = {r.a: r.b for r in stars(simhash.links(nodes, **how)).collect()}
    return {c: roots.get(c, c) for c in codes}


def test_links_equal_brute_force(spark):
    codes = clustered_codes()
    assert components_of(spark, codes, budget=2) == brute_components(codes, 2)


def test_hot_units_are_split(spark):
    codes = clustered_codes(11)
    assert components_of(spark, codes, budget=2, unit_rows=20) == brute_components(codes, 2)


def test_wider_budget_with_node_pairs_at_the_top(spark):
    codes = clustered_codes(3)
    assert components_of(spark, codes, budget=6, start_bits=4, unit_rows=60) == brute_components(codes, 6)


def test_texts_and_edge_cases(spark):
    text = "the quick brown fox jumps over the lazy dog and runs far away from here " * 3
    rows = [
        (5, text), (3, text.upper()), (9, text), (9, text), (4, None), (2, ""), (8, " \t\n"), (None, text), (7, "one two"), (6, "One\x0bTWO"),
        (11, "é" * 50_000 + " word" * 30_000), (12, "other words stand here and nothing links them"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("f0", F.lit("x")).withColumn("component", F.lit(1))
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    codes = {i: brute_fingerprint(t) for i, t in rows}
    signed = lambda c: c - 2**64 if c >= 2**63 else c
    assert all(r.f0 == signed(codes[r.id]) for r in got)
    parts = {(r.id, r.component) for r in got}
    assert parts == {(5, 3), (3, 3), (9, 3), (None, 3), (4, 2), (2, 2), (8, 2), (7, 6), (6, 6), (11, 11), (12, 12)}


def test_one_of_each_group_stays(spark):
    draw = random.Random(5)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    rows, groups = [], {}
    for g in range(40):
        base = words(draw.choice((60, 300)))
        for c in range(draw.choice((1, 1, 3, 5))):
            other = list(base)
            if c:
                other = " \n".join(other).upper().split(" ")  # the same words
            rows.append((len(rows), " ".join(other)))
            groups.setdefault(g, []).append(len(rows) - 1)
    rows += [(0, rows[0][1]), (500, None), (501, ""), (None, rows[0][1])]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit(1))).collect()
    assert sorted(r.doc_id for r in got) == sorted([g[0] for g in groups.values()] + [500])
    assert got[0].asDict().keys() == {"doc_id", "text", "key"}


def test_empty_table(spark):
    assert simhash.one_of_each(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_whole_query_equals_brute_force(spark, folder):
    got = {r.doc_id: r for r in simhash.op3_simhash(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    codes = {d.doc_id: brute_fingerprint(d.text) for d in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{c:016x}" for i, c in codes.items()}
    root = brute_components(codes.values(), 2)
    first = {}
    for i, c in sorted(codes.items()):
        first.setdefault(root[c], i)
    assert {i: r.component_id for i, r in got.items()} == {i: first[root[c]] for i, c in codes.items()}
