"""Licence scans against brute force."""

import random
import re

from pyspark.sql import functions as F

from floodgauge.llm import licences as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for p, label in lic.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


TEXTS = [
    None, "", "Released under the MIT License.", "under the MIT\n\nlicense under,the:mit;LICENSE", "CC BY-NC 4.0, CC-BY-NC-SA; cc by nc by nc",
    "Licensed under the Apache License, Version 2.0.", "Apache License version 20", "éunder the mit license", "İ under the mit license é",
    "cc by nc " * 30_000, "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */",
    "spdx license identifier: MIT AND", "x\x0bunder\x00the mit\tlicense", "This work is licensed under the GNU General Public License, version 3.",
]


def test_scan_equals_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").withColumn("hits", F.lit(1))
    df.createOrReplaceTempView("documents")
    for r in lic.scanned(df).collect():
        base = [h for h in r.hits if h.kind == "base"]
        at = [h.word for h in base]
        assert (r.n_words, len(at), min(at, default=None), max(at, default=None), ",".join(sorted({h.label for h in base}))) == brute(TEXTS[r.id]), TEXTS[r.id]
    assert lic.scanned(df.limit(0)).count() == 0


def test_expressions():
    value = lambda t: (o := lic.postfix(t)) and sorted(" and ".join(sorted(a)) for a in lic.alternatives(o))
    assert value("MIT") == ["mit"]
    assert value("MIT OR Apache-2.0 AND BSD-3-Clause") == ["apache-2 and bsd-3-clause", "mit"]
    assert value("(MIT OR Apache-2.0) AND BSD-3-Clause") == ["apache-2 and bsd-3-clause", "bsd-3-clause and mit"]
    assert value("GPL-2.0-or-later WITH Classpath-exception-2.0 OR MIT") == ["gpl-2 with classpath-exception-2", "mit"]
    assert value("MIT OR (MIT AND ISC)") == ["mit"]
    assert value("or+ AND and-only") == ["and and or"] and value("x OR +") is None
    assert value("MIT */") == ["mit"] and value("MIT)") == ["mit"]
    for broken in ("", "AND MIT", "MIT OR", "(MIT", "()", "MIT AND OR ISC"):
        assert not value(broken)


def test_large_expressions_are_not_cut():
    nine = lic.postfix(" AND ".join(f"(a{k} OR b{k})" for k in range(9)))
    assert lic.choices(nine) == 512 and lic.alternatives(nine) is None and len(lic.alternatives(nine, 512)) == 512
    assert len(lic.licences_of(nine)) == 18
    assert lic.satisfied(nine, {f"{'ab'[k % 2]}{k}" for k in range(9)}) and not lic.satisfied(nine, {f"a{k}" for k in range(8)} | {"b7"})
    many = lic.postfix(" AND ".join(f"(a{k} OR b{k})" for k in range(20_000)))
    assert lic.choices(many) == lic.MANY and len(lic.licences_of(many)) == 40_000 and lic.alternatives(many) is None
    assert lic.satisfied(many, {f"a{k}" for k in range(20_000)}) and not lic.satisfied(many, {f"a{k}" for k in range(19_999)})
    for broken in ("GPL-2.0 WITH (a OR b)", "GPL-2.0 WITH a WITH b", "(GPL-2.0 WITH a OR MIT) WITH b"):
        assert lic.postfix(broken) is None
    assert lic.licences_of(lic.postfix("(GPL-2.0 OR MIT) WITH b AND ISC")) == ["gpl-2 with b", "isc", "mit with b"]


def test_satisfied_equals_the_listed_alternatives():
    draw = random.Random(6)

    def expression(depth):
        if depth == 0 or draw.random() < 0.2:
            return draw.choice("abcd") + (" WITH x" if draw.random() < 0.2 else "")
        inner = f"({expression(depth - 1)} {draw.choice(['AND', 'OR'])} {expression(depth - 1)})"
        return inner + (" WITH y" if draw.random() < 0.15 else "")

    orders = [o for o in (lic.postfix(expression(3)) for _ in range(400)) if o]  # without those that give a licence two exceptions
    assert len(orders) > 200
    for order in orders:
        sets = lic.alternatives(order, 10**6)
        assert set().union(*sets) <= set(lic.licences_of(order)) and len(sets) <= lic.choices(order)
        for _ in range(8):
            allowed = {n for n in lic.licences_of(order) if draw.random() < 0.6}
            assert lic.satisfied(order, allowed) == any(x <= allowed for x in sets)


def test_permitted_documents(spark):
    tag = "// SPDX-License-Identifier: "
    rows = [(1, tag + "MIT OR GPL-2.0-only"), (2, tag + "MIT AND GPL-2.0-only"), (3, "no tag"), (4, None), (5, tag + "MIT\n" + tag + "ISC"), (5, tag + "MIT"),
            (6, tag + " AND ".join(f"(MIT OR b{k})" for k in range(40)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("permitted", F.lit("x"))
    assert sorted((tuple(r) for r in lic.permitted(df, {"mit"}).collect()), key=str) == [(1, True), (2, False), (3, None), (4, None), (5, False), (5, True), (6, True)]
    (r,) = lic.scanned(df.where("doc_id = 6")).collect()
    assert r.expressions[0].alternatives is None and r.expressions[0].choices == 2**40 and len(r.expressions[0].licences) == 41


def test_query(spark, folder):
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = lic.op1_licence_scan(spark, folder).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert sorted(set(r.labels.split(","))) == r.labels.split(",")
