"""Licence scans: one Aho-Corasick automaton finds notice phrases and identifier tags; tagged expressions are parsed by a shunting yard.

Phrases are sequences of words (letters, digits and non-ASCII characters; A-Z as a-z), so that punctuation and line breaks do not matter.
After an identifier tag the rest of the line is read as an expression of identifiers, ``and``, ``or``, ``with`` and brackets. It is
brought into postfix order, from which a stack evaluates it: to its licences, to whether a set of licences satisfies it (``satisfied``, one pass, whatever its size), and to its number of
alternatives. The alternatives, each a set of licences, are also listed while they are at most ``LISTED``; a larger expression stays as it is written, in its factored form, and
its list is null. A broken expression yields none. What follows ``with`` is the name of one exception, never a bracket.

Edge cases: a null or empty text has no words, no labels and the score 0. Places may overlap, all count. Repeated rows are scanned one by one.
An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import plain_words, query, table

#: The base phrases of the query and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices and their labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit", "the mit license": "mit", "mit license": "mit", "licensed under mit": "mit",
    "apache license": "apache", "licensed under the apache license": "apache", "apache 2 0": "apache-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu gpl": "gpl", "gplv2": "gpl-2", "gplv3": "gpl-3", "gnu lesser general public license": "lgpl", "lgpl": "lgpl",
    "gnu affero general public license": "agpl", "agplv3": "agpl", "mozilla public license": "mpl", "mpl 2 0": "mpl-2",
    "redistribution and use in source and binary forms": "bsd", "bsd license": "bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
    "isc license": "isc", "eclipse public license": "epl", "boost software license": "bsl", "this is free and unencumbered software": "unlicense",
    "creative commons attribution": "cc-by", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd", "creative commons zero": "cc0", "cc0": "cc0", "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx[^0-9a-z\x80-\U0010ffff]+license[^0-9a-z\x80-\U0010ffff]+identifier[^0-9a-z\x80-\U0010ffff(\n]*([^\n]*)", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+")
#: How strongly operators bind.
BINDS = {"or": 1, "and": 2, "with": 3}
#: What a kind of evidence adds: the score is one minus the product of what each leaves open.
EVIDENCE = {"tag": 0.95, "notice": 0.8, "mention": 0.5}
#: Alternatives are listed up to this number of them and of licences; nothing else depends on it. Numbers of choices are counted up to ``MANY``.
LISTED, MANY = 256, 1 << 62

HITS = "n_words bigint, hits array<struct<label: string, word: bigint, kind: string>>, expressions array<struct<text: string, licences: array<string>, choices: bigint, alternatives: array<string>>>"


def postfix(text: str) -> list[str] | None:
    """The expression's tokens in postfix order; null if it is not well formed. It ends where a comment closes or a word that fits nothing follows."""
    out: list[str] = []
    held: list[str] = []
    operand = False  # whether the last token was one
    for token in TOKEN.findall(text):
        word = token.lower()
        if token == "(":
            if operand:
                break
            if held and held[-1] == "with":
                return None
            held.append(token)
        elif token == ")":
            if not operand:
                return None
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif word in BINDS:
            if not operand:
                return None
            while held and held[-1] != "(" and BINDS[held[-1]] >= BINDS[word]:
                out.append(held.pop())
            held.append(word)
            operand = False
        else:
            if operand:
                break
            out.append(word.rstrip(".:-"))
            operand = True
    if not operand or "(" in held or not all(out):
        return None
    out += held[::-1]
    return out if _resolved(out) is not None else None


def licence(identifier: str) -> str:
    """Label of an identifier: version numbers without a trailing .0, without -only and -or-later."""
    name = re.sub(r"(-only|-or-later|\+)$", "", identifier.lower())
    name = re.sub(r"^(cc-by[a-z-]*|cc0|mit|isc|unlicense)-[0-9.]+$", r"\1", name)
    return re.sub(r"(\.0)+$", "", name)


def _resolved(order: list[str]) -> list[str] | None:
    """The postfix expression of labels, ``&`` and ``|``, exceptions joined to the licences before them; null if one gets a second exception or a name is empty."""
    out: list[str] = []
    spans: list[tuple[int, bool]] = []  # where an operand begins in ``out``, and whether it has exceptions
    for token in order:
        if token not in BINDS:
            spans.append((len(out), False))
            out.append(licence(token))
            if not out[-1]:
                return None
            continue
        (_, more), (first, some) = spans.pop(), spans.pop()
        if token == "with":
            if some:
                return None
            exception = out.pop()  # a single name, as ``postfix`` lets nothing else follow
            out[first:] = [x if x in ("&", "|") else f"{x} with {exception}" for x in out[first:]]
            spans.append((first, True))
        else:
            out.append("&" if token == "and" else "|")
            spans.append((first, some or more))
    return out


def licences_of(order: list[str]) -> list[str]:
    """All licences of the expression, each with its exception; sorted."""
    return sorted(set(_resolved(order)) - {"&", "|"})


def _evaluated(order: list[str], leaf, disjoin, conjoin):
    """The expression's value by a stack, without recursion."""
    stack = []
    for token in _resolved(order):
        if token in ("&", "|"):
            b, a = stack.pop(), stack.pop()
            stack.append((disjoin if token == "|" else conjoin)(a, b))
        else:
            stack.append(leaf(token))
    return stack[0]


def choices(order: list[str]) -> int:
    """In how many ways the expression can be met, a choice at each ``or``, before equal or larger sets are left out; ``MANY`` stands for that and more."""
    return _evaluated(order, lambda n: 1, lambda a, b: min(a + b, MANY), lambda a, b: min(a * b, MANY))


def satisfied(order: list[str], allowed) -> bool:
    """Whether licences that are all ``allowed`` meet the expression. A bracket before ``with`` has the exception on each of its licences."""
    return _evaluated(order, lambda n: n in allowed, lambda a, b: a or b, lambda a, b: a and b)


def alternatives(order: list[str], most: int = LISTED) -> list[frozenset[str]] | None:
    """The sets of licences that satisfy the expression, without those that hold another; null if there are more than ``most`` choices or licences."""
    if choices(order) > most or len(licences_of(order)) > most:
        return None

    def least(sets):
        return [x for i, x in enumerate(sets) if not any(y < x or y == x and j < i for j, y in enumerate(sets))]

    return _evaluated(order, lambda n: [frozenset([n])], lambda a, b: least(a + b), lambda a, b: least([x | y for x in a for y in b]))


class Scanner:
    def __init__(self):
        self.machine = ahocorasick.Automaton()
        phrases: dict[str, list[tuple[str | None, str]]] = {}
        for phrase, label in BASE.items():
            phrases.setdefault(phrase, []).append((label, "base"))
        for phrase, label in NOTICES.items():
            phrases.setdefault(phrase, []).append((label, "mention" if len(phrase.split()) < 3 else "notice"))
        phrases.setdefault(TAG, []).append((None, "tag"))
        for phrase, what in phrases.items():
            self.machine.add_word(f" {phrase} ", (len(phrase) + 1, what))
        self.machine.make_automaton()

    def scan(self, text: str | None):
        """Number of words, hits in the order of their places, expressions."""
        words = plain_words(text)
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")  # one character for each byte; phrases are ASCII
        hits, tagged, gaps = [], False, None
        for end, (size, found) in self.machine.iter(line):
            gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32) if gaps is None else gaps
            word = int(np.searchsorted(gaps, end - size))
            for label, kind in found:
                tagged |= label is None
                if label is not None:
                    hits.append((label, word, kind))
        expressions = []
        for m in TAG_LINE.finditer(text) if tagged else ():
            order = postfix(m[1])
            if order:
                sets = alternatives(order)
                listed = sorted(" and ".join(sorted(a)) for a in sets) if sets is not None else None
                expressions.append((" ".join(order), licences_of(order), choices(order), listed))
        return len(words), sorted(hits, key=lambda h: (h[1], h[0], h[2])), expressions


def scanned(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n_words, hits, expressions``: every place of a phrase, and every well-formed expression (in postfix order) with its licences, the number of
    its choices, and its alternatives."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    hit_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("kind", pa.string())]))
    expression_type = pa.list_(pa.struct([("text", pa.string()), ("licences", pa.list_(pa.string())), ("choices", pa.int64()), ("alternatives", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]):
        scanner = Scanner()
        for batch in batches:
            found = [scanner.scan(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"label": a, "word": b, "kind": c} for a, b, c in h] for _, h, _ in found], hit_type),
                pa.array([[dict(zip(("text", "licences", "choices", "alternatives"), x)) for x in e] for _, _, e in found], expression_type),
            ], ["id", "n_words", "hits", "expressions"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {HITS}")


def permitted(documents: DataFrame, allowed, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, permitted``: whether the allowed licences (labels, as in ``licences``) meet every tagged expression of the text; null if it has none."""
    names = frozenset(allowed)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            met = [[satisfied(t.split(), names) for t in texts] for texts in batch.column("texts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([all(m) if m else None for m in met], pa.bool_())], ["id", "permitted"])

    rows = scanned(documents, id_column, text_column).select("id", F.transform("expressions", lambda e: e["text"]).alias("texts"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, permitted boolean")


@query("op1_licence_scan")
def op1_licence_scan(spark, folder):
    """Places of the base phrases, all labels and a score for every document."""
    found = scanned(table(spark, folder, "documents"))
    base = F.filter("hits", lambda h: h["kind"] == "base")
    places = F.transform(base, lambda h: h["word"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    tags = F.flatten(F.transform("expressions", lambda e: e["licences"]))
    written = lambda e: F.coalesce(F.array_join(e["alternatives"], " or "), e["text"])
    kinds = F.transform("hits", lambda h: F.when(h["kind"] == "base", "notice").otherwise(h["kind"]))
    open_ = F.when(F.size("expressions") > 0, 1 - EVIDENCE["tag"]).otherwise(1.0)
    for kind in ("notice", "mention"):
        open_ = open_ * F.when(F.array_contains(kinds, kind), 1 - EVIDENCE[kind]).otherwise(1.0)
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"),
        joined(F.transform(base, lambda h: h["label"])).alias("base_labels"), joined(F.concat(F.transform("hits", lambda h: h["label"]), tags)).alias("labels"),
        F.round(1 - open_, 6).alias("score"), F.array_join(F.transform("expressions", written), "; ").alias("expressions"),
    )
