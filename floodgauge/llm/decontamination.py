"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' words make one automaton; its states know which items hold their words. A document's words are streamed through it, the
length of the longest match so far is kept, and every place where it reaches a window's length is a hit. A window is
``WINDOW`` consecutive words of an item, or the whole item if it has fewer words. Before that, runs of words whose
neighbouring pairs all occur in items are found on arrays: only these can hold a window, the rest is never streamed.

Items are a query set: they are read in blocks of at most ``BLOCK_WORDS`` words, each block is one automaton and one pass over the
documents; what blocks find is merged. An automaton is built in the tasks from the block's texts, so a broadcast is no larger than a block, whatever the benchmark's size.

Edge cases: a null or empty text has no words and no hits. An item without words has no window; items with the same id count once;
an item without id counts as the empty id. Repeated documents are judged one by one. Without items nothing is hit.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import PLAIN_WORD, fresh, plain_words, query, table
from floodgauge.session import checkpointed

WINDOW = 10
BLOCK_WORDS = 200_000
#: A document with a larger share of hit words, or more of them, is dropped; otherwise the hit spans are cut out.
MAX_COVERAGE, MAX_HIT_WORDS = 0.5, 1_000


class Automaton:
    """Generalised suffix automaton over the items' words."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window, self.names = window, [i for i, _ in items]
        self.step: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        self.vocabulary: dict[bytes, int] = {}
        own: dict[int, int] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        pairs, sizes = set(), set()
        for number, (_, text) in enumerate(items):
            codes = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in plain_words(text)]
            if not codes:
                continue
            sizes.add(min(window, len(codes)))
            pairs.update(zip(codes, codes[1:]))
            state, path = 0, []
            for code in codes:
                state = self._extend(state, code)
                path.append(state)
            for state in path:
                own[state] = own.get(state, 0) | 1 << number
            if len(codes) < window:
                whole.setdefault(number, []).append((len(codes), number))
        self.least = min(sizes, default=0)
        self.pairs = np.sort(np.array([a << 32 | b for a, b in pairs], np.int64))
        self._finish(own, items, whole)

    def _new(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, state: int, code: int, target: int) -> int:
        """A copy of the target for the shorter strings that end here."""
        copy = self._new(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(code) == target:
            self.step[state][code] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, code: int) -> int:
        target = self.step[last].get(code)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, code, target)
        new = self._new(self.length[last] + 1, {}, 0)
        while last >= 0 and code not in self.step[last]:
            self.step[last][code] = new
            last = self.link[last]
        if last >= 0:
            target = self.step[last][code]
            self.link[new] = target if self.length[target] == self.length[last] + 1 else self._split(last, code, target)
        return new

    def _finish(self, own, items, whole) -> None:
        """Items below each state, the ancestor that stands for a window, and the short items that end at a state."""
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        held = [own.get(s, 0) for s in range(len(self.step))]
        for s in reversed(order):
            held[self.link[s]] |= held[s]
        self.held, self.anchor = held, [0] * len(held)
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number in whole:
            state, size = 0, 0
            for w in plain_words(items[number][1]):
                state, size = self.step[state][self.vocabulary[w]], size + 1
            self.short.setdefault(state, []).append((size, number))
        for s in order:
            up = self.link[s]
            if self.length[s] >= self.window:
                self.anchor[s] = self.anchor[up] or s
            if self.short.get(up):
                self.short[s] = self.short.get(s, []) + self.short[up]

    def codes(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words], np.int64)

    def runs(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of words whose pairs all occur in items, long enough to hold a window."""
        if not self.least or not len(codes):
            return []
        known = codes >= 0
        if self.least == 1:
            joined = known[1:] & known[:-1]
        else:
            joined = np.zeros(len(codes) - 1, bool)
            at = np.flatnonzero(known[1:] & known[:-1])
            key = codes[at] << 32 | codes[at + 1]
            if len(self.pairs) and len(key):
                joined[at] = self.pairs[np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)] == key
        edge = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))  # a run of words ends where a pair is missing
        lo, hi = edge[:-1], edge[1:]
        keep = (hi - lo >= self.least) & known[lo]
        return list(zip(lo[keep].tolist(), hi[keep].tolist()))

    def hits(self, codes: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, int]]:
        """``from, to, items`` of every window in this stretch; items are bits."""
        step, length, link, anchor, short = self.step, self.length, self.link, self.anchor, self.short
        state = matched = 0
        for at, code in enumerate(codes[lo:hi].tolist(), lo):
            while state and code not in step[state]:
                state = link[state]
                matched = length[state]
            target = step[state].get(code)
            if target is None:
                continue
            state, matched = target, matched + 1
            if matched >= self.window:
                yield at - self.window + 1, at + 1, self.held[anchor[state]]
            for size, number in short.get(state, ()):
                if size <= matched:
                    yield at - size + 1, at + 1, 1 << number

    def find(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: number of words, merged spans of hit words, ids of the items found."""
        words = [plain_words(t) for t in texts]
        starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        codes = np.full(int(starts[-1]), -1, np.int64)  # one gap after each text
        for at, w in zip(starts.tolist(), words):
            codes[at : at + len(w)] = self.codes(w)
        out = [(len(w), [], 0) for w in words]
        for lo, hi in self.runs(codes):
            k = int(np.searchsorted(starts, lo, side="right")) - 1
            size, spans, bits = out[k]
            for a, b, held in self.hits(codes, lo, hi):
                a, b, bits = a - int(starts[k]), b - int(starts[k]), bits | held
                spans.append((a, b))
            out[k] = size, spans, bits
        return [(size, merged(spans), [n for i, n in enumerate(self.names) if bits >> i & 1] if bits else []) for size, spans, bits in out]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    found: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if found and a <= found[-1][1]:
            found[-1] = found[-1][0], max(b, found[-1][1])
        else:
            found.append((a, b))
    return found


_BUILT: dict[str, Automaton] = {}


def _automaton(block) -> Automaton:
    """The automaton of a broadcast block, built once in a worker; only the last one is kept."""
    name, shared = block
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Automaton(shared.value)
    return _BUILT[name]


def _shared(spark, block):
    return uuid.uuid4().hex, spark.sparkContext.broadcast(block)


def blocks(items: DataFrame, id_column: str = "item_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str, str]]]:
    """The items, in lists of at most ``block_words`` words; a longer item is cut into overlapping parts of the same id."""
    rows = items.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("t"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = plain_words(row.t)
        parts = [row.t] if len(words) <= block_words else [b" ".join(words[a : a + block_words]).decode() for a in range(0, len(words) - WINDOW + 1, block_words - WINDOW + 1)]
        for part in parts:
            n = min(len(words), block_words)
            if block and size + n > block_words:
                yield block
                block, size = [], 0
            block.append((row.i, part))
            size += n
    yield block


FOUND = "n_words bigint, spans array<struct<a: int, b: int>>, items array<string>"


def matches(documents: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """``id, text, n_words, spans, items`` of every document: hit words as merged spans, and the items they come from."""
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"), F.expr("cast(0 as bigint) n_words"), F.expr("cast(array() as array<struct<a: int, b: int>>) spans"), F.expr("cast(array() as array<string>) items"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, text string, {FOUND}"
    kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def pass_over(block):
        def run(batches: Iterator[pa.RecordBatch]):
            automaton = _automaton(block)
            for batch in batches:
                found = automaton.find(batch.column("text").to_pylist())
                spans, held = [], []
                for (_, new, names), old, before in zip(found, batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                    spans.append([{"a": a, "b": b} for a, b in merged(new + [(s["a"], s["b"]) for s in old])])
                    held.append(sorted({*before, *names}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("text"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, kinds), pa.array(held, pa.list_(pa.string()))],
                    ["id", "text", "n_words", "spans", "items"],
                )

        return run

    for number, block in enumerate(blocks(items, block_words=block_words)):
        rows = checkpointed(rows) if number else rows
        rows = rows.mapInArrow(pass_over(_shared(spark, block)), schema)
    return rows


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of these spans; what stood around them is joined by a line break."""
    words = [m.span() for m in PLAIN_WORD.finditer(text)]
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at : words[a][0]])
        at = words[b - 1][1]
    return "\n".join([*kept, text[at:]])


def decontaminated(documents: DataFrame, items: DataFrame, text_column: str = "text", chars_column: str = "n_chars", max_coverage: float = MAX_COVERAGE, max_hit_words: int = MAX_HIT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without benchmark passages: hit spans are cut out, again if what is left meets in a new hit; documents beyond a limit go.

    With several blocks, the spans of all are found before any is cut, and the documents that were cut pass all blocks again until none hits.
    Columns stay; the length column, if there is one, is set anew where a text was cut. A null text stays null.
    """
    spark, row = documents.sparkSession, fresh(documents, "row")
    rows = documents.select(
        F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias(row), F.col(text_column).cast("string").alias("text"),
        F.expr("cast(null as bigint) all_words"), F.expr("cast(0 as bigint) cut_words"), F.expr("cast(array() as array<struct<a: int, b: int>>) spans"),
    )
    kinds = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def pass_over(block):
        def run(batches: Iterator[pa.RecordBatch]):
            automaton = _automaton(block)
            for batch in batches:
                texts, total, gone = (batch.column(c).to_pylist() for c in ("text", "all_words", "cut_words"))
                todo = range(len(texts))
                while todo:
                    again = []
                    for k, (size, spans, _) in zip(todo, automaton.find([texts[k] for k in todo])):
                        total[k] = size if total[k] is None else total[k]
                        if spans:
                            gone[k] += sum(b - a for a, b in spans)
                            texts[k] = cut(texts[k], spans)
                            again.append(k)
                    todo = again
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), batch.column("spans")], schema=batch.schema)

        return run

    def marked(block):
        """Spans of one more block, the text as it is."""

        def run(batches: Iterator[pa.RecordBatch]):
            automaton = _automaton(block)
            for batch in batches:
                total, spans = batch.column("all_words").to_pylist(), batch.column("spans").to_pylist()
                for k, (size, new, _) in enumerate(automaton.find(batch.column("text").to_pylist())):
                    total[k] = size if total[k] is None else total[k]
                    spans[k] = [{"a": a, "b": b} for a, b in merged(new + [(s["a"], s["b"]) for s in spans[k]])]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("text"), pa.array(total, pa.int64()), batch.column("cut_words"), pa.array(spans, kinds)], schema=batch.schema)

        return run

    def without_spans(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts, gone, spans = (batch.column(c).to_pylist() for c in ("text", "cut_words", "spans"))
            for k, found in enumerate(spans):
                if found:
                    gone[k] += sum(s["b"] - s["a"] for s in found)
                    texts[k] = cut(texts[k], [(s["a"], s["b"]) for s in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column("all_words"), pa.array(gone, pa.int64()), pa.array([[]] * len(texts), kinds)], schema=batch.schema)

    first = list(itertools.islice(blocks(items, block_words=block_words), 2))
    if len(first) == 1:
        rows = rows.mapInArrow(pass_over(_shared(spark, first[0])), rows.schema)
    else:
        schema, todo, done = rows.schema, rows, None
        while True:
            for block in blocks(items, block_words=block_words):
                todo = checkpointed(todo.mapInArrow(marked(_shared(spark, block)), schema))
            settled = todo.where(F.size("spans") == 0)
            done = settled if done is None else done.union(settled)
            hit = todo.where(F.size("spans") > 0)
            if hit.isEmpty():
                break
            todo = hit.mapInArrow(without_spans, schema)
        rows = done
    kept = rows.where((F.col("cut_words") <= max_coverage * F.col("all_words")) & (F.col("cut_words") <= max_hit_words))
    new = {text_column: F.col("text"), chars_column: F.length("text")}
    was_cut = F.col("cut_words") > 0
    columns = []
    for c in documents.columns:
        old = F.col(f"{row}.`{c}`")
        columns.append((F.when(was_cut, new[c].cast(documents.schema[c].dataType)).otherwise(old) if c in new else old).alias(c))
    return kept.select(*columns)


_W = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
SQL = rf"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_W} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS size, unnest(list_transform(range(1, len(w) - least(10, len(w)) + 2), lambda k: array_to_string(w[k:k + least(10, len(w)) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM win),
at AS MATERIALIZED (SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS g FROM (SELECT r, size, w, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)),
hit AS (SELECT r, k, size, item FROM "at" JOIN win USING (size, g)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM hit) GROUP BY r),
hi AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)
""".replace("\nat AS", '\n"at" AS')


@query("op4_decontamination", SQL)
def op4_decontamination(spark, folder):
    """Words of every document that lie in windows of benchmark items."""
    found = matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["b"] - s["a"]).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
