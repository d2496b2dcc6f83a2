"""SimHash fingerprints and their links, found by a self-join of binary tries.

A fingerprint's bit is set if more than half of its shingles' hashes have it set. To find all pairs that differ in few
bits, the fingerprint is rotated so that each of its blocks comes first once: of two fingerprints within the budget, one
block differs in no more than budget / blocks bits. For each rotation, pairs of trie nodes are traversed together:
the differing bits of their prefixes add up, and a pair is left as soon as they exceed the budget.

The upper levels are walked with joins: a *unit* is a pair of nodes, and a unit with too many rows is replaced by the
pairs of its children that are within the budget, until all units are small. So a third of all rows under one node is
spread over many tasks. The lower levels are walked inside the tasks, on sorted arrays, and a task hands
on no more links than it has rows: those of a spanning forest of what it found.

Edge cases: a null or empty text has no words and the fingerprint 0, and is linked like any other. With fewer words than a shingle takes, the
whole sequence is the only shingle. Equal fingerprints count as one node. Repeated rows come back one by one; rows with a null
id belong to their component, whose id is the smallest id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import fresh, query, spaced_words, table
from floodgauge.llm.components import stars
from floodgauge.session import broadcast_if_small, checkpointed, scratch_path

SEED = 42
#: A unit with more rows than this is replaced by units of its children, this many bits further down.
UNIT_ROWS, STEP_BITS = 131_072, 3
#: Pairs of nodes that a task holds at a time, and pairs of rows below which they are compared at once.
FRONT, LEAF = 400_000, 48


def fingerprint(words: list[bytes], shingle: int, seeds: tuple[int, ...] = (SEED,)) -> list[int]:
    """One 64-bit fingerprint for each seed, as signed integers; repeated shingles count as often as they occur."""
    if not words:
        return [0] * len(seeds)
    parts = [b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)))] or [b" ".join(words)]
    out = []
    for seed in seeds:
        hashes = np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in parts), np.uint64, len(parts))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):
            ones += np.unpackbits(hashes[at : at + 65_536].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0]))
    return out


def fingerprints(documents: DataFrame, shingle: int = 3, id_column: str = "doc_id", text_column: str = "text", seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """``id`` and one column ``f0``, ``f1``, ... for each seed."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [fingerprint(spaced_words(t.as_py()), shingle, seeds) for t in batch.column("text")]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(len(seeds))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", *(f"f{i}" for i in range(len(seeds)))])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"id {kind}", *(f"f{i} bigint" for i in range(len(seeds)))]))


def _masks(bits: int, ones: int) -> list[int]:
    """Numbers of so many bits with at most ``ones`` of them set."""
    found = {0}
    for _ in range(ones):
        found |= {m | 1 << i for m in found for i in range(bits)}
    return sorted(found)


def _refined(units: DataFrame, depth: int, bits: int, budget: int) -> DataFrame:
    """Each row moved into the units of pairs of children: its own child and every one that is still within the budget."""
    own, other = F.when(F.col("side") == 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("side") == 0, F.col("q")).otherwise(F.col("p"))
    spent = F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
    next_bits = F.shiftrightunsigned(F.shiftleft("code", depth), 64 - bits)
    if budget == 0:
        flips = F.array(F.lit(0).cast("long"))
    else:
        flips = F.filter(F.array(*(F.lit(m).cast("long") for m in _masks(bits, budget))), lambda m: F.bit_count(m) + F.col("spent") <= budget)
    more = [c for c in ("label",) if c in units.columns]
    grown = units.select("turn", "code", *more, own.alias("own"), other.alias("other"), spent.alias("spent"), next_bits.alias("next"))
    each = grown.withColumn("flip", F.explode(flips)).withColumns({
        "own": F.shiftleft("own", bits).bitwiseOR(F.col("next")),
        "other": F.shiftleft("other", bits).bitwiseOR(F.col("next").bitwiseXOR(F.col("flip"))),
    })
    return each.select(
        "turn", F.lit(depth + bits).alias("depth"), F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "code", *more,
    )


def _rotated(code: Column, by: int) -> Column:
    return code if by == 0 else F.shiftleft(code, by).bitwiseOR(F.shiftrightunsigned(code, 64 - by))


def units(nodes: DataFrame, budget: int, blocks: int, unit_rows: int = UNIT_ROWS, start_bits: int | None = None) -> DataFrame:
    """Units of at most ``unit_rows`` rows that together hold every pair within the budget; ``nodes``: distinct fingerprints ``f0``, and perhaps a ``label``."""
    more = [c for c in ("label",) if c in nodes.columns]
    few = nodes.limit(unit_rows + 1).count() <= unit_rows  # no unit has more rows than there are nodes
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    first_budget = budget // blocks
    parts = []
    for turn in range(blocks):
        width = cuts[turn + 1] - cuts[turn]
        root = nodes.select(
            F.lit(turn).alias("turn"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"), F.lit(0).alias("side"),
            _rotated(F.col("f0"), cuts[turn]).alias("code"), *more,
        )
        parts.append(_refined(root, 0, min(width, start_bits or width), first_budget))
    ready = []
    for turn, warm in enumerate(parts):
        width, depth = cuts[turn + 1] - cuts[turn], min(cuts[turn + 1] - cuts[turn], start_bits or 64)
        while not few:
            hot = checkpointed(warm.groupBy("p", "q").count().where(F.col("count") > unit_rows).select("p", "q"))
            if depth >= 58 or hot.isEmpty():
                break
            hot = broadcast_if_small(hot)
            ready.append(warm.join(hot, ["p", "q"], "left_anti"))
            bits = min(STEP_BITS, width - depth) if depth < width else STEP_BITS
            warm = _refined(warm.join(hot, ["p", "q"], "left_semi"), depth, bits, first_budget if depth < width else budget)
            depth += bits
        ready.append(warm)
    columns = ["turn", "depth", "p", "q", "side", "code", *more]
    all_units = ready[0].select(columns)
    for more in ready[1:]:
        all_units = all_units.union(more.select(columns))
    return all_units


def _forest(home: np.ndarray, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links that make a spanning forest, those of fewer differing bits first; rows with the same home are joined already."""
    parent, chosen = home.copy(), []
    for level in np.unique(d):
        left = np.flatnonzero(d == level)
        while True:
            x, y = parent[a[left]], parent[b[left]]
            left, x, y = (v[x != y] for v in (left, x, y))
            if not len(left):
                break
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.concatenate([[True], high[order][1:] != high[order][:-1]])]
            parent[high[first]] = low[first]
            chosen.append(left[first])
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def _homes(n: int, label: pa.ChunkedArray | None) -> np.ndarray:
    """For each row the first one with the same label; a row without label is on its own."""
    home = np.arange(n)
    if label is not None:
        own = label.is_valid().to_numpy()
        values = pc.fill_null(label, 0).to_numpy()[own]
        _, first, back = np.unique(values, return_index=True, return_inverse=True)
        home[own] = np.flatnonzero(own)[first[back]]
    return home


class _Walk:
    """Joint traversal of the pairs of nodes in one task; rows are sorted by unit, side and code.

    Found are links between rows of different homes: so many forests without a common link, or all links if ``forests`` is None.
    """

    def __init__(self, code: np.ndarray, home: np.ndarray, budget: int, first_bits: int, first_budget: int, forests: int | None = 1):
        self.code, self.home, self.forests, self.budget, self.set_bits = code, home, forests, budget, {}
        self.first_bits, self.first_budget = first_bits, first_budget
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def ones_before(self, depth: int) -> np.ndarray:
        """Number of rows before each place whose bit at this depth is set."""
        if depth not in self.set_bits:
            bit = (self.code >> np.uint64(63 - depth)) & np.uint64(1)
            self.set_bits[depth] = np.concatenate([[0], np.cumsum(bit.astype(np.int32))])
        return self.set_bits[depth]

    def compare(self, a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of small pairs of nodes, one with the other; links are handed on as soon as they are many and all are wanted."""
        each = an * bn
        for at in range(0, len(each), FRONT // LEAF):
            s = slice(at, at + FRONT // LEAF)
            n = each[s]
            pair = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = a[s][pair] + k // bn[s][pair], b[s][pair] + k % bn[s][pair]
            differ = np.bitwise_count(self.code[x] ^ self.code[y])
            ok = (self.home[x] != self.home[y]) & (differ <= self.budget)
            self.found.append((x[ok], y[ok], differ[ok]))
            self.pending += int(ok.sum())
            if self.pending > FRONT:
                yield from self.reduce()

    def reduce(self, last: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links so far, cut down to the forests or handed on."""
        a, b, d = (np.concatenate(x) for x in zip(*self.found)) if self.found else (np.zeros(0, np.int64),) * 3
        if self.forests is None:
            self.found, self.pending = [], 0
            yield a, b
            return
        kept, left = [np.zeros(0, np.int64)], np.arange(len(a))
        for _ in range(self.forests):
            chosen = _forest(self.home, a[left], b[left], d[left])
            if not len(chosen):
                break
            kept.append(left[chosen])
            left = np.delete(left, chosen)
        kept = np.concatenate(kept)
        self.found, self.pending = [(a[kept], b[kept], d[kept])], 0
        if last:
            yield a[kept], b[kept]

    def run(self, lo_a, hi_a, lo_b, hi_b, depth, spent) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        stack = [(d, *(x[depth == d] for x in (lo_a, hi_a, lo_b, hi_b, spent))) for d in np.unique(depth)]
        while stack:
            d, la, ha, lb, hb, err = stack.pop()
            if len(la) > FRONT:
                half = len(la) // 2
                stack += [(d, la[:half], ha[:half], lb[:half], hb[:half], err[:half]), (d, la[half:], ha[half:], lb[half:], hb[half:], err[half:])]
                continue
            small = (ha - la) * (hb - lb) <= LEAF
            if d >= 64:
                small[:] = True
            if small.any():
                yield from self.compare(la[small], (ha - la)[small], lb[small], (hb - lb)[small])
                la, ha, lb, hb, err = (x[~small] for x in (la, ha, lb, hb, err))
            if not len(la):
                continue
            before = self.ones_before(int(d))
            ma, mb = ha - (before[ha] - before[la]), hb - (before[hb] - before[lb])
            self_pair = (la == lb) & (ha == hb)
            whole = ~self_pair
            children = [
                (la, ma, lb, mb, err), (ma, ha, mb, hb, err), (la, ma, mb, hb, err + 1),
                (ma[whole], ha[whole], lb[whole], mb[whole], err[whole] + 1),
            ]
            joined = [np.concatenate(x) for x in zip(*children)]
            within = self.first_budget if d < self.first_bits else self.budget
            alive = (joined[1] > joined[0]) & (joined[3] > joined[2]) & (joined[4] <= within)
            stack.append((d + 1, *(x[alive] for x in joined)))
        yield from self.reduce(last=True)


def _task_links(budget: int, blocks: int, forests: int | None = 1):
    by = np.array([64 * i // blocks for i in range(blocks)], np.uint64)

    def of(code, home, unit_columns, side):
        """Links inside whole units, as pairs of rows."""
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in unit_columns], axis=0)) + 1
        lo = np.concatenate([[0], change])
        hi = np.concatenate([change, [len(code)]])
        sides = np.concatenate([[0], np.cumsum(side)])
        mid = hi - (sides[hi] - sides[lo])  # rows of the first side come first
        _, depth, p, q = (c[lo] for c in unit_columns)
        same = p == q
        a_lo, a_hi, b_lo, b_hi = lo, np.where(same, hi, mid), np.where(same, lo, mid), hi
        alive = (a_hi > a_lo) & (b_hi > b_lo) & ~(same & (hi - lo < 2))
        spent = np.bitwise_count(p ^ q).astype(np.int64)
        return _Walk(code, home, budget, 64 // blocks, budget // blocks, forests).run(*(x[alive] for x in (a_lo, a_hi, b_lo, b_hi, depth, spent)))

    def run(batches: Iterator[pa.RecordBatch]):
        kept: pa.Table | None = None

        def links(rows: pa.Table):
            names = ("turn", "depth", "p", "q")
            get = lambda n: rows.column(n).to_numpy().astype(np.int64, copy=False)
            code = get("code").view(np.uint64)
            back = by[get("turn")]
            f0 = ((code >> back) | (code << ((np.uint64(64) - back) % np.uint64(64)))).view(np.int64)
            home = _homes(len(code), rows.column("label") if "label" in rows.column_names else None)
            for a, b in of(code, home, [get(n) for n in names], get("side")):
                yield pa.RecordBatch.from_arrays([pa.array(f0[a]), pa.array(f0[b])], ["a", "b"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            last = [rows.column(n)[-1].as_py() for n in ("turn", "depth", "p", "q")]
            same = np.all([rows.column(n).to_numpy() == v for n, v in zip(("turn", "depth", "p", "q"), last)], axis=0)
            cut = int(len(same) - same.sum())  # the last unit may go on
            if cut:
                yield from links(rows.slice(0, cut))
            kept = rows.slice(cut)
        if kept is not None and kept.num_rows:
            yield from links(kept)

    return run


def links(nodes: DataFrame, budget: int = 2, blocks: int = 3, unit_rows: int = UNIT_ROWS, start_bits: int | None = None, forests: int | None = 1) -> DataFrame:
    """``a, b``: links that connect all fingerprints within ``budget`` differing bits of each other. ``nodes`` has distinct ``f0``.

    With a column ``label``, nodes of the same label count as connected, and those without one as on their own. ``forests``: so many
    forests of links in each unit, or every link if None.
    """
    found = units(nodes, budget, blocks, unit_rows, start_bits)
    sorted_units = found.repartition("turn", "p", "q").sortWithinPartitions("turn", "depth", "p", "q", "side", "code")
    return sorted_units.mapInArrow(_task_links(budget, blocks, forests), "a bigint, b bigint")


def near_duplicates(documents: DataFrame, shingle: int = 3, budget: int = 2, id_column: str = "doc_id", text_column: str = "text", blocks: int = 3) -> DataFrame:
    """``id, f0, component``: the fingerprint of every row, and the smallest id that links lead to."""
    rows = checkpointed(fingerprints(documents, shingle, id_column, text_column))
    nodes = checkpointed(rows.groupBy("f0").agg(F.min("id").alias("first")))
    roots = stars(links(nodes.select("f0"), budget, blocks))
    placed = nodes.join(roots.select(F.col("a").alias("f0"), "b"), "f0", "left").select("f0", "first", F.coalesce("b", "f0").alias("root"))
    named = placed.groupBy("root").agg(F.min("first").alias("component"))
    return rows.join(placed.join(named, "root").select("f0", "component"), "f0")


def one_of_each(documents: DataFrame, shingle: int = 3, budget: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One document of each component of ``near_duplicates``: the row with the smallest id stays (without an id: last), columns as they were.

    The rows are written once with a number, so that the decision is about the same rows whatever is computed anew.
    """
    key = fresh(documents, "key")
    path = scratch_path(documents.sparkSession, "one-of-each")
    documents.withColumn(key, F.monotonically_increasing_id()).write.parquet(path)
    rows = documents.sparkSession.read.schema(documents.withColumn(key, F.lit(0).cast("long")).schema).parquet(path)
    placed = near_duplicates(rows, shingle, budget, key, text_column).select(F.col("id").alias("key"), F.col("component").alias("group"))
    several = checkpointed(placed.groupBy("group").count().where("count > 1").select("group"))
    order = F.struct(F.col(id_column).isNull().alias("n"), F.col(id_column).alias("i"), F.col(key).alias("k"))
    members = placed.join(broadcast_if_small(several), "group", "left_semi").join(rows.select(F.col(key).alias("key"), order.alias("o")), "key")
    first = members.groupBy("group").agg(F.min("o").alias("o")).select("group", F.col("o.k").alias("first"))
    gone = members.join(broadcast_if_small(checkpointed(first)), "group").where("key <> first").select(F.col("key").alias(key))
    return rows.join(broadcast_if_small(checkpointed(gone)), key, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))


@query("op3_simhash")
def op3_simhash(spark, folder):
    """Fingerprint over three-word shingles and component under links of at most two differing bits, for every document."""
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
