"""Similarity join of documents on word n-grams: token-combination prefixes find candidates, sketches bound them, sets decide.

A document is its set of distinct shingles, the tokens. Two link when ``100 * common >= percent * union``; then at most ``e = n - ceil(percent * n / 100)``
of a set's tokens are missing in the other. Sets are ordered from rare tokens to frequent ones. Tokens fall into classes by their number of documents, and
class ``k`` is indexed by combinations of ``k`` tokens: single ones if rare, pairs and triples if frequent. A prefix is extended until its classes together hold
``e + 1`` tokens, where class ``k`` counts ``k - 1`` fewer than it has: misses cannot spoil all classes then, so linked documents share a combination. A
token that no other set has is a miss for certain; such tokens come first, are never indexed, and count against the budget of every pair.

1. Screening: of each set the tokens of smallest hash, a bit more than ``e``. A set with too few of them in any other set has no link; no more is done about it.
2. Numbers of documents for the tokens of the rest, prefixes and combinations.
3. Candidates, in rounds. First each document with the head of each of its combinations (the set with the fewest tokens of its own), the closest head only; this
   needs no more pairs than index rows, however many documents share a combination. Then, in combinations whose documents are still in several components, the others: pairs of few
   documents by a join, more documents in pairs of blocks inside tasks, at first a forest of the closest, then everything that is left.
4. A pair passes if its sizes and a parity sketch allow it. Every differing token flips one bit, so differing bits never exceed differing tokens: no link is lost. What passes is checked on the sets.

Pairs inside a component that checked links join already are not checked: the components are those of all links.

Edge cases: null and empty texts have no tokens and stand alone; with fewer words than a shingle takes, the whole sequence is the only token. Equal sets are one
node. Repeated rows come back one by one. A null id belongs to its component, whose name is the smallest id that is not null. Long texts are read piece by piece. An empty table gives an empty result. Other columns
do not matter. Tokens are 64-bit hashes, sets are told apart by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.llm.common import query, table
from floodgauge.llm.components import stars
from floodgauge.llm.simhash import _forest
from floodgauge.session import broadcast_if_small, checkpointed, scratch_path

SEED, SHINGLE, PERCENT = 42, 3, 90
#: Sizes of sets from which on classes up to the second number are used; a set near a bound is indexed on both sides of it.
BANDS = ((1, 1), (16, 3), (41, 2), (81, 1))
#: Tokens in at most so many sets are of the first, the second class.
CLASSES = (16, 128)
#: Documents of a combination that are joined pair by pair; beyond that blocks of so many are compared in tasks.
PAIRED, BLOCK = 8, 256
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20


def tokens(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of words ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case."""
    data, at, found, carry = (text or "").encode().lower(), 0, [], []
    blank = data.translate(bytes(0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256)))
    while at < len(blank):
        end = blank.find(b" ", at + PIECE) if at + PIECE < len(blank) else -1
        end = len(blank) if end < 0 else end
        words = carry + blank[at:end].split(b" ")
        words = [w for w in words if w]
        parts = {b" ".join(p) for p in zip(*(words[i:] for i in range(shingle)))}
        found.append(np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts)))
        carry, at = words[-(shingle - 1) :] if shingle > 1 else [], end
    if not any(len(f) for f in found):
        found = [np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], np.uint64)] if carry else []
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def least_common(n, percent: int):
    """Tokens that a linked set shares with a set of ``n`` at least."""
    return -(-percent * n // 100)


def _screened_with(n: int) -> int:
    return max(1, n // 20)


def _hash(values: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(values.tobytes())
    return (whole & (1 << 64) - 1) - (1 << 63), (whole >> 64) - (1 << 63)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _texts(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))


def _screens(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``id, n, h, h2`` of every text and the tokens ``few`` that are looked up first."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            sizes, first, second, few = [], [], [], []
            for text in batch.column("text"):
                found = tokens(text.as_py(), shingle)
                n = len(found)
                h, h2 = _hash(found)
                sizes.append(n)
                first.append(h)
                second.append(h2)
                few.append(found[: n - least_common(n, percent) + _screened_with(n)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int32()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(few, pa.list_(pa.int64()))], ["id", "n", "h", "h2", "few"])

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n int, h bigint, h2 bigint, few array<bigint>")


def _in_others(tokens_of: DataFrame, name: str) -> DataFrame:
    """``node, t, df`` of the tokens that at least two nodes have."""
    shared = stored(tokens_of.groupBy("t").agg(F.count("*").cast("int").alias("df")).where("df > 1"), name)
    return tokens_of.join(broadcast_if_small(shared), "t")


def _open_sets(texts: DataFrame, rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``node, h, h2, n, parts``: sets that may have a link, as far as the screening tells; each set once."""
    nodes = stored(rows.where("n > 0").groupBy("h", "h2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("few").alias("few")).withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    hits = _in_others(nodes.select("node", "n", F.explode("few").alias("t")), "ngram-screen").groupBy("node", "n").count()
    needed = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 20))
    left = stored(nodes.drop("few", "n").join(broadcast_if_small(hits.where(F.col("count") >= needed).select("node")), "node", "left_semi"), "ngram-open")
    ids = broadcast_if_small(left.select(F.col("id").alias("open_id")).distinct())
    again = texts.join(ids, F.col("id").eqNullSafe(F.col("open_id")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for text in batch.column("text"):
                found = tokens(text.as_py(), shingle)
                h, h2 = _hash(found)
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([h2]), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["h", "h2", "parts"])

    found = again.select("text").mapInArrow(run, "h bigint, h2 bigint, parts array<bigint>").join(broadcast_if_small(left), ["h", "h2"])
    found = stored(found.select("node", "h", "h2", "parts", F.monotonically_increasing_id().alias("row")), "ngram-sets")
    # An id that stands for several rows may have brought a set more than once.
    more = found.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1")
    gone = found.select("node", "row").join(broadcast_if_small(more), "node").where("row > first").select("row")
    return found.join(broadcast_if_small(gone), "row", "left_anti").select("node", "h", "h2", F.size("parts").alias("n"), "parts")


def _bands(n: int, percent: int) -> Iterator[tuple[int, int]]:
    """Band and number of classes for the sizes a linked set may have."""
    low, high = least_common(n, percent), 100 * n // percent
    for i, (start, classes) in enumerate(BANDS):
        end = BANDS[i + 1][0] - 1 if i + 1 < len(BANDS) else high
        if start <= high and end >= low:
            # With few tokens, classes would take more than there are.
            yield i, classes if least_common(least_common(start, percent), percent) >= classes * (classes - 1) // 2 + 1 else 1


def combined(parts: np.ndarray, df: np.ndarray, n: int, percent: int) -> list[int]:
    """Hashes of the combinations a set of ``n`` is indexed with; its tokens of other sets are given in order of their number of sets."""
    needed = n - least_common(n, percent) - (n - len(parts)) + 1
    out: set[int] = set()
    for band, classes in _bands(n, percent):
        kind = 1 + np.minimum(np.searchsorted(np.array(CLASSES), df), classes - 1)
        have, counts, end = 0, [0] * (classes + 1), 0
        while have < needed and end < len(parts):
            k = int(kind[end])
            counts[k] += 1
            have += counts[k] >= k
            end += 1
        for k in range(1, classes + 1):
            chosen = [p.tobytes() for p in np.sort(parts[:end][kind[:end] == k])]
            for some in combinations(chosen, k):
                out.add(xxhash.xxh64_intdigest(b"".join(some), 8 * band + k) - (1 << 63))
    return sorted(out)


def sketch(parts: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of tokens fell on each; at least twice as many bits as tokens."""
    bits = 64 << max(0, int(len(parts) - 1).bit_length() - 5)
    odd = np.bincount((parts.view(np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(s: np.ndarray, words: int) -> np.ndarray:
    while s.shape[-1] > words:
        half = s.shape[-1] // 2
        s = s[..., :half] ^ s[..., half:]
    return s


def _allowed(n, m, percent: int):
    """Tokens by which two linked sets of these sizes may differ."""
    return n + m - 2 * -(-percent * (n + m) // (100 + percent))


def _indexed(open_sets: DataFrame, percent: int) -> DataFrame:
    """``node, h, h2, n, own, keys, sketch, parts`` of sets that others share enough tokens of; ``own``: tokens of no other set."""
    shared = _in_others(open_sets.select("node", F.explode("parts").alias("t")), "ngram-tokens")
    lists = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("v"))
    facts = lists.join(open_sets.select("node", "h", "h2", "n"), "node").where(F.size("v") * 100 >= F.col("n") * percent)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in range(batch.num_rows):
                parts, df = (np.asarray(batch.column(c)[r].values) for c in ("t", "df"))
                n = batch.column("n")[r].as_py()
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(r, 1) for c in ("node", "h", "h2", "n")), pa.array([n - len(parts)], pa.int32()),
                    pa.array([combined(parts, df, n, percent)], pa.list_(pa.int64())), pa.array([sketch(parts).tobytes()], pa.binary()), pa.array([parts], pa.list_(pa.int64())),
                ], ["node", "h", "h2", "n", "own", "keys", "sketch", "parts"])

    columns = facts.select("node", "h", "h2", "n", F.col("v.t").alias("t"), F.col("v.df").alias("df"))
    return stored(columns.mapInArrow(run, "node bigint, h bigint, h2 bigint, n int, own int, keys array<bigint>, sketch binary, parts array<bigint>"), "ngram-index")


def _bounded(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """``a, b, gap``: pairs that sizes and sketches allow; ``gap``: tokens by which they differ at least."""
    side = lambda s: index.select(F.col("node").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("n", "own", "sketch")))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent) & (F.col("a_own") + F.col("b_own") <= _allowed_column(F.col("a_n") + F.col("b_n"), percent)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            gaps = []
            for x, y, own in zip(batch.column("a_sketch"), batch.column("b_sketch"), batch.column("own").to_pylist()):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                words = min(len(x), len(y))
                gaps.append(own + int(np.bitwise_count(_folded(x, words) ^ _folded(y, words)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("allowed"), pa.array(gaps, pa.int32())], ["a", "b", "allowed", "gap"])

    rows = both.select("a", "b", (F.col("a_own") + F.col("b_own")).alias("own"), _allowed_column(F.col("a_n") + F.col("b_n"), percent).cast("int").alias("allowed"), "a_sketch", "b_sketch")
    return rows.mapInArrow(run, "a bigint, b bigint, allowed int, gap int").where("gap <= allowed").drop("allowed")


def _allowed_column(total: Column, percent: int) -> Column:
    return total - 2 * F.ceil(total * percent / (100 + percent))


def _linked(pairs: DataFrame, index: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    side = lambda s: index.select(F.col("node").alias(s), F.col("n").alias(f"{s}_n"), F.col("parts").alias(f"{s}_parts"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_parts", "b_parts"))
    return both.where(100 * shared >= percent * (F.col("a_n") + F.col("b_n") - shared)).select("a", "b")


def _labelled(index: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    found = index.select(*columns).join(broadcast_if_small(roots.select(F.col("a").alias("node"), F.col("b").alias("label"))), "node", "left")
    return found.withColumn("label", F.coalesce("label", "node"))


def _tasks(members: DataFrame, counts: DataFrame) -> DataFrame:
    """Members of crowded combinations dealt to pairs of blocks; a component that most members belong to is compared with the others only."""
    of_label = counts.groupBy("key").agg(F.max_by("label", "c").alias("main"), F.max("c").alias("main_c"), F.sum("c").alias("c"))
    facts = of_label.select("key", "main", F.ceil(F.col("main_c") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("c") - F.col("main_c")) / BLOCK).cast("int").alias("others"))
    placed = members.join(broadcast_if_small(stored(facts, "ngram-crowds")), "key")
    is_main = F.col("label") == F.col("main")
    own = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    spot = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = lambda last: F.sequence(F.lit(0), last - 1)
    places = F.when(is_main, F.transform(every(F.col("others")), lambda i: spot("m", i, F.col("own")))).otherwise(F.concat(
        F.transform(every(F.col("mains")), lambda j: spot("m", F.col("own"), j)),
        F.transform(every(F.col("others")), lambda k: spot("o", F.least(k, F.col("own")), F.greatest(k, F.col("own")))),
    ))
    return placed.withColumn("own", own).withColumn("place", F.explode(places)).select("key", "place.*", "node", "label")


def _compared(percent: int, forest: bool):
    """Pairs of a block pair that sizes and sketches allow; a forest of the closest ones only, or all."""

    def run(rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_numpy()
        order = np.argsort(get("node"), kind="stable")
        node, label, n, own = (get(c)[order].astype(np.int64) for c in ("node", "label", "n", "size_own"))
        sketches = [np.frombuffer(rows.column("sketch")[int(i)].as_buffer(), np.uint64) for i in order]
        words = np.array([len(s) for s in sketches])
        level = {w: np.array([_folded(s, w) if len(s) >= w else np.zeros(w, np.uint64) for s in sketches]) for w in np.unique(words)}
        found = [np.zeros((3, 0), np.int64)]
        for i in range(len(node) - 1):
            js = np.arange(i + 1, len(node))
            js = js[(label[js] != label[i]) & (100 * np.minimum(n[js], n[i]) >= percent * np.maximum(n[js], n[i]))]
            allowed = _allowed(n[js], n[i], percent) - own[js] - own[i]
            js, allowed = js[allowed >= 0], allowed[allowed >= 0]
            for w in np.unique(np.minimum(words[js], words[i])):
                some = np.minimum(words[js], words[i]) == w
                gap = np.bitwise_count(level[w][js[some]] ^ level[w][i]).sum(axis=1).astype(np.int64)
                near = gap <= allowed[some]
                hit = js[some][near]
                found.append(np.array([np.full(len(hit), i), hit, gap[near] + own[hit] + own[i]]))
        a, b, gap = np.concatenate(found, axis=1)
        if forest:
            _, first, back = np.unique(label, return_index=True, return_inverse=True)
            chosen = _forest(first[back], a, b, gap)
            a, b = a[chosen], b[chosen]
        return pa.table({"a": pa.array(np.maximum(node[a], node[b])), "b": pa.array(np.minimum(node[a], node[b]))})

    return run


def _rest(index: DataFrame, keys: DataFrame, roots: DataFrame, percent: int, forest: bool, few: bool) -> DataFrame:
    """Candidates among different components: in crowded combinations, and with ``few`` in the others."""
    members = stored(_labelled(keys, roots, ["key", "node"]), "ngram-members")
    counts = members.groupBy("key", "label").agg(F.count("*").alias("c"))
    open_keys = stored(counts.groupBy("key").agg(F.sum("c").alias("size"), F.count("*").alias("labels")).where("labels > 1").select("key", "size"), "ngram-open-keys")
    within = members.join(broadcast_if_small(open_keys), "key")
    crowded = stored(within.where(F.col("size") > PAIRED).select("key", "node", "label"), "ngram-crowded")
    dealt = _tasks(crowded, crowded.groupBy("key", "label").agg(F.count("*").alias("c")))
    dealt = dealt.join(index.select("node", "n", F.col("own").alias("size_own"), "sketch"), "node")
    pairs = dealt.groupBy("key", "kind", "i", "j").applyInArrow(_compared(percent, forest), "a bigint, b bigint")
    if few:
        small = within.where(F.col("size") <= PAIRED)
        x, y = (small.select("key", F.col("node").alias(s), F.col("label").alias(f"{s}_label")) for s in "ab")
        pairs = pairs.union(x.join(y, "key").where("a > b and a_label <> b_label").select("a", "b"))
    return pairs


def _roots(links: DataFrame) -> DataFrame:
    return stored(stars(links), "ngram-roots")


def components(index: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``a, b``: linked nodes, but for the smallest of each component, and that smallest node."""
    every = index.select("node", F.col("n").alias("size"), F.col("own").alias("alone"), F.explode("keys").alias("key"))
    heads = every.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("alone", "size", "node")).alias("head")).where("c > 1")
    heads = stored(heads.select("key", F.col("head.node").alias("head")), "ngram-heads")
    keys = stored(every.select("key", "node").join(broadcast_if_small(heads), "key"), "ngram-keys")
    near = _bounded(keys.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")), index, percent)
    nearest = near.groupBy("a").agg(F.min(F.struct("gap", "b")).alias("m")).select("a", "m.b")
    links = checkpointed(_linked(nearest, index, percent))
    for forest in (True, False):
        roots = _roots(links)
        pairs = _bounded(_rest(index, keys.select("key", "node"), roots, percent, forest, few=forest), index, percent)
        links = links.union(checkpointed(_linked(pairs, index, percent)))
    return _roots(links)


def joined(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, n, component``: size of the set and smallest id that links lead to, for every document."""
    texts = _texts(documents, id_column, text_column)
    rows = stored(_screens(texts, shingle, percent), "ngram-rows")
    index = _indexed(_open_sets(texts, rows, shingle, percent), percent)
    roots = components(index, percent)
    placed = index.select("h", "h2", F.col("node").alias("a")).join(roots, "a", "left").select("h", "h2", F.coalesce("b", "a").alias("root"))
    group = rows.select("id", "n", "h", "h2").join(broadcast_if_small(placed), ["h", "h2"], "left").select(
        "id", "n", F.col("root").isNotNull().alias("g0"), F.coalesce("root", "h").alias("g1"), F.when(F.col("root").isNull(), F.col("h2")).otherwise(0).alias("g2"))
    group = stored(group, "ngram-groups")
    several = stored(group.where("n > 0").groupBy("g0", "g1", "g2").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c"), "ngram-classes")
    return group.join(broadcast_if_small(several), ["g0", "g1", "g2"], "left").select("id", "n", F.when(F.col("n") > 0, F.coalesce("least", "id")).otherwise(F.col("id")).alias("component"))


@query("op11_ngram_join")
def op11_ngram_join(spark, folder):
    """Number of distinct three-word shingles and component under links of Jaccard similarity 0.9 or more, for every document."""
    found = joined(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))
