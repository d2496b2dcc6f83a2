"""Feature selection from grouped statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import _DIGAMMA, _SHIFT, digamma
from floodgauge.operators.ordered import _finite, exact_percentiles, interval_codes
from floodgauge.session import broadcast_if_small, checkpointed, null_safe_join


def anova_scores(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """F statistic per feature, from counts, means and variances per class."""
    per_class = df.groupBy(label).agg(*[
        F.struct(
            F.count(f"`{c}`").alias("n"), F.avg(f"`{c}`").alias("mean"), F.var_pop(f"`{c}`").alias("var")
        ).alias(f"_s{i}")
        for i, c in enumerate(features)
    ])
    rows = per_class.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col(f"_s{i}").alias("s"))
        for i, c in enumerate(features)
    ])))
    sums = rows.groupBy("feature", "position").agg(
        F.count(F.lit(1)).alias("k"), F.sum("s.n").alias("n"),
        (F.sum(F.col("s.n") * F.col("s.mean")) / F.sum("s.n")).alias("grand"),
        F.collect_list("s").alias("classes"),  # one entry per class
    )
    between = F.aggregate(
        "classes", F.lit(0.0), lambda a, s: a + s["n"] * (s["mean"] - F.col("grand")) * (s["mean"] - F.col("grand"))
    )
    within = F.aggregate("classes", F.lit(0.0), lambda a, s: a + s["n"] * s["var"])
    score = (between / (F.col("k") - 1)) / (within / (F.col("n") - F.col("k")))
    return sums.select("feature", "position", F.when((within > 0) & (F.col("k") > 1) & (F.col("n") > F.col("k")), score).otherwise(F.lit(0.0)).alias("score"))


# Fixed value: bins per feature for the mutual information.
BINS = 16


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = BINS) -> DataFrame:
    """Mutual information (nats) between the label and each feature cut at its quantiles."""
    cuts = exact_percentiles(df, {c: [i / bins for i in range(1, bins)] for c in features})
    limits = {c: sorted({v for v in cuts[c].values() if v is not None}) for c in features}
    coded = interval_codes(df.select(F.col(label).alias("_y"), *[F.col(f"`{c}`") for c in features]), limits)
    # A bin is an interval together with its upper limit.
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.floor(F.col(f"_code_{c}") / 2).alias("bin"))
        for i, c in enumerate(features)
    ]
    counts = (
        coded.select("_y", F.inline(F.array(*cells)))
        .filter(F.col("bin").isNotNull())
        .groupBy("feature", "position", "bin", "_y")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # From here on there are at most features x bins x classes rows.
    by_feature, by_bin = W.partitionBy("feature"), W.partitionBy("feature", "bin")
    by_class = W.partitionBy("feature", "_y")
    joint = counts.select(
        "feature", "position", "n", F.sum("n").over(by_feature).alias("total"),
        F.sum("n").over(by_bin).alias("of_bin"), F.sum("n").over(by_class).alias("of_class"),
    )
    term = F.col("n") / F.col("total") * F.log(
        F.col("n") * F.col("total") / (F.col("of_bin").cast("double") * F.col("of_class"))
    )
    return joint.groupBy("feature", "position").agg(F.sum(term).alias("score"))


# Fixed value: neighbours of the estimator.
NEIGHBOURS = 3
# Distances count as equal up to this part of the larger of value and distance, so that rounding does not split ties.
SAME = 1e-12


#: Points of a piece, which one task holds as arrays.
PIECE_POINTS = 250_000
_POINT = "x double, n long"


def _digamma(n: np.ndarray) -> np.ndarray:
    """``digamma`` of an array."""
    x = n.astype(np.float64)
    far = x + _SHIFT
    found = np.log(far) - 0.5 / far
    for power, coefficient in enumerate(_DIGAMMA, 1):
        found += coefficient / far ** (2 * power)
    for j in range(_SHIFT):
        found -= 1.0 / (x + j)
    return found


def _settled(wanted: int):
    """Works on a piece, which holds every point of a range of (feature, value). Gives one row per feature with its bounds and the sum of what is settled, one
    per open point, whose interval may reach out of the piece, and one for each of the first and last ``wanted`` points of a class, which are neighbours of other pieces' points.
    """

    def listed(valid: np.ndarray, x: np.ndarray, n: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(valid.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x[valid]), pa.array(n[valid])], ["x", "n"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        piece = pa.Table.from_batches(held).combine_chunks()
        column = lambda c: piece[c].to_numpy()
        label = piece["label"].combine_chunks()
        label = label.chunk(0) if isinstance(label, pa.ChunkedArray) else label
        codes = label.dictionary_encode(null_encoding="encode").indices.to_numpy()
        order = np.lexsort([column("x"), codes, column("position")])
        position, x, n, of_class, codes = (v[order] for v in (column("position"), column("x"), column("n"), column("of_class"), codes))

        size, k = len(x), wanted
        begins = np.flatnonzero(np.concatenate([[True], (np.diff(position) != 0) | (np.diff(codes) != 0)]))
        lengths = np.diff(begins, append=size)
        place = np.arange(size)
        from_first = place - np.repeat(begins, lengths)
        from_last = np.repeat(lengths, lengths) - from_first - 1
        # Neighbours of the class: k below, nearest first, then k above.
        steps = np.concatenate([-np.arange(1, k + 1), np.arange(1, k + 1)])
        valid = np.concatenate([from_first[:, None] >= np.arange(1, k + 1), from_last[:, None] >= np.arange(1, k + 1)], axis=1)
        other = np.where(valid, place[:, None] + steps, 0)
        far = np.where(valid, np.abs(x[other] - x[:, None]), np.inf)
        near = np.argsort(far, axis=1, kind="stable")
        have = np.concatenate([np.zeros((size, 1), np.int64), np.cumsum(np.take_along_axis(np.where(valid, n[other], 0), near, axis=1), axis=1)], axis=1)
        reached = have + (n - 1)[:, None] >= np.minimum(k, of_class - 1)[:, None]
        steps_far = np.concatenate([np.zeros((size, 1)), np.take_along_axis(far, near, axis=1)], axis=1)
        d = np.where(reached.any(axis=1), steps_far[place, reached.argmax(axis=1)], np.inf)
        with np.errstate(invalid="ignore"):
            wider = lambda r: np.where(r > 0, r + SAME * np.maximum(np.abs(x), r), 0.0)
            radius = wider(d)
            outer = wider(radius)
        inside = n - 1 + np.where(valid & (far <= radius[:, None]), n[other], 0).sum(axis=1)

        by_value = np.lexsort([x, position])
        names, firsts = np.unique(position[by_value], return_index=True)
        values, running = x[by_value], np.concatenate([[0], np.cumsum(n[by_value])])
        ends = [*firsts[1:].tolist(), size]
        # Only the first feature can go on below the piece, and only the last one above it.
        is_open = ((position == names[0]) & (x - outer < values[0])) | ((position == names[-1]) & (x + outer > values[-1]))
        sums, rows = [], []
        for p, a, b in zip(names.tolist(), firsts.tolist(), ends):
            mine = np.flatnonzero((position == p) & ~is_open)
            here = values[a:b]
            of_all = running[a + np.searchsorted(here, x[mine] + radius[mine], "right")] - running[a + np.searchsorted(here, x[mine] - radius[mine], "left")] - 1
            sums.append(float((n[mine] * (_digamma(inside[mine]) - _digamma(of_class[mine]) - _digamma(of_all))).sum()))
            rows.append(int(running[b] - running[a]))
        slot = int(held[0].column("_slot")[0].as_py())

        def batch(kind: str, count: int, **given) -> pa.RecordBatch:
            types = {
                "kind": pa.string(), "slot": pa.int32(), "position": pa.int32(), "label": label.type, "x": pa.float64(), "n": pa.int64(), "of_class": pa.int64(),
                "is_open": pa.bool_(), "from_first": pa.int32(), "from_last": pa.int32(), "lower": points, "upper": points, "high": pa.float64(), "settled": pa.float64(),
            }
            given |= {"kind": [kind] * count, "slot": [slot] * count}
            columns = [given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(count, t) for c, t in types.items()]
            return pa.RecordBatch.from_arrays(columns, names=list(types))

        points = pa.list_(pa.struct([("x", pa.float64()), ("n", pa.int64())]))
        yield batch("piece", len(names), position=names, x=values[firsts], high=values[np.array(ends) - 1], n=rows, settled=sums)
        told = np.flatnonzero(is_open | (from_first < k) | (from_last < k))
        for these in np.array_split(told, len(told) // 10_000 + 1):
            if len(these):
                sides = [listed(valid[these][:, s], x[other[these][:, s]], n[other[these][:, s]]) for s in (slice(0, k), slice(k, 2 * k))]
                yield batch(
                    "point", len(these), position=position[these], label=label.take(pa.array(order[these])), x=x[these], n=n[these], of_class=of_class[these],
                    is_open=is_open[these], from_first=from_first[these] + 1, from_last=from_last[these] + 1, lower=sides[0], upper=sides[1],
                )

    return run


def _beside(told: DataFrame, k: int) -> DataFrame:
    """The open points, with ``lower`` and ``upper`` completed: the ``k`` next smaller and larger values of the same feature and class, with their counts.

    The first and last ``k`` points of each piece find their neighbours among those points of all pieces, at most 2 k a class and piece; the others have theirs in the piece.
    """
    at_edge = (F.col("from_first") <= k) | (F.col("from_last") <= k)
    order = W.partitionBy("position", "label").orderBy("x")
    before, after = (
        F.array_compact(F.array(*[step(F.struct("x", "n"), i).over(order) for i in range(1, k + 1)])) for step in (F.lag, F.lead)
    )
    edges = told.filter(at_edge).withColumns({"_before": before, "_after": after}).withColumns({
        "lower": F.when(F.col("from_first") <= k, F.col("_before")).otherwise(F.col("lower")),
        "upper": F.when(F.col("from_last") <= k, F.col("_after")).otherwise(F.col("upper")),
    })
    return told.filter(~at_edge).unionByName(edges.select(*told.columns)).filter("is_open")


def _located(pieces: list[Row]):
    """Adds to each end of an interval the piece that it lies in, if any, and the number of rows of the pieces below it."""
    by_position: dict[int, list[Row]] = {}
    for r in sorted(pieces, key=lambda r: (r["position"], r["x"])):
        by_position.setdefault(r["position"], []).append(r)
    known = {p: tuple(np.array([r[c] for r in rs]) for c in ("x", "high", "n", "slot")) for p, rs in by_position.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            position, value = (batch.column(c).to_numpy() for c in ("position", "value"))
            below, slot = np.zeros(len(value), np.int64), np.full(len(value), -1, np.int32)
            for p in np.unique(position).tolist():
                mine = np.flatnonzero(position == p)
                low, high, rows, slots = known[p]
                ended = np.searchsorted(high, value[mine], "left")  # pieces that end below the value
                below[mine] = np.concatenate([[0], np.cumsum(rows)])[ended]
                holds = np.minimum(ended, len(low) - 1)
                slot[mine] = np.where((ended < len(low)) & (low[holds] <= value[mine]), slots[holds], -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(below), pa.array(slot)], names=[*batch.schema.names, "below", "slot"])

    return run


def _counted(asked: pa.Table, points: pa.Table) -> pa.Table:
    """Adds to ``below`` the rows of the piece that lie below an end."""
    position, x, n = (points[c].to_numpy() for c in ("position", "x", "n"))
    order = np.lexsort([x, position])
    position, x, running = position[order], x[order], np.concatenate([[0], np.cumsum(n[order])])
    at, value, upper, below = (asked[c].to_numpy() for c in ("position", "value", "is_upper", "below"))
    below = below.copy()
    for p in np.unique(at).tolist():
        a, b = np.searchsorted(position, p, "left"), np.searchsorted(position, p, "right")
        for side, name in ((False, "left"), (True, "right")):
            mine = np.flatnonzero((at == p) & (upper == side))
            below[mine] += running[a + np.searchsorted(x[a:b], value[mine], name)] - running[a]
    return asked.set_column(asked.schema.get_field_index("below"), "below", pa.array(below))


def neighbour_information(df: DataFrame, features: Sequence[str], label: str, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Mutual information (nats) between the label and each feature by distances to nearest neighbours, at least 0.

    For each row, the distance to its ``neighbours``-th neighbour of the same class (fewer in a smaller class) spans an interval; how many rows of the class and of all classes
    lie in it tells how much the value says about the class. Rows at the same distance all count, so repeated values have a defined result (without
    ties it is the usual estimate). Missing and infinite values are left out, and classes of a single row; a missing label is a class. A feature with nothing left scores 0.

    Work is done per distinct value and class: ranges of values are cut into pieces, which settle the points whose interval lies in them. For the others the
    neighbours come from the ends of all pieces, and what lies in an interval is a difference of two running totals. No pairs are formed.
    """
    spark = df.sparkSession
    cells = [F.struct(F.lit(i).alias("position"), (_finite(c) + 0.0).alias("x")) for i, c in enumerate(features)]
    named = df.select(F.col(label).alias("label"), F.inline(F.array(*cells)))
    counts = checkpointed(named.filter(F.col("x").isNotNull()).groupBy("position", "label", "x").agg(F.count(F.lit(1)).alias("n")))
    classes = counts.groupBy("position", "label").agg(F.sum("n").alias("of_class")).filter("of_class > 1")
    points = null_safe_join(counts, broadcast_if_small(classes), ["position", "label"])
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counts.count() // PIECE_POINTS))
    # The checkpoint pins the pieces, which are read twice.
    placed = checkpointed(points.repartitionByRange(slots, "position", "x").withColumn("_slot", F.spark_partition_id()))
    kind = df.schema[label].dataType.simpleString()
    told = checkpointed(placed.mapInArrow(_settled(neighbours), (
        f"kind string, slot int, position int, label {kind}, {_POINT}, of_class long, is_open boolean, from_first int, from_last int, "
        f"lower array<struct<{_POINT}>>, upper array<struct<{_POINT}>>, high double, settled double")))

    wanted = F.least(F.lit(neighbours), F.col("of_class") - 1)
    others = F.col("n") - 1
    distances = F.array_sort(F.concat(
        F.transform("lower", lambda u: F.struct((F.col("x") - u["x"]).alias("d"), u["n"].alias("n"))),
        F.transform("upper", lambda u: F.struct((u["x"] - F.col("x")).alias("d"), u["n"].alias("n"))),
    ))
    reached = F.aggregate(
        F.col("near"), F.struct(others.alias("have"), F.lit(0.0).alias("d")),
        lambda a, e: F.when(a["have"] >= F.col("wanted"), a).otherwise(F.struct((a["have"] + e["n"]).alias("have"), e["d"].alias("d"))),
    )["d"]
    radius = F.when(F.col("d") > 0, F.col("d") + SAME * F.greatest(F.abs("x"), F.col("d"))).otherwise(F.lit(0.0))
    inside = F.aggregate("near", others, lambda a, e: a + F.when(e["d"] <= F.col("radius"), e["n"]).otherwise(F.lit(0).cast("long")))
    balls = (
        _beside(told.filter("kind = 'point'"), neighbours).withColumns({"near": distances, "wanted": wanted}).withColumn("d", reached).withColumn("radius", radius)
        .select("position", "label", "x", "radius", "n", "of_class", inside.alias("inside"))
    )
    # Running totals at both ends of every interval that is left: of the rows below its lower end, and up to its upper end.
    ends = F.array(*[F.struct((F.col("x") + sign * F.col("radius")).alias("value"), F.lit(sign > 0).alias("is_upper")) for sign in (-1, 1)])
    asked = balls.select("position", "label", "x", "n", "of_class", "inside", F.inline(ends))
    pieces = told.filter("kind = 'piece'")
    # One row per piece and feature, as many as a range partitioner has bounds.
    bounds = pieces.select("position", "slot", "x", "high", "n").collect()
    schema = f"position int, label {kind}, {_POINT}, of_class long, inside long, value double, is_upper boolean, below long, slot int"
    asked = checkpointed(asked.mapInArrow(_located(bounds), schema))
    in_pieces = asked.filter("slot >= 0").groupBy("slot").cogroup(placed.select(F.col("_slot").alias("slot"), "position", "x", "n").groupBy("slot"))
    totals = in_pieces.applyInArrow(_counted, schema).unionByName(asked.filter("slot < 0"))
    signed = F.when(F.col("is_upper"), F.col("below")).otherwise(-F.col("below"))
    found = totals.groupBy("position", "label", "x", "n", "of_class", "inside").agg((F.sum(signed) - 1).alias("of_all"))
    term = digamma(F.col("inside")) - digamma(F.col("of_class")) - digamma(F.col("of_all"))
    size = F.sum("n")
    parts = pieces.select("position", "n", "settled").unionByName(found.select("position", F.lit(0).cast("long").alias("n"), (F.col("n") * term).alias("settled")))
    scores = parts.groupBy("position").agg((digamma(size) + F.sum("settled") / size).alias("score"))
    names = spark.createDataFrame([(c, i) for i, c in enumerate(features)], "feature string, position int")
    return names.join(scores, "position", "left").select("feature", "position", F.greatest(F.lit(0.0), F.coalesce("score", F.lit(0.0))).alias("score"))


def top_features(scores: DataFrame, k: int) -> DataFrame:
    """The k best features; of equals the one that comes first in the table."""
    return scores.orderBy(F.col("score").desc(), "position").limit(k)


def select_by_anova(df: DataFrame, features: Sequence[str], label: str, k: int) -> list[str]:
    """Names of the k best features, in table order."""
    best = {r["feature"] for r in top_features(anova_scores(df, features, label), k).collect()}
    return [c for c in features if c in best]


def select_by_both(df: DataFrame, features: Sequence[str], label: str, k: int, information=mutual_information) -> list[str]:
    """Union of the k best by F and the k best by mutual information, then the first k in table order.

    ``information`` is ``mutual_information`` (one pass over quantile bins) or ``neighbour_information``.
    """
    best = set(select_by_anova(df, features, label, k))
    best |= {r["feature"] for r in top_features(information(df, features, label), k).collect()}
    return [c for c in features if c in best][:k]
