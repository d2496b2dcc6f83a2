"""Order-dependent building blocks that never put one hot group into one task.

* ``exact_percentiles``: interpolated percentiles of whole columns in a few aggregate passes.
* ``cumulate_by_value``: running totals in value order, split over range partitions.
* ``with_neighbours``: previous and next row of a key, split over time chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import epoch_micros
from floodgauge.session import broadcast_if_small, checkpointed, null_safe_join

# Up to this many values of one bracket are listed and ranked directly.
EXACT_LIMIT = 100_000
SKETCH_ACCURACY = 10_000
# Points of the sketches of single intervals.
GRID = 1_000
CHUNK_SECONDS = 60
ROWS_PER_CHUNK = 1_000_000


def _number(c: str) -> Column:
    value = F.col(f"`{c}`").cast("double")
    return F.when(~F.isnan(value), value)


def _finite(c: str) -> Column:
    value = _number(c)
    return F.when(F.abs(value) < F.lit(math.inf), value)


def exact_percentiles(
    df: DataFrame,
    requests: dict[str, Sequence[float]],
    exact_limit: int = EXACT_LIMIT,
    accuracy: int = SKETCH_ACCURACY,
) -> dict[str, dict[float, float | None]]:
    """Percentiles with linear interpolation, missing values ignored. Infinite values rank at the ends and are only counted.

    Every pass is one aggregate over the table that needs bounded memory per task: quantile
    sketches give values that enclose the wanted ranks, the next pass counts what lies between and
    on them, and so on until the values left in an interval are few enough to be listed.
    """
    names = list(requests)
    step = 2.0 / accuracy
    first = []
    for i, c in enumerate(names):
        around = [min(1.0, max(0.0, p + d)) for p in requests[c] for d in (-step, step)]
        first += [
            F.count(_finite(c)).alias(f"n{i}"), F.percentile_approx(_finite(c), around, accuracy).alias(f"q{i}"),
            F.count_if(_number(c) == -math.inf).alias(f"l{i}"), F.count_if(_number(c) == math.inf).alias(f"h{i}"),
        ]
    row = df.agg(*first).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(names)}
    lowest = {c: row[f"l{i}"] for i, c in enumerate(names)}
    totals = {c: sizes[c] + lowest[c] + row[f"h{i}"] for i, c in enumerate(names)}
    position = {(c, p): (totals[c] - 1) * p for c in names for p in requests[c] if totals[c]}
    ranks: dict[str, set[int]] = {c: set() for c in names}
    for (c, _), place in position.items():
        ranks[c] |= {r - lowest[c] for r in (math.floor(place), math.ceil(place)) if 0 <= r - lowest[c] < sizes[c]}
    limits = {
        c: sorted(set(row[f"q{i}"])) if sizes[c] > exact_limit else [] for i, c in enumerate(names) if sizes[c]
    }
    values = _values_at(df, {c: r for c, r in ranks.items() if r}, limits, sizes, exact_limit, accuracy)

    def value(c: str, rank: int) -> float:
        rank -= lowest[c]
        return -math.inf if rank < 0 else math.inf if rank >= sizes[c] else values[(c, rank)]

    result: dict[str, dict[float, float | None]] = {c: dict.fromkeys(requests[c]) for c in names}
    for (c, p), place in position.items():
        low, high, share = value(c, math.floor(place)), value(c, math.ceil(place)), place - math.floor(place)
        if low == high or share == 0:
            result[c][p] = low
        elif math.isinf(low) or math.isinf(high):
            result[c][p] = low * (1 - share) + high * share
        else:
            result[c][p] = low + (high - low) * share
    return result


def interval_codes(df: DataFrame, limits: dict[str, list[float]], prefix: str = "_code_") -> DataFrame:
    """Adds ``{prefix}{c}``: the place of a number among the sorted limits of its column.

    Code ``2 i`` is the open interval below ``limits[i]``, code ``2 i + 1`` the limit itself. The
    limits are searched by bisection in the JVM.
    """
    cut = [c for c in limits if limits[c]]
    out = df.withColumns({f"{prefix}{c}": F.when(_number(c).isNotNull(), F.lit(0)) for c in limits if c not in cut})
    if not cut:
        return out
    out = out.withColumns({f"_x_{c}": F.coalesce(_number(c), F.lit(0.0)) for c in cut})
    search = Bucketizer(
        splitsArray=[[-math.inf, *limits[c], math.inf] for c in cut],
        inputCols=[f"_x_{c}" for c in cut], outputCols=[f"_i_{c}" for c in cut],
    )
    codes = {}
    for c in cut:
        place = F.col(f"_i_{c}").cast("int")
        known = F.array(*[F.lit(v) for v in limits[c]])
        on_limit = (place > 0) & (F.col(f"_x_{c}") == F.element_at(known, F.greatest(place, F.lit(1))))
        codes[f"{prefix}{c}"] = F.when(_number(c).isNotNull(), 2 * place - on_limit.cast("int"))
    return search.transform(out).withColumns(codes).drop(*[f"{t}{c}" for c in cut for t in ("_x_", "_i_")])


def _placed(df: DataFrame, limits: dict[str, list[float]]) -> DataFrame:
    """Rows (column number, interval code, value), one per row and column with a value."""
    coded = interval_codes(df.select(*[_finite(c).alias(c) for c in limits]), limits)
    cells = [
        F.struct(F.lit(i).alias("c"), F.col(f"_code_{c}").alias("b"), F.col(f"`{c}`").alias("v"))
        for i, c in enumerate(limits)
    ]
    return coded.select(F.inline(F.array(*cells))).filter(F.col("b").isNotNull())


def _values_at(df, ranks, limits, sizes, exact_limit, accuracy) -> dict[tuple[str, int], float]:
    """Value at every wanted rank (from 0) of every column."""
    found: dict[tuple[str, int], float] = {}
    open_ranks = {c: set(r) for c, r in ranks.items()}
    grid = [i / GRID for i in range(GRID + 1)]
    while open_ranks:
        limits = {c: limits[c] for c in open_ranks}
        order = list(limits)
        counts = {(i, 0): sizes[c] for i, c in enumerate(order) if not limits[c]}
        if any(limits.values()):
            for r in _placed(df, limits).groupBy("c", "b").agg(F.count(F.lit(1)).alias("n")).collect():
                counts[(r["c"], r["b"])] = r["n"]
        short: dict[tuple[int, int], list[int]] = {}
        long: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for i, c in enumerate(order):
            below = 0
            for b in range(2 * len(limits[c]) + 1):
                n = counts.get((i, b), 0)
                for rank in [r for r in open_ranks[c] if below <= r < below + n]:
                    if b % 2:
                        found[(c, rank)] = float(limits[c][b // 2])
                    elif n <= exact_limit:
                        short.setdefault((i, b), []).append(rank - below)
                        found[(c, rank)] = math.nan
                    else:
                        long.setdefault((i, b), []).append((rank, (rank - below) / n))
                below += n
        if short:
            listed = _listed(df, limits, short)
            for i, c in enumerate(order):
                below = 0
                for b in range(2 * len(limits[c]) + 1):
                    for place in short.get((i, b), ()):
                        found[(c, below + place)] = listed[(i, b, place)]
                    below += counts.get((i, b), 0)
        closer: dict[str, set[float]] = {}
        if long:
            wanted = _one_of(long)
            sketches = (
                _placed(df, limits).filter(wanted).groupBy("c", "b")
                .agg(F.percentile_approx("v", grid, accuracy).alias("q")).collect()
            )
            for r in sketches:
                name = order[r["c"]]
                # The old ends of the interval stay, so that counting starts from the same place.
                near = closer.setdefault(name, set(limits[name]))
                for _, share in long[(r["c"], r["b"])]:
                    spot = int(share * GRID)
                    near |= {r["q"][max(0, spot - 1)], r["q"][min(GRID, spot + 2)]}
        open_ranks = {}
        for (i, _), waiting in long.items():
            open_ranks.setdefault(order[i], set()).update(rank for rank, _ in waiting)
        limits = {c: sorted(closer[c]) for c in open_ranks}
    return found


def _one_of(pairs) -> Column:
    code = F.struct("c", "b")
    return code.isin(*[F.struct(F.lit(i), F.lit(b)) for i, b in pairs])


def _listed(df, limits, places: dict[tuple[int, int], list[int]]) -> dict[tuple[int, int, int], float]:
    """Values at the given places of sorted, short intervals."""
    wanted = F.create_map(*[
        x for (i, b), spots in places.items()
        for x in (F.lit(f"{i}:{b}"), F.array(*[F.lit(s) for s in spots]))
    ])
    key = F.concat_ws(":", "c", "b")
    rows = (
        _placed(df, limits).filter(_one_of(places)).groupBy("c", "b")
        .agg(F.sort_array(F.collect_list("v")).alias("l"))
        .select("c", "b", wanted[key].alias("s"), F.transform(wanted[key], lambda x: F.element_at("l", x + 1)).alias("v"))
    )
    return {(r["c"], r["b"], s): float(v) for r in rows.collect() for s, v in zip(r["s"], r["v"])}


def cumulate_by_value(
    counts: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]
) -> DataFrame:
    """Adds ``{s}_before``: total of ``s`` over smaller values of the same keys.

    ``counts`` holds one row per (keys, value). Rows are range partitioned on (keys, value), so a
    hot key is spread over many partitions; only one total per partition and key is carried over.
    The checkpoint pins the partition numbers, which both branches below read.
    """
    spark = counts.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = list(keys)
    placed = checkpointed(
        counts.repartitionByRange(slots, *keys, value).withColumn("_slot", F.spark_partition_id())
    )
    before = W.partitionBy("_slot", *keys).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    totals = placed.groupBy("_slot", *keys).agg(*[F.sum(s).alias(s) for s in sums])
    # At most one row per partition number and key, so this window is bounded by the cluster size.
    earlier = W.partitionBy(*keys, F.lit(0)).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        "_slot", *keys, *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums]
    )
    running = placed.select(
        "*", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_in_{s}") for s in sums]
    )
    joined = null_safe_join(running, offsets, ["_slot", *keys])
    return joined.select(
        *[c for c in counts.columns],
        *[(F.col(f"_in_{s}") + F.col(f"_off_{s}")).alias(f"{s}_before") for s in sums],
    )


def grouped_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, float]
) -> DataFrame:
    """Interpolated percentiles per group; one column per entry of ``percents`` (name to 0..1)."""
    keys = list(keys)
    per_value = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    ranked = cumulate_by_value(per_value, keys, "_value", ["_n"])
    sizes = per_value.groupBy(*keys).agg(F.sum("_n").alias("_size"))
    located = null_safe_join(ranked, broadcast_if_small(sizes), keys) if keys else ranked.withColumn("_size", sizes.scalar())
    out = []
    for name, p in percents.items():
        position = (F.col("_size") - 1) * F.lit(float(p))
        holds = lambda rank: (F.col("_n_before") <= rank) & (rank < F.col("_n_before") + F.col("_n"))
        low = F.max(F.when(holds(F.floor(position)), F.col("_value")))
        high = F.max(F.when(holds(F.ceil(position)), F.col("_value")))
        share = F.max(position - F.floor(position))
        out.append((low + (high - low) * share).alias(name))
    return located.groupBy(*keys).agg(*out)


def dense_codes(df: DataFrame, column: str) -> DataFrame:
    """One row per distinct value with ``code``: its position in sorted order, from 0."""
    distinct = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.lit(1).alias("_one"))
    ranked = cumulate_by_value(distinct, [], column, ["_one"])
    return ranked.select(column, F.col("_one_before").cast("int").alias("code"))


def chunk_for(df: DataFrame, ts: str, rows: int = ROWS_PER_CHUNK) -> float:
    """Chunk length in seconds at which even a key with all rows has about ``rows`` of them per chunk.

    Reads the time column only; call it on a scan and hand the result to the operators. Sparse
    tables get the default, dense ones shorter chunks, down to a millisecond.
    """
    micros = epoch_micros(F.col(ts))
    row = df.agg(F.count(ts).alias("n"), (F.max(micros) - F.min(micros)).alias("span")).first()
    if not row["n"] or row["span"] is None:
        return CHUNK_SECONDS
    return max(0.001, min(float(CHUNK_SECONDS), row["span"] / 1e6 * rows / row["n"]))


def time_chunk(ts: Column, seconds: float = CHUNK_SECONDS) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(int(seconds * 1_000_000))).cast("long")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    chunk_seconds: float = CHUNK_SECONDS,
) -> DataFrame:
    """Adds structs ``previous`` and ``following`` with ``fields`` of the adjacent rows of a key.

    ``order`` starts with the timestamp column. A key is cut into time chunks; rows are sorted
    inside a chunk only, and each chunk hands just its first and last row to its neighbours.
    """
    keys, order, fields = list(keys), list(order), list(fields)
    cut = df.withColumn("_chunk", time_chunk(F.col(order[0]), chunk_seconds))
    edge = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_f_{c}") for c in fields])
    content = lambda s: F.when(
        s.isNotNull(), F.struct(*[s[f"_f_{c}"].alias(c) for c in fields])
    )
    across = W.partitionBy(*keys).orderBy("_chunk")
    edges = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.min(edge).alias("_first"), F.max(edge).alias("_last"))
        .select(
            *keys,
            "_chunk",
            content(F.lag("_last").over(across)).alias("_edge_previous"),
            content(F.lead("_first").over(across)).alias("_edge_following"),
        )
    )
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order)
    packed = F.struct(*fields)
    return (
        cut.withColumn("_packed", packed)
        .withColumn("_in_previous", F.lag("_packed").over(inside))
        .withColumn("_in_following", F.lead("_packed").over(inside))
        .join(edges, [*keys, "_chunk"], "left")
        .withColumn("previous", F.coalesce("_in_previous", "_edge_previous"))
        .withColumn("following", F.coalesce("_in_following", "_edge_following"))
        .select(*df.columns, "previous", "following")
    )


__all__ = [
    "chunk_for",
    "cumulate_by_value",
    "dense_codes",
    "exact_percentiles",
    "grouped_percentiles",
    "interval_codes",
    "time_chunk",
    "with_neighbours",
]
