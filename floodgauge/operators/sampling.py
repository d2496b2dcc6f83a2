"""Exact, repeatable samples and splits.

Rows are ordered inside a class by a hash of their key columns. A quota then becomes a cut in the
hash order: counts per hash prefix locate the prefix the cut falls into, and only the rows of that
prefix are looked at one by one. The table itself is filtered against one cut per class and is
never shuffled or sorted, and no class is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from floodgauge.functions.expressions import row_hash
from floodgauge.session import BROADCAST_ROW_LIMIT, broadcast_if_small, checkpointed, null_safe_join

# Fixed value: hex digits of the prefix the counts are kept for (4 digits: 65,536 prefixes).
PREFIX_DIGITS = 4
DEFAULT_SEED = 42
NO_CLASS = "_all"


def _hashed(df: DataFrame, by: Sequence[str], key: Sequence[str] | None, seed: int) -> DataFrame:
    columns = list(key) if key else list(df.columns)
    with_class = df if by else df.withColumn(NO_CLASS, F.lit(0))
    return with_class.withColumn("_h", row_hash(columns, seed))


def class_cuts(
    df: DataFrame, by: Sequence[str], quotas: Callable[[DataFrame], DataFrame],
    key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """One row per class and quota: ``_cut`` (a hash), ``_below`` and ``_take``.

    ``quotas`` turns the table of class sizes (columns ``by`` and ``_n``) into rows (``by``,
    ``_part``, ``_quota``). Rows with a hash smaller than ``_cut`` lie within the quota; of the
    rows whose hash equals ``_cut`` the first ``_take`` of ``_copies`` do.
    """
    by = list(by) or [NO_CLASS]
    hashed = _hashed(df, [] if by == [NO_CLASS] else by, key, seed).select(*by, "_h")
    prefix = F.substring("_h", 1, PREFIX_DIGITS)
    counts = checkpointed(hashed.groupBy(*by, prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c")))
    sizes = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    wanted = quotas(sizes).select(*by, "_part", "_quota")
    order = W.partitionBy(*by).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    running = counts.withColumn("_before", F.coalesce(F.sum("_c").over(order), F.lit(0)))
    located = null_safe_join(running, wanted, by).filter(
        (F.col("_before") < F.col("_quota")) & (F.col("_quota") <= F.col("_before") + F.col("_c"))
    )
    located = checkpointed(located.select(*by, "_part", "_quota", "_p", "_before"))
    # The tables below hold at most one row per row of this one, so one check serves them all.
    hint = F.broadcast if located.count() <= BROADCAST_ROW_LIMIT else lambda t: t
    # Same for single hashes, for the rows of the located prefixes only.
    near = (
        null_safe_join(hashed.withColumn("_p", prefix), hint(located.select(*by, "_p").distinct()), [*by, "_p"])
        .groupBy(*by, "_p", "_h")
        .agg(F.count(F.lit(1)).alias("_copies"))
    )
    inside = W.partitionBy(*by, "_p").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    near = near.withColumn("_sofar", F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    rank = F.col("_quota") - F.col("_before")
    return (
        null_safe_join(near, hint(located), [*by, "_p"])
        .filter((F.col("_sofar") < rank) & (rank <= F.col("_sofar") + F.col("_copies")))
        .select(
            *by, "_part", F.col("_h").alias("_cut"), (rank - F.col("_sofar")).alias("_take"), "_copies"
        )
    )


def assign_parts(
    df: DataFrame, by: Sequence[str], quotas: Callable[[DataFrame], DataFrame], parts: int,
    name: str, key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Adds ``name``: the number of the part (0 .. parts) a row falls into.

    Quota ``i`` of a class is the summed size of its parts 0 .. i; the rest forms part ``parts``.
    """
    classes = list(by) or [NO_CLASS]
    cuts = checkpointed(class_cuts(df, by, quotas, key, seed))
    partial = cuts.filter(F.col("_take") < F.col("_copies"))
    shared = not partial.isEmpty()
    per_class = cuts.groupBy(*classes).agg(
        *[
            F.max(F.when(F.col("_part") == i, F.struct("_cut", "_take", "_copies"))).alias(f"_q{i}")
            for i in range(parts)
        ]
    )
    rows = null_safe_join(_hashed(df, by, key, seed), broadcast_if_small(per_class), classes, "left")
    beyond = [
        F.when(F.col(f"_q{i}").isNull() | (F.col("_h") > F.col(f"_q{i}._cut")), 1).otherwise(0)
        for i in range(parts)
    ]
    part = sum(beyond[1:], beyond[0])
    if not shared:
        return rows.withColumn(name, part).select(*df.columns, name)
    cut_hashes = partial.select(*classes, F.col("_cut").alias("_h")).distinct()
    split_here = broadcast_if_small(cut_hashes.withColumn("_shared", F.lit(1)))
    marked = null_safe_join(rows, split_here, [*classes, "_h"], "left")
    whole = marked.filter(F.col("_shared").isNull()).withColumn(name, part).select(*df.columns, name)
    return whole.unionByName(_deal_copies(marked.filter("_shared = 1"), df.columns, classes, parts, name))


def _deal_copies(rows: DataFrame, columns: list[str], classes: list[str], parts: int, name: str) -> DataFrame:
    """Rows that share the hash a cut falls on: equal rows are counted, the counts are dealt out."""
    bounds = [f"_q{i}" for i in range(parts)]
    extra = [c for c in [*classes, "_h"] if c not in columns]
    counted = rows.groupBy(*columns, *extra, *bounds).agg(F.count(F.lit(1)).alias("_c"))
    order = W.partitionBy(*classes, "_h").orderBy(*[F.col(f"`{c}`") for c in columns])
    before = F.coalesce(F.sum("_c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counted = counted.withColumn("_before", before)
    # Upper end of part i among the copies: all when the cut lies on a later hash, none when earlier.
    ends = []
    for q in bounds:
        ends.append(
            F.when(F.col(q).isNull() | (F.col(f"{q}._cut") < F.col("_h")), F.lit(0))
            .when(F.col(f"{q}._cut") == F.col("_h"), F.col(f"{q}._take"))
            .otherwise(F.col(f"{q}._copies") + F.lit(1 << 60))
        )
    slices = []
    low = F.lit(0).cast("long")
    for i in range(parts + 1):
        high = ends[i] if i < parts else F.lit((1 << 61))
        share = F.greatest(
            F.lit(0), F.least(high, F.col("_before") + F.col("_c")) - F.greatest(low, F.col("_before"))
        )
        slices.append(F.struct(F.lit(i).alias("part"), share.cast("long").alias("n")))
        low = high
    dealt = counted.withColumn("_s", F.explode(F.array(*slices))).filter("_s.n > 0")
    # Copies are written out in blocks so that one row never expands in a single step.
    block = 100_000
    blocks = dealt.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("_s.n") - 1) / block).cast("long")))
    ).repartition("_h", "_b")
    count = F.least(F.lit(block).cast("long"), F.col("_s.n") - F.col("_b") * block)
    return blocks.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), count))).select(
        *columns, F.col("_s.part").alias(name)
    )


def _keep_first(df, by, quotas, key, seed) -> DataFrame:
    picked = assign_parts(df, by, quotas, 1, "_part_no", key, seed)
    return picked.filter("_part_no = 0").drop("_part_no")


def _single(quota: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda sizes: sizes.select("*", F.lit(0).alias("_part"), quota.cast("long").alias("_quota"))


# Class left out and class size of the balanced subset.
EXCLUDED_CLASS = "WebDDoS"
MAX_PER_CLASS = 150_000


def cap_per_class(
    df: DataFrame, label: str, n: int = MAX_PER_CLASS, exclude: Sequence[str] = (EXCLUDED_CLASS,),
    key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """At most ``n`` rows of every class; excluded classes are dropped."""
    kept = df.filter(~F.coalesce(F.col(label).isin(*exclude), F.lit(False))) if exclude else df
    return _keep_first(kept, [label], _single(F.least(F.col("_n"), F.lit(n))), key, seed)


# Fixed value: size of the proportional sample.
PROPORTIONAL_ROWS = 2_500_000


def proportional_sample(
    df: DataFrame, label: str, n: int = PROPORTIONAL_ROWS, key: Sequence[str] | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """The same fraction ``min(1, n / rows)`` of every class, rounded half to even."""

    def quotas(sizes: DataFrame) -> DataFrame:
        total = sizes.agg(F.sum("_n")).scalar()
        return _single(F.bround(F.least(F.lit(1.0), F.lit(float(n)) / total) * F.col("_n")))(sizes)

    return _keep_first(df, [label], quotas, key, seed)


def mixed_sample(
    df: DataFrame, is_attack: str, size: int, attack_share: float = 0.7,
    key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Up to ``size`` rows, 70 % attacks and 30 % benign; a one-sided table is kept whole."""

    def quotas(sizes: DataFrame) -> DataFrame:
        sides = sizes.agg(F.count(F.lit(1))).scalar()
        attacks, benign = int(size * attack_share), int(size * round(1 - attack_share, 10))
        cap = F.when(F.col(is_attack) == 1, attacks).otherwise(benign)
        return _single(F.when(sides < 2, F.col("_n")).otherwise(F.least(F.col("_n"), cap)))(sizes)

    return _keep_first(df, [is_attack], quotas, key, seed)


# Fixed value: size of the ratio-keeping sample.
RATIO_ROWS = 200_000


def ratio_sample(
    df: DataFrame, is_attack: str, n: int = RATIO_ROWS, key: Sequence[str] | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``n`` rows with the attack ratio of the whole table; smaller tables are kept whole."""

    def quotas(sizes: DataFrame) -> DataFrame:
        total = sizes.agg(F.sum("_n")).scalar()
        attacks = sizes.agg(F.coalesce(F.sum(F.when(F.col(is_attack) == 1, F.col("_n"))), F.lit(0))).scalar()
        wanted = F.least(F.floor(F.lit(n) * (attacks / total)), attacks)
        side = F.when(F.col(is_attack) == 1, wanted).otherwise(F.least(F.lit(n) - wanted, F.col("_n")))
        return _single(F.when(total <= n, F.col("_n")).otherwise(side))(sizes)

    return _keep_first(df, [is_attack], quotas, key, seed)


def capped_sample(
    df: DataFrame, n: int, key: Sequence[str] | None = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """``n`` random rows, or all when there are fewer."""
    return _keep_first(df, [], _single(F.least(F.col("_n"), F.lit(n))), key, seed)


# Rows per source and their normal share.
SOURCE_ROWS = 15_000
SOURCE_NORMAL_SHARE = 0.4


def source_quota_sample(
    df: DataFrame, source: str, is_attack: str, n: int = SOURCE_ROWS,
    normal_share: float = SOURCE_NORMAL_SHARE, key: Sequence[str] | None = None,
    seed: int = DEFAULT_SEED,
) -> DataFrame:
    """``n`` rows per source, 40 % normal.

    A source that cannot fill both sides gives ``min(n, rows)`` random rows of any kind instead.
    """
    normal = int(n * normal_share)
    attack = n - normal
    filled = df.groupBy(source).agg(
        (
            (F.count_if(F.col(is_attack) == 0) >= normal) & (F.count_if(F.col(is_attack) == 1) >= attack)
        ).alias("_fills")
    )
    known = broadcast_if_small(checkpointed(filled))
    group = F.when(F.col("_fills"), F.col(is_attack)).otherwise(F.lit(-1))
    tagged = null_safe_join(df, known, [source]).withColumn("_side", group).select(*df.columns, "_side")
    cap = F.when(F.col("_side") == 0, normal).when(F.col("_side") == 1, attack).otherwise(n)
    picked = _keep_first(
        tagged, [source, "_side"], _single(F.least(F.col("_n"), cap)), key or df.columns, seed
    )
    return picked.drop("_side")


SPLIT_NAMES = ("test", "val", "train")


def stratified_split(
    df: DataFrame, label: str, test: float = 0.2, validation: float = 0.0,
    key: Sequence[str] | None = None, seed: int = DEFAULT_SEED,
) -> DataFrame:
    """Adds ``split``. ``validation`` is a share of what is left after the test rows.

    Every class gives ``round(test * n)`` rows to the test part (half to even).
    """

    def quotas(sizes: DataFrame) -> DataFrame:
        held = F.bround(F.col("_n") * test).cast("long")
        checked = held + F.bround((F.col("_n") - held) * validation).cast("long")
        ends = F.array(
            F.struct(F.lit(0).alias("_part"), held.alias("_quota")),
            F.struct(F.lit(1).alias("_part"), checked.alias("_quota")),
        )
        return sizes.select(label, F.inline(ends))

    numbered = assign_parts(df, [label], quotas, 2, "_part_no", key, seed)
    names = F.element_at(F.array(*[F.lit(s) for s in SPLIT_NAMES]), F.col("_part_no") + 1)
    return numbered.withColumn("split", names).drop("_part_no")


def stratified_folds(
    df: DataFrame, label: str, k: int = 5, key: Sequence[str] | None = None, seed: int = DEFAULT_SEED
) -> DataFrame:
    """Adds ``fold`` (0 .. k-1); the folds of a class differ by at most one row."""

    def quotas(sizes: DataFrame) -> DataFrame:
        base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
        end = lambda i: base * (i + 1) + F.least(extra, F.lit(i + 1))
        ends = [F.struct(F.lit(i).alias("_part"), end(i).cast("long").alias("_quota")) for i in range(k - 1)]
        return sizes.select(label, F.inline(F.array(*ends)))

    return assign_parts(df, [label], quotas, k - 1, "fold", key, seed)


def subset_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def shuffled(df: DataFrame, key: Sequence[str] | None = None, seed: int = DEFAULT_SEED) -> DataFrame:
    """Random but repeatable row order; sorts the table, so ask for it only when order matters."""
    return df.orderBy(row_hash(key or df.columns, seed))
