"""Union of several labelled datasets into one table keyed by source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_sources(tables: dict[str, DataFrame], source: str = "source") -> DataFrame:
    """All rows of all tables, matched by column name, with the name of their source."""
    tagged = [t.withColumn(source, F.lit(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def common_columns(tables: dict[str, DataFrame], exclude: tuple[str, ...] = ()) -> list[str]:
    """Sorted names that every table has."""
    sets = [set(t.columns) - set(exclude) for t in tables.values()]
    return sorted(set.intersection(*sets)) if sets else []


def integrate_by_name(tables: dict[str, DataFrame], label: str, source: str = "source") -> DataFrame:
    """Shared features, the label and the source."""
    shared = common_columns(tables, (label, source))
    if not shared:
        raise ValueError("the datasets share no feature")
    return union_sources({n: t.select(*shared, label) for n, t in tables.items()}, source)


def integrate_by_position(tables: dict[str, DataFrame], label: str, source: str = "source") -> DataFrame:
    """Features matched by position, cut to the narrowest table, named ``feature_0`` and so on."""
    widths = {n: [c for c in t.columns if c != label] for n, t in tables.items()}
    width = min(len(c) for c in widths.values())
    aligned = {
        n: t.select(
            *[F.col(f"`{c}`").cast("double").alias(f"feature_{i}") for i, c in enumerate(widths[n][:width])], label
        )
        for n, t in tables.items()
    }
    return union_sources(aligned, source)


# Label prefixes of the two sources.
LABEL_PREFIXES = {"cic": "CIC_", "unsw": "UNSW_"}


def prefixed_labels(tables: dict[str, DataFrame], label: str, prefixes: dict[str, str] = LABEL_PREFIXES) -> DataFrame:
    """Union in which every label carries the prefix of its source."""
    named = {
        n: t.withColumn(label, F.concat(F.lit(prefixes[n]), F.col(label))) for n, t in tables.items()
    }
    return union_sources(named)


def configuration(integrated: DataFrame, name: str, source: str = "source") -> DataFrame:
    """``combined`` and ``ensemble_separate`` hold every row; ``individual_<source>`` one source."""
    if name in ("combined", "ensemble_separate"):
        return integrated
    if name.startswith("individual_"):
        return integrated.filter(F.col(source) == name.removeprefix("individual_"))
    raise ValueError(f"unknown configuration {name}")


def integration_summary(integrated: DataFrame, is_attack: Column | str, source: str = "source") -> DataFrame:
    """Counts per configuration: one row per source and one for all of them."""
    flag = F.col(is_attack) if isinstance(is_attack, str) else is_attack
    rows = integrated.withColumn("_y", flag.cast("long")).rollup(source).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("_y").alias("attack_samples"),
        (F.count(F.lit(1)) - F.sum("_y")).alias("normal_samples"),
        F.avg("_y").alias("attack_ratio"),
        F.grouping(source).alias("_total"),
    )
    return rows.select(
        F.when(F.col("_total") == 1, "combined").otherwise(F.concat(F.lit("individual_"), F.col(source))).alias("configuration"),
        "samples", "attack_samples", "normal_samples", "attack_ratio",
    )
