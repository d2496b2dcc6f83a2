"""Class distributions and balance checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodgauge.operators.clean import BENIGN_ANY


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows and share per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return counts.select(F.col(label).alias("label"), "n", (F.col("n") / total).alias("share"))


def class_totals(df: DataFrame, dataset: str, is_attack: str) -> DataFrame:
    """Normal, attack and ratio per dataset, and over all datasets (``total``)."""
    y = F.col(is_attack).cast("long")
    rows = df.rollup(dataset).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(1 - y).alias("normal"),
        F.sum(y).alias("attack"),
        F.avg(y).alias("attack_ratio"),
        F.grouping(dataset).alias("_total"),
    )
    return rows.select(F.when(F.col("_total") == 1, "total").otherwise(F.col(dataset)).alias("dataset"), "n", "normal", "attack", "attack_ratio")


def attack_types(df: DataFrame, label: str) -> DataFrame:
    """Distinct attack names, benign spellings left out, with their row counts."""
    text = F.trim(F.col(label).cast("string"))
    return (
        df.filter(F.col(label).isNotNull() & ~text.isin(*BENIGN_ANY))
        .groupBy(text.alias("attack_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def attack_type_count(df: DataFrame, label: str) -> DataFrame:
    return attack_types(df, label).agg(F.count(F.lit(1)).alias("n_attack_types"))


# Limits of the balance verdict.
def balance_verdict(attack_ratio: Column) -> Column:
    return (
        F.when(attack_ratio >= 1.0, "no_normal_samples")
        .when(attack_ratio >= 0.95, "very_unbalanced")
        .when((attack_ratio >= 0.3) & (attack_ratio <= 0.8), "well_balanced")
        .otherwise("questionable")
    )


def balance_report(df: DataFrame, dataset: str, is_attack: str) -> DataFrame:
    return class_totals(df, dataset, is_attack).withColumn("verdict", balance_verdict(F.col("attack_ratio")))
