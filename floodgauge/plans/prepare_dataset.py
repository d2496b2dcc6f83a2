"""Preparation of a labelled flow table: clean, sample, split, scale, select, write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodgauge.ml.scaling import LinearScaling, fit_min_max, fit_robust, fit_standard
from floodgauge.ml.selection import select_by_anova
from floodgauge.operators import clean, sampling
from floodgauge.session import checkpointed
from floodgauge.sources.export import export_prepared

FITTERS = {"standard": fit_standard, "min_max": fit_min_max, "robust": fit_robust}


@dataclass
class Prepared:
    table: DataFrame
    features: list[str]
    scaling: LinearScaling
    label: str


def prepare_dataset(
    raw: DataFrame, label_style: str = "upper", cap: int | None = None, top: int | None = None,
    scaling: str = "standard", test: float = 0.2, validation: float = 0.0,
    key: Sequence[str] | None = None, drop_copies: bool = True,
) -> Prepared:
    """Cleaned, split and scaled table with ``Malicious`` as the binary label.

    Statistics for filling come from all rows; the scaler is fitted on the training rows only.
    """
    label = clean.find_label(raw.columns)
    table = clean.drop_identifiers(raw, [c for c in clean.IDENTIFIER_COLUMNS if c not in (key or ())])
    features = clean.numeric_columns(table, (*clean.LABEL_COLUMNS, label, *(key or ())))
    table = clean.infinite_to_null(table, features)
    if drop_copies:
        table = clean.drop_duplicate_rows(table)
    table = checkpointed(table)
    table = clean.median_fill(table, features)
    constant = clean.zero_variance_columns(table, features)
    features = [c for c in features if c not in constant]
    numeric = raw.schema[label].dataType.typeName() != "string"
    table = table.drop(*constant).withColumn("Malicious", clean.attack_flag(F.col(f"`{label}`"), label_style, numeric))
    if cap:
        table = sampling.cap_per_class(table, label, cap, key=key)
    split = sampling.stratified_split(table, label, test, validation, key)
    if top:
        features = select_by_anova(split.filter("split = 'train'"), features, "Malicious", top)
    scaler = FITTERS[scaling](split.filter("split = 'train'"), features)
    kept = split.select(*(key or ()), *features, label, "Malicious", "split")
    return Prepared(scaler.apply(kept), features, scaler, "Malicious")


def write_prepared(prepared: Prepared, path: str, dataset: str) -> None:
    """Table by split, metadata and scaler parameters below one folder."""
    export_prepared(prepared.table, path, dataset, prepared.features, prepared.label)
    spark = prepared.table.sparkSession
    prepared.scaling.parameters(spark).write.mode("overwrite").parquet(f"{path}/scaler")
