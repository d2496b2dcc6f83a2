"""Preparation of labelled flow tables: labels, columns, missing values, encodings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from floodgauge.functions.expressions import clamp, finite_or_null
from floodgauge.operators.ordered import dense_codes, exact_percentiles
from floodgauge.session import broadcast_if_small

# Attack names of the labelled datasets and the spellings of benign.
ATTACK_NAMES = (
    "DrDoS_DNS", "DrDoS_LDAP", "DrDoS_MSSQL", "DrDoS_NetBIOS", "DrDoS_NTP", "DrDoS_SNMP",
    "DrDoS_UDP", "LDAP", "MSSQL", "NetBIOS", "Portmap", "Syn", "TFTP", "UDP-lag", "UDP", "UDPLag",
    "WebDDoS",
)
BENIGN_MAPPED = ("Benign", "BENIGN")
BENIGN_NORMAL = ("BENIGN", "Normal", "normal", "NORMAL")
BENIGN_ANY = ("BENIGN", "Benign", "benign", "normal", "Normal", "NORMAL", "0")

# Label column candidates in order of preference, and names taken as labels.
LABEL_CANDIDATES = ("Label", " Label", "label", "Label ", "class", "Class", "attack", "Attack", "type", "Type")
LABEL_NAMES = ("attack", "class", "type")
LABEL_COLUMNS = (*LABEL_CANDIDATES, "attack_cat", "Malicious")

# Identifier columns that must not become features.
IDENTIFIER_COLUMNS = (
    "Unnamed: 0", "Source Port", "Destination Port", "Flow ID", "Source IP", "Destination IP",
    "Timestamp", "SimilarHTTP", "Src IP", "Src Port", "Dst IP", "Dst Port", "IPV4_SRC_ADDR",
    "IPV4_DST_ADDR", "id", "index", "Id", "Index",
)

MISSING_CATEGORY = "desconhecido"
ENCODED_SUFFIX = "_codificada"
MAX_CATEGORIES = 50


def attack_flag(label: Column, style: str, numeric: bool = False) -> Column:
    """1 for attack, 0 for benign.

    ``mapped``: known names only, anything else (also NULL) is an attack. ``upper``: not BENIGN in
    any case. ``normal``: not one of the normal spellings; numbers other than 0. ``any``: not one
    of all benign spellings, '0' included.
    """
    if style == "mapped":
        known = F.create_map(*[F.lit(v) for name in ATTACK_NAMES for v in (name, 1)],
                             *[F.lit(v) for name in BENIGN_MAPPED for v in (name, 0)])
        return F.coalesce(known[label], F.lit(1))
    if style == "upper":
        benign = F.upper(label) == "BENIGN"
    elif style == "normal":
        benign = (label == 0) if numeric else label.isin(*BENIGN_NORMAL)
    elif style == "any":
        benign = F.trim(label.cast("string")).isin(*BENIGN_ANY)
    else:
        raise ValueError(f"unknown label style {style}")
    return F.when(F.coalesce(benign, F.lit(False)), 0).otherwise(1)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default) -> DataFrame:
    """Left join to a map table; keys it lacks get ``default``. Of several values of a key the smallest counts."""
    one_each = table.groupBy(key).agg(F.min(value).alias(value))
    joined = df.join(broadcast_if_small(one_each), key, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def find_label(columns: Sequence[str], last_resort: bool = True) -> str:
    """Name of the label column: first candidate, else a name with 'label', else the last one."""
    for name in LABEL_CANDIDATES:
        if name in columns:
            return name
    for name in columns:
        if "label" in name.lower() or name.lower() in LABEL_NAMES:
            return name
    if last_resort and columns:
        return columns[-1]
    raise ValueError("no label column")


def drop_identifiers(df: DataFrame, names: Sequence[str] = IDENTIFIER_COLUMNS) -> DataFrame:
    return df.drop(*[c for c in names if c in df.columns])


def numeric_columns(df: DataFrame, exclude: Sequence[str] = LABEL_COLUMNS) -> list[str]:
    """Numeric columns that are neither labels nor addresses."""
    left_out = set(exclude) | set(IDENTIFIER_COLUMNS)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in left_out
    ]


def numeric_only(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*numeric_columns(df, (*LABEL_COLUMNS, *keep)), *keep)


def _floating(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    kinds = (T.DoubleType, T.FloatType)
    names = columns if columns is not None else df.columns
    return [f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, kinds)]


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and both infinities become NULL in floating columns."""
    return df.withColumns({c: finite_or_null(F.col(f"`{c}`")) for c in _floating(df, columns)})


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(0, subset=list(columns) if columns is not None else None)


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    found = exact_percentiles(df, {c: [0.5] for c in columns})
    return {c: found[c][0.5] for c in columns}


def median_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values become the exact median of their column; only columns with gaps are ranked."""
    names = list(columns) if columns is not None else numeric_columns(df)
    gaps = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names]).first()
    holed = [c for c in names if gaps[c]]
    if not holed:
        return df
    medians = column_medians(df, holed)
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`"), F.lit(medians[c])) for c in holed if medians[c] is not None}
    )


def to_number(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what is not a number becomes 0."""
    cast = lambda c: F.coalesce(finite_or_null(F.col(f"`{c}`").try_cast("double")), F.lit(0.0))
    return df.withColumns({c: cast(c) for c in columns})


def drop_incomplete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies are merged before the shuffle, so a large group of equal rows stays cheap."""
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.lit(1).alias("_one")).drop("_one")


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows before and after removing copies: one row."""
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_n"))
    return copies.agg(
        F.sum("_n").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        (F.sum("_n") - F.count(F.lit(1))).alias("removed"),
    )


# Integer types with their ranges, narrowest first.
INTEGER_RANGES = (("tinyint", 7), ("smallint", 15), ("int", 31))


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type that holds the column; doubles become floats when nothing is lost."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    real = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    if not whole and not real:
        return df
    probes = []
    for c in whole:
        probes += [F.min(f"`{c}`").alias(f"lo_{c}"), F.max(f"`{c}`").alias(f"hi_{c}")]
    for c in real:
        exact = F.col(f"`{c}`").cast("float").cast("double").eqNullSafe(F.col(f"`{c}`"))
        probes.append(F.min(exact).alias(f"ok_{c}"))
    found = df.agg(*probes).first()
    casts: dict[str, str] = {}
    for c in whole:
        low, high = found[f"lo_{c}"], found[f"hi_{c}"]
        if low is None:
            continue
        for kind, bits in INTEGER_RANGES:
            if -(1 << bits) <= low and high < (1 << bits):
                casts[c] = kind
                break
    casts.update({c: "float" for c in real if found[f"ok_{c}"]})
    return df.select(*[F.col(f"`{c}`").cast(casts[c]).alias(c) if c in casts else F.col(f"`{c}`") for c in df.columns])


def zero_variance_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with one value only (sample variance zero)."""
    bounds = df.agg(
        *[F.min(f"`{c}`").alias(f"lo_{c}") for c in columns],
        *[F.max(f"`{c}`").alias(f"hi_{c}") for c in columns],
        *[F.count(f"`{c}`").alias(f"n_{c}") for c in columns],
    ).first()
    return [c for c in columns if bounds[f"n_{c}"] > 1 and bounds[f"lo_{c}"] == bounds[f"hi_{c}"]]


def drop_zero_variance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.drop(*zero_variance_columns(df, columns or numeric_columns(df)))


def encode_labels(df: DataFrame, column: str, output: str) -> DataFrame:
    """Adds the position of the value among the sorted distinct values."""
    codes = dense_codes(df.select(F.col(column).cast("string").alias(column)), column)
    named = broadcast_if_small(codes.withColumnRenamed("code", output).withColumnRenamed(column, "_value"))
    return df.join(named, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")


def encode_categories(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_CATEGORIES, labels: Sequence[str] = LABEL_COLUMNS
) -> DataFrame:
    """Adds ``{c}_codificada`` for text columns with fewer than ``limit`` values.

    A missing value is a category of its own. Label columns are left out: a coded label among the
    features would leak the answer.
    """
    names = [c for c in columns if c not in labels]
    if not names:
        return df
    sizes = df.agg(*[F.countDistinct(f"`{c}`").alias(c) for c in names]).first()
    out = df
    for c in names:
        if sizes[c] < limit:
            filled = out.withColumn("_filled", F.coalesce(F.col(f"`{c}`"), F.lit(MISSING_CATEGORY)))
            out = encode_labels(filled, "_filled", f"{c}{ENCODED_SUFFIX}").drop("_filled")
    return out


def clip_per_column(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values outside the column's percentiles move to the limit."""
    limits = exact_percentiles(df, {c: [low, high] for c in columns})
    return df.withColumns(
        {c: clamp(F.col(f"`{c}`"), limits[c][low], limits[c][high]) for c in columns}
    )


def clip_global(df: DataFrame, columns: Sequence[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """One pair of limits: percentiles of all values of all columns together."""
    stacked = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("double") for c in columns])).alias("v"))
    limits = exact_percentiles(stacked, {"v": [low, high]})["v"]
    return df.withColumns(
        {c: clamp(F.col(f"`{c}`"), limits[low], limits[high]) for c in columns}
    )


def missing_cells(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column and in total: one row."""
    names = list(columns) if columns is not None else df.columns
    kinds = dict(df.dtypes)
    gone = lambda c: (
        F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`") if kinds[c] in ("double", "float") else F.col(f"`{c}`").isNull()
    )
    counts = [F.count_if(gone(c)) for c in names]
    return df.agg(
        *[n.alias(f"missing_{c}") for n, c in zip(counts, names)],
        reduce(lambda a, b: a + b, counts).alias("missing_total"),
    )
