"""File scans of labelled flow tables and checks of what is there."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns that may hold the names in a feature dictionary file.
DICTIONARY_COLUMNS = ("Feature", "feature", "name", "Nome", "nome")
DICTIONARY_PATTERN = "feature"

READ_ORDER = ("parquet", "orc", "json", "csv")


def list_files(spark: SparkSession, folder: str, suffix: str, recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, through Spark's own file listing."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    try:
        rows = reader.load(folder).select("path", "length").collect()
    except AnalysisException:
        return []
    return sorted((r["path"], r["length"]) for r in rows)


def _common_types(spark: SparkSession, groups: dict[tuple[str, ...], list[str]]) -> dict[str, T.DataType]:
    """One type per column over all groups: the common one, double for different numbers, else string."""
    found: dict[str, set[T.DataType]] = {}
    for paths in groups.values():
        for f in spark.read.option("header", "true").option("inferSchema", "true").csv(paths).schema.fields:
            found.setdefault(f.name, set()).add(f.dataType)
    numeric = lambda kinds: all(isinstance(k, T.NumericType) for k in kinds)
    return {
        c: next(iter(kinds)) if len(kinds) == 1 else T.DoubleType() if numeric(kinds) else T.StringType()
        for c, kinds in found.items()
    }


def scan_csv(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | None = None,
    which: str = "all",
    skip_dictionary: bool = True,
    recursive: bool = True,
) -> DataFrame:
    """Union by name of all CSV files below a folder.

    Files are grouped by header so each group is one scan; a column missing in a group is NULL.
    Empty files are skipped. ``which='largest'`` keeps only the largest file. With ``schema`` the
    named columns get its types; without it Spark infers one type per column over all groups.
    """
    files = [f for f in list_files(spark, folder, ".csv", recursive) if f[1] > 0]
    headers = {path: tuple(spark.read.option("header", "true").csv(path).columns) for path, _ in files}
    if skip_dictionary:  # by name and content: a table of flow features keeps its rows
        named = [f for f in files if DICTIONARY_PATTERN in f[0].rsplit("/", 1)[-1].lower()]
        dictionaries = {path for path, _ in named if set(headers[path]) & set(DICTIONARY_COLUMNS)}
        files = [f for f in files if f[0] not in dictionaries]
    if not files:
        raise FileNotFoundError(f"no CSV file with content below {folder}")
    if which == "largest":
        files = [max(files, key=lambda f: (f[1], f[0]))]
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, _ in files:
        groups.setdefault(headers[path], []).append(path)
    declared = {f.name: f.dataType for f in schema.fields} if schema else _common_types(spark, groups)
    parts = []
    for header, paths in groups.items():
        reader = spark.read.option("header", "true").option("mode", "PERMISSIVE")
        known = T.StructType([T.StructField(c, declared.get(c, T.StringType())) for c in header])
        parts.append(reader.schema(known).csv(paths))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def scan_preferred(
    spark: SparkSession, folder: str, schema: T.StructType | None = None,
    order: Sequence[str] = READ_ORDER,
) -> tuple[DataFrame, str]:
    """First format of ``order`` that has files in the folder, with the format's name."""
    for kind in order:
        if not list_files(spark, folder, f".{kind}", recursive=False):
            continue
        if kind == "csv":
            return scan_csv(spark, folder, schema, recursive=False), kind
        reader = spark.read.option("pathGlobFilter", f"*.{kind}")
        return (reader.schema(schema) if schema and kind == "json" else reader).format(kind).load(folder), kind
    raise FileNotFoundError(f"no data file in {folder}")


def feature_names(spark: SparkSession, folder: str) -> list[str] | None:
    """Names listed in the feature dictionary file, or None when there is none."""
    for path, _ in list_files(spark, folder, ".csv", recursive=False):
        if DICTIONARY_PATTERN in path.rsplit("/", 1)[-1].lower():
            table = spark.read.option("header", "true").csv(path)
            column = next((c for c in DICTIONARY_COLUMNS if c in table.columns), None)
            if column:
                # One short row per table column.
                return [r[0] for r in table.select(column).collect()]
    return None


def try_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    try:
        return spark.read.format(kind).load(path)
    except AnalysisException:
        return None


def first_available(spark: SparkSession, candidates: Iterable[tuple[str, str]]) -> tuple[str, DataFrame]:
    """First (name, path) that can be read, in the order given."""
    tried = []
    for name, path in candidates:
        table = try_table(spark, path)
        if table is not None:
            return name, table
        tried.append(name)
    raise FileNotFoundError(f"none of the datasets is available: {', '.join(tried)}")


def contract_report(
    spark: SparkSession, tables: dict[str, DataFrame | None], required: dict[str, Sequence[str]]
) -> DataFrame:
    """One row per dataset: present, row count, width, missing required columns and verdict."""
    rows = []
    for name, table in tables.items():
        have = table.columns if table is not None else []
        missing = [c for c in required.get(name, ()) if c not in have]
        base = table if table is not None else spark.range(0)
        rows.append(
            base.agg(F.count(F.lit(1)).alias("n_rows")).select(
                F.lit(name).alias("dataset"),
                F.lit(int(table is not None)).alias("present"),
                "n_rows",
                F.lit(len(have)).alias("n_columns"),
                F.lit(",".join(missing)).alias("missing_columns"),
                ((F.col("n_rows") > 0) & F.lit(not missing)).cast("int").alias("usable"),
            )
        )
    return reduce(DataFrame.unionByName, rows)
