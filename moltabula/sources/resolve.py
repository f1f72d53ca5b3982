"""Finding a table and checking its columns, without running a job."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from moltabula.constants import FINGERPRINT_SUFFIX, SPLIT_FILE


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, candidates: Iterable[str], required: bool = True) -> str | None:
    candidates = list(candidates)
    for path in candidates:
        if path_exists(spark, path):
            return path
    if required:
        raise FileNotFoundError(f"none of these exists: {candidates}")
    return None


def split_candidates(base: str, split: str, features: bool | None = None) -> list[str]:
    """Paths of a split in order of preference.

    ``features=True`` accepts fingerprint files only, ``False`` raw files only, and ``None`` takes
    fingerprints first and raw files after them.
    """
    suffixes = {True: [FINGERPRINT_SUFFIX], False: [""], None: [FINGERPRINT_SUFFIX, ""]}[features]
    return [
        SPLIT_FILE.format(base=base.rstrip("/"), split=split, suffix=suffix, ext=ext)
        for suffix in suffixes
        for ext in ("parquet", "csv")
    ]


def column_names(spark: SparkSession, path: str) -> list[str]:
    """Names only: the footer of a parquet table or the header line of a CSV table."""
    if path.endswith(".csv"):
        return spark.read.option("header", True).csv(path).columns
    return spark.read.parquet(path).columns


def require_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """Parquet or CSV by extension; ``columns`` prunes the scan.

    CSV values may hold line breaks, so a CSV file is not split: large tables want many files, or parquet.
    """
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("escape", '"').option("multiLine", True)
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    else:
        df = spark.read.parquet(path)
    if columns is None:
        return df
    return require_columns(df, columns).select(*columns)


def load_split(spark: SparkSession, base: str, split: str, features: bool | None = None,
               columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    path = first_existing(spark, split_candidates(base, split, features))
    return require_columns(read_table(spark, path, columns, schema), ["smiles", "source"])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over all cores when it has fewer partitions than there are; else leave it alone.

    A table of many files passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
