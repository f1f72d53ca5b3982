"""Scans beyond a plain table read."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltabula.constants import SPLITS
from moltabula.functions.text import clean_lines, strip
from moltabula.sources.resolve import first_existing, path_exists, read_table, split_candidates

MOLECULES = T.StructType([T.StructField("smiles", T.StringType()), T.StructField("source", T.StringType())])


def read_lines(spark: SparkSession, path: str, out: str = "value") -> DataFrame:
    """Stripped non-blank lines of a text file; a missing file gives no rows and a warning."""
    if not path_exists(spark, path):
        warnings.warn(f"file not found: {path}", stacklevel=2)
        return spark.createDataFrame([], T.StructType([T.StructField(out, T.StringType())]))
    stripped = spark.read.text(path).select(strip(F.col("value")).alias(out))
    return stripped.filter(F.col(out) != "")


def explode_lines(df: DataFrame, text: str, out: str = "line", keep: list[str] | None = None) -> DataFrame:
    """The same lines from a text column."""
    return df.select(*(keep or []), F.explode(clean_lines(F.col(text))).alias(out))


def mapping_values(df: DataFrame, mapping: str, out: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row per value of a map column."""
    return df.select(*(keep or []), F.explode(F.map_values(F.col(mapping))).alias(out))


def tagged_union(tables: dict[str, DataFrame], tag: str = "split") -> DataFrame:
    """All rows of several tables with the name of the table they came from."""
    if not tables:
        raise ValueError("no table to read")
    merged = None
    for name, df in tables.items():
        tagged = df.withColumn(tag, F.lit(name))
        merged = tagged if merged is None else merged.unionByName(tagged)
    return merged


def load_splits(spark: SparkSession, base: str, splits: tuple[str, ...] = SPLITS,
                features: bool | None = None) -> DataFrame:
    """All splits that exist, tagged; absent ones are skipped with a warning."""
    found = {}
    for split in splits:
        path = first_existing(spark, split_candidates(base, split, features), required=False)
        if path is None:
            warnings.warn(f"no file for split {split} under {base}", stacklevel=2)
        else:
            found[split] = read_table(spark, path)
    return tagged_union(found)


def read_shards(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """All shards of a glob pattern; unreadable and vanished files are passed over.

    A warning says how many files gave no rows. When none does, that is an error, unless all can be read and are empty.
    """
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        raise FileNotFoundError(f"no shard matches {pattern}")
    shards = (
        spark.read.schema(schema)
        .option("ignoreCorruptFiles", True)
        .option("ignoreMissingFiles", True)
        .parquet(pattern)
    )
    listed = len(shards.inputFiles())
    # one name for each file, not for each row
    good = shards.select(F.col("_metadata.file_path").alias("file")).distinct().count()
    if not good:
        try:  # shards that can be read may all be empty
            spark.read.schema(schema).parquet(pattern).limit(1).collect()
        except Exception as error:
            raise ValueError(f"no shard of {pattern} could be read") from error
        return shards
    if good < listed:
        warnings.warn(f"{listed - good} of {listed} shards of {pattern} gave no rows", stacklevel=2)
    return shards


def merge_shards(spark: SparkSession, pattern: str, schema: T.StructType, index: str = "index") -> DataFrame:
    """Shards in the order of their stored index, which is then dropped."""
    return read_shards(spark, pattern, schema).orderBy(index).drop(index)
