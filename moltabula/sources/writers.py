"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltabula.functions.bits import dense_bits
from moltabula.functions.labels import encode_label
from moltabula.functions.vectors import nan_to_null


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table; the format is always the caller's choice."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        # as written, with the white space at both ends of a value
        writer = writer.option("header", True).option("escape", '"')
        writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_distinct_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).distinct().write.mode("overwrite").text(path)


def clean_record(df: DataFrame) -> DataFrame:
    """NaN to null in every floating column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def write_record(df: DataFrame, path: str) -> None:
    """A one-row table as one JSON file, with nulls kept."""
    clean_record(df).coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_shards(df: DataFrame, path: str, shards: int, key: str) -> None:
    """One directory per shard, rows spread by the hash of ``key``."""
    spread = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)))
    spread.repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def training_arrays(df: DataFrame, on_bits: str = "on_bits", source: str = "source") -> DataFrame:
    """``(fps array<float>, label bigint)`` rows for a training program."""
    return df.select(
        dense_bits(F.col(on_bits)).alias("fps"),
        encode_label(F.col(source)).cast("bigint").alias("label"),
    )


def write_training_arrays(df: DataFrame, path: str, on_bits: str = "on_bits", source: str = "source") -> None:
    """The export as files: rows under ``arrays``, and its description as one JSON record."""
    training_arrays(df, on_bits, source).write.mode("overwrite").parquet(f"{path}/arrays")
    write_record(describe_training_arrays(df.sparkSession.read.parquet(f"{path}/arrays")), f"{path}/description")


def describe_training_arrays(arrays: DataFrame, *more: Column) -> DataFrame:
    """Rows, width and class counts of an export, and ``more`` aggregates in the same pass."""
    return arrays.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.size("fps")).cast("bigint").alias("width"),
        F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("n_pos"),
        F.coalesce(F.sum(1 - F.col("label")), F.lit(0)).cast("bigint").alias("n_neg"),
        *more,
    )
