"""Label columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltabula.constants import NEGATIVE, POSITIVE


def encode_label(source: Column, positive: str = POSITIVE) -> Column:
    """1 for the positive source, 0 for any other value and for null."""
    return F.coalesce((source.cast("string") == F.lit(positive)).cast("int"), F.lit(0))


def decode_label(label: Column, positive: str = POSITIVE, negative: str = NEGATIVE) -> Column:
    return F.when(label == 1, F.lit(positive)).otherwise(F.lit(negative))


def ensure_label_name(df: DataFrame, out: str = "is_pks") -> DataFrame:
    """Keep a stored label name, else derive it from ``source``, else fail."""
    if out in df.columns:
        return df.withColumn(out, F.col(out).cast("string"))
    if "source" in df.columns:
        return df.withColumn(out, decode_label(encode_label(F.col("source"))))
    raise ValueError(f"need a '{out}' or a 'source' column, got {df.columns}")
