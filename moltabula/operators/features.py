"""Feature statistics and scaling of dense vectors."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.functions.vectors import as_doubles, l2_normalize, standardize

EPS = 1e-8


def _moments(df: DataFrame, vector: str) -> DataFrame:
    """One row with the arrays ``mean`` and ``std`` (population, plus a small constant).

    The summary merges partial sums per task; nothing is exploded. It gives the sample variance, so
    that is scaled back to the population.
    """
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(as_doubles(F.col(vector))))
    row = df.select(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("v"), F.col("s.count").alias("n")
    )
    shrink = (F.col("n") - 1) / F.col("n")
    std = F.transform("v", lambda v: F.sqrt(v * shrink) + F.lit(EPS))
    return row.select("mean", std.alias("std"))


def feature_stats(df: DataFrame, vector: str) -> DataFrame:
    """``(feature, mean, std)`` per position."""
    pairs = F.arrays_zip("mean", "std")
    return _moments(df, vector).select(F.posexplode(pairs).alias("feature", "s")).select("feature", "s.mean", "s.std")


def standardize_with(df: DataFrame, train: DataFrame, vector: str, out: str = "scaled") -> DataFrame:
    """Scale with the statistics of the train rows only, for any split."""
    stats = _moments(train, vector).select(F.struct("mean", "std")).scalar()
    rows = df.withColumn("_stats", stats)
    return rows.withColumn(out, standardize(F.col(vector), F.col("_stats.mean"), F.col("_stats.std"))).drop("_stats")


def normalize_rows(df: DataFrame, vector: str, out: str = "unit") -> DataFrame:
    return df.withColumn(out, l2_normalize(F.col(vector)))
