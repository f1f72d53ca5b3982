"""Checks on finished split tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moltabula.constants import FORBIDDEN_CHARACTERS, RATIO_TOLERANCE, SPLITS
from moltabula.functions.text import contains_any, strip
from moltabula.functions.vectors import safe_ratio


def key_memberships(df: DataFrame, key: str, splits: tuple[str, ...] = SPLITS, split: str = "split") -> DataFrame:
    """One row per stripped key with a flag per split; flags merge map-side, so copies do not pile up."""
    rows = df.select(strip(F.col(key)).alias(key), split).filter(F.col(key).isNotNull())
    return rows.groupBy(key).agg(*[F.max((F.col(split) == s).cast("int")).alias(s) for s in splits])


def leaked_keys(df: DataFrame, key: str, splits: tuple[str, ...] = SPLITS, split: str = "split") -> DataFrame:
    """Keys that occur in two splits, one row per pair of splits."""
    flags = key_memberships(df, key, splits, split)
    pairs = F.array(*[
        F.when((F.col(a) == 1) & (F.col(b) == 1), F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")))
        for a, b in combinations(splits, 2)
    ])
    return flags.select(key, F.explode(F.array_compact(pairs)).alias("_pair")).select(key, "_pair.*")


def split_leakage(df: DataFrame, key: str, splits: tuple[str, ...] = SPLITS, split: str = "split") -> DataFrame:
    """Number of shared keys for every pair of splits, zeros included."""
    flags = key_memberships(df, key, splits, split)
    pairs = list(combinations(splits, 2))
    sums = flags.agg(*[
        F.count_if((F.col(a) == 1) & (F.col(b) == 1)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)
    ])
    rows = F.array(*[
        F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"_{i}").alias("n_shared"))
        for i, (a, b) in enumerate(pairs)
    ])
    return sums.select(F.inline(rows))


def forbidden_rows(df: DataFrame, column: str, characters: tuple[str, ...] = FORBIDDEN_CHARACTERS) -> DataFrame:
    return df.filter(contains_any(F.col(column), characters))


def first_offenders(df: DataFrame, split: str, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows per split; the rank limit is applied before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(split).orderBy(order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def split_ratio_check(df: DataFrame, label: str, split: str = "split", splits: tuple[str, ...] = SPLITS,
                      tolerance: float = RATIO_TOLERANCE) -> DataFrame:
    """Positive share of every split and its difference for every pair, in one aggregate."""
    counts = df.agg(*[
        c
        for i, s in enumerate(splits)
        for c in (
            F.count_if(F.col(split) == s).alias(f"_n{i}"),
            F.count_if((F.col(split) == s) & (F.col(label) == 1)).alias(f"_p{i}"),
        )
    ])
    ratios = counts.select(*[safe_ratio(F.col(f"_p{i}"), F.col(f"_n{i}")).alias(f"_r{i}") for i in range(len(splits))])
    rows = F.array(*[
        F.struct(
            F.lit(splits[i]).alias("left"),
            F.lit(splits[j]).alias("right"),
            F.col(f"_r{i}").alias("ratio_left"),
            F.col(f"_r{j}").alias("ratio_right"),
            F.abs(F.col(f"_r{i}") - F.col(f"_r{j}")).alias("difference"),
            (F.abs(F.col(f"_r{i}") - F.col(f"_r{j}")) <= tolerance).alias("within"),
        )
        for i, j in combinations(range(len(splits)), 2)
    ])
    return ratios.select(F.inline(rows))


def pipeline_counts(df: DataFrame, raw: str, key: str, source: str) -> DataFrame:
    """Rows loaded, rows dropped for lack of a key, and distinct keys, per source."""
    per_key = df.groupBy(source, key).agg(F.count(F.lit(1)).alias("_n"), F.count(F.col(raw)).alias("_raw"))
    return per_key.groupBy(source).agg(
        F.sum("_n").alias("n_loaded"),
        F.sum("_raw").alias("n_not_null"),
        F.sum(F.when(F.col(key).isNull(), F.col("_n")).otherwise(0)).alias("n_dropped"),
        F.count(F.col(key)).alias("n_keys"),
    )
