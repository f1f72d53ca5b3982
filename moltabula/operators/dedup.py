"""Class-aware dedup, first-seen rules and combining producers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.constants import RELEASE_EXCLUDED, SOURCES


def compile_dedup(df: DataFrame, key: str = "smiles", source: str = "source",
                  priority: tuple[str, ...] = SOURCES) -> DataFrame:
    """Positive rows with all their copies, and one row per key of the others.

    The first name in ``priority`` is the positive source. Of the others a key keeps its earliest
    source in that order, which is what keep-first gives after a concat in the same order. Sources that
    are not listed come after those that are, by name, and null last. Copies meet in a partial
    aggregate, so a hot key costs one row per task.
    """
    positive, *others = priority
    listed = F.array_position(F.array(*[F.lit(name) for name in others]), F.col(source))
    order = F.when(F.col(source).isNull(), len(others) + 2).when(listed > 0, listed).otherwise(len(others) + 1)
    kept = df.filter(F.col(source) == positive).select(key, source)
    rest = (
        df.filter(~F.col(source).eqNullSafe(F.lit(positive)))
        .groupBy(key)
        .agg(F.min(F.struct(order.alias("order"), F.col(source).alias("source"))).alias("_first"))
        .select(key, F.col("_first.source").alias(source))
    )
    return kept.unionByName(rest)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key in a given order, as a minimum of structs rather than a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(packed).select(*keys, "_first.*").select(*df.columns)


def first_seen_last_wins(df: DataFrame, design: str, product: str, order: list[str],
                         exclude: tuple = RELEASE_EXCLUDED) -> DataFrame:
    """One product per design, and how many were counted for it.

    A product counts only where it is seen first in (design, *order); a design keeps the last
    product that counted. Both steps are struct minima and maxima.
    """
    usable = df.filter(F.col(product).isNotNull())
    if exclude:
        usable = usable.filter(~F.col(product).isin(*exclude))
    place = F.struct(F.col(design), *[F.col(c) for c in order])
    first = usable.groupBy(product).agg(F.min(place).alias("_place"))
    return (
        first.groupBy(F.col(f"_place.{design}").alias(design))
        .agg(F.max_by(product, "_place").alias(product), F.count(F.lit(1)).alias("n_counted"))
    )


def distinct_values(producers: list[DataFrame], column: str) -> DataFrame:
    """Set union of one column over several producers."""
    columns = [df.select(column) for df in producers]
    return reduce(DataFrame.unionByName, columns).distinct()


def exclude_values(df: DataFrame, column: str, values: tuple, drop_blank: bool = True) -> DataFrame:
    """Rows whose value is not in a short constant list and, by default, not blank or null."""
    keep = ~F.col(column).isin(*values)
    if drop_blank:
        keep = keep & (F.col(column) != "")
    return df.filter(keep)


def exclude_table(df: DataFrame, column: str, unwanted: DataFrame, unwanted_column: str) -> DataFrame:
    """The same against a table; nulls on either side never match."""
    names = unwanted.select(F.col(unwanted_column).alias("_unwanted")).filter("_unwanted is not null").distinct()
    return df.join(names, F.col(column) == F.col("_unwanted"), "left_anti")


def restrict_to(df: DataFrame, column: str, allowed: DataFrame | None, allowed_column: str) -> DataFrame:
    """Rows whose key is in an allow-list table; without a list, all rows."""
    if allowed is None:
        return df
    names = allowed.select(F.col(allowed_column).alias("_allowed"))
    return df.join(names, F.col(column) == F.col("_allowed"), "left_semi")


def drop_failed(df: DataFrame, column: str, observation=None) -> DataFrame:
    """Rows whose derived value is not null; an ``Observation`` counts both kinds on the same pass."""
    if observation is not None:
        df = df.observe(
            observation,
            F.count(F.lit(1)).alias("n_seen"),
            F.count_if(F.col(column).isNull()).alias("n_failed"),
        )
    return df.filter(F.col(column).isNotNull())
