"""Exact global positions without a single-task sort.

Rows go to many ordered buckets, each bucket numbers its own rows, and the sizes of the earlier
buckets, a table of a few thousand rows, are added. No task sees more than one bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltabula.constants import SEED


def seeded_hash(key: Column, seed: int | str = SEED) -> Column:
    """Reproducible pseudo-random order of keys, the same in any engine."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def seeded_uniform(key: Column, seed: int | str = SEED) -> Column:
    """Reproducible number in [0, 1) from 48 bits of the hash."""
    return F.conv(F.substring(seeded_hash(key, seed), 1, 12), 16, 10).cast("double") / F.lit(float(2**48))


def range_bucket(df: DataFrame, column: str, out: str = "_bucket", levels: int = 10) -> DataFrame:
    """Ordered bucket of a number among ``2**levels`` of about equal size.

    The cut points come from an approximate percentile, so they only set the balance; any cut points
    give the same final positions. They arrive as a scalar subquery of fixed length.
    """
    n = 2**levels
    cuts = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 10 * n)).scalar()
    steps = F.array(*[F.lit(2**i) for i in reversed(range(levels))])
    # binary search: each step moves right while the cut point there is not above the value
    position = F.aggregate(
        steps,
        F.lit(0),
        lambda at, step: F.when(F.element_at("_cuts", at + step) <= F.col(column), at + step).otherwise(at),
    )
    return df.withColumn("_cuts", cuts).withColumn(out, position).drop("_cuts")


def bucket_offsets(sizes: DataFrame, groups: list[str], bucket: str, totals: dict[str, str]) -> DataFrame:
    """For each bucket the sums of the earlier buckets (``_before_x``) and of the group (``_all_x``)."""
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    for name, source in totals.items():
        sizes = sizes.withColumn(f"_before_{name}", F.coalesce(F.sum(source).over(earlier), F.lit(0)))
        sizes = sizes.withColumn(f"_all_{name}", F.sum(source).over(whole))
    return sizes.drop(*set(totals.values()))


def _number(df: DataFrame, bucket: str, order: list[str], groups: list[str], out: str, total: str) -> DataFrame:
    keys = [*groups, bucket]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    offsets = bucket_offsets(sizes, groups, bucket, {"n": "_size"})
    offsets = offsets.select(*[F.col(k).alias(f"_at_{k}") for k in keys], "_before_n", "_all_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # null-safe: a null group counts as a group, and no null test is pushed into the scan to
    # evaluate the hash once more
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys])
    return (
        df.withColumn("_inside", inside)
        .join(offsets, same)
        .withColumn(out, F.col("_inside") + F.col("_before_n"))
        .withColumn(total, F.col("_all_n"))
        .drop("_inside", "_before_n", "_all_n", bucket, *[f"_at_{k}" for k in keys])
    )


def _levels(df: DataFrame) -> int:
    """Binary digits of the number of buckets: at least four for each shuffle partition, and 1,024."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(10, (4 * partitions - 1).bit_length())


def rank_by_hash(df: DataFrame, key: str, groups: list[str] | None = None, seed: int | str = SEED,
                 out: str = "rank", total: str = "n", prefix: int | None = None) -> DataFrame:
    """1-based position by seeded hash of a unique key within groups, and the group size.

    ``prefix`` hex digits make ``16**prefix`` buckets per group. By default they follow the number of shuffle
    partitions, which is set with the data.
    """
    prefix = prefix or (_levels(df) + 3) // 4
    hashed = df.withColumn("_hash", seeded_hash(F.col(key), seed))
    bucketed = hashed.withColumn("_bucket", F.substring("_hash", 1, prefix))
    return _number(bucketed, "_bucket", ["_hash", key], groups or [], out, total).drop("_hash")


def rank_by_value(df: DataFrame, column: str, groups: list[str] | None = None, out: str = "rank",
                  total: str = "n", levels: int | None = None) -> DataFrame:
    """1-based position by a unique number within groups, and the group size; buckets as in ``rank_by_hash``."""
    levels = levels or _levels(df)
    return _number(range_bucket(df, column, levels=levels), "_bucket", [column], groups or [], out, total)
