"""Chunks, batches, exact samples and balanced resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltabula.constants import SEED
from moltabula.operators.rank import rank_by_hash, rank_by_value, seeded_uniform


def even_chunks(df: DataFrame, ordinal: str, parts: int, out: str = "chunk") -> DataFrame:
    """Contiguous chunks by ordinal; the first n mod parts are one longer, and none is empty."""
    ranked = rank_by_value(df, ordinal, out="_rank", total="_n")
    count = F.least(F.lit(parts).cast("bigint"), F.col("_n"))
    at, short = F.col("_rank") - 1, F.floor(F.col("_n") / count)
    longer = F.col("_n") % count
    in_long = longer * (short + 1)
    chunk = F.when(at < in_long, F.floor(at / (short + 1))).otherwise(longer + F.floor((at - in_long) / short))
    return ranked.withColumn(out, chunk.cast("bigint")).drop("_rank", "_n")


def _batched(ranked: DataFrame, size: int, drop_last: bool, out: str) -> DataFrame:
    batch = F.floor((F.col("_rank") - 1) / size)
    rows = ranked.withColumn(out, batch.cast("bigint"))
    if drop_last:
        rows = rows.filter((F.col(out) + 1) * size <= F.col("_n"))
    return rows.drop("_rank", "_n")


def fixed_batches(df: DataFrame, ordinal: str, size: int, drop_last: bool = False, out: str = "batch") -> DataFrame:
    """Batches of ``size`` rows in ordinal order; ``drop_last`` leaves out a short last one."""
    return _batched(rank_by_value(df, ordinal, out="_rank", total="_n"), size, drop_last, out)


def epoch_batches(df: DataFrame, key: str, size: int, epoch: int, seed: int = SEED, drop_last: bool = False,
                  out: str = "batch") -> DataFrame:
    """Batches in an order that depends on the seed and the epoch; ``key`` is unique."""
    ranked = rank_by_hash(df, key, seed=f"{seed}|{epoch}", out="_rank", total="_n")
    return _batched(ranked, size, drop_last, out)


def head_cap(df: DataFrame, ordinal: str, limit: int | None) -> DataFrame:
    """The first ``limit`` rows by ordinal, or all rows without a limit.

    The cut is a comparison on positions, so a large head stays spread over the tasks.
    """
    if limit is None:
        return df
    return rank_by_value(df, ordinal, out="_rank", total="_n").filter(F.col("_rank") <= limit).select(*df.columns)


def stratified_cap(df: DataFrame, key: str, label: str, limit: int, seed: int = SEED) -> DataFrame:
    """About ``limit`` rows with the class shares of the whole table; a unique key sets the order."""
    total = df.agg(F.count(F.lit(1))).scalar()
    ranked = rank_by_hash(df, key, [label], seed, out="_rank", total="_n").withColumn("_all", total)
    quota = F.ceil(F.lit(limit) * F.col("_n") / F.col("_all"))
    return ranked.filter(F.col("_rank") <= quota).select(*df.columns)


def sample_exact(df: DataFrame, key: str, n: int, seed: int = SEED) -> DataFrame:
    """min(n, rows) rows without replacement, reproducible for a unique key."""
    return rank_by_hash(df, key, seed=seed, out="_rank", total="_n").filter(F.col("_rank") <= n).select(*df.columns)


def weighted_resample(df: DataFrame, ordinal: str, label: str = "label", seed: int = SEED,
                      draws: int | None = None) -> DataFrame:
    """As many draws with replacement as there are rows, each class with the same expected share.

    A weight of 1 / class count means: pick a class evenly, then a row of it evenly. So a draw is a
    class and a position in it, and one equi-join on (class, position) finds the row. Draw ``i`` is
    numbered by the row at global position ``i``, which needs no count on the driver.
    """
    rows = rank_by_value(df, ordinal, [label], out="_rank", total="_n")
    sizes = df.agg(F.struct(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")))
    if draws is None:
        numbers = rank_by_value(df.select(ordinal), ordinal, out="draw", total="_n").select("draw")
    else:
        numbers = df.sparkSession.range(1, draws + 1).withColumnRenamed("id", "draw")
    share = F.col("_sizes.n0").cast("double"), F.col("_sizes.n1").cast("double")
    positive = F.when(share[1] == 0, F.lit(0)).when(share[0] == 0, F.lit(1)).otherwise(
        (seeded_uniform(F.col("draw"), f"{seed}|class") >= 0.5).cast("int")
    )
    place = F.floor(seeded_uniform(F.col("draw"), f"{seed}|row") * F.when(F.col(label) == 1, share[1]).otherwise(share[0]))
    drawn = (
        numbers.withColumn("_sizes", sizes.scalar())
        .withColumn(label, positive)
        .withColumn("_rank", (place + 1).cast("bigint"))
        .drop("_sizes")
    )
    picked = rows.withColumn(label, F.col(label).cast("int")).drop("_n")
    return drawn.join(picked, [label, "_rank"]).select("draw", *df.columns)
