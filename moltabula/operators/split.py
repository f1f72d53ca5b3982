"""Labels per key, class counts and the leakage-free stratified split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltabula.constants import HOLDOUT_FRACTION, MIN_PER_CLASS, SEED
from moltabula.operators.rank import rank_by_hash


def label_any(df: DataFrame, key: str, positive: Column, out: str = "label") -> DataFrame:
    """One row per non-null key: 1 when any of its rows is positive."""
    rows = df.filter(F.col(key).isNotNull()).select(key, positive.cast("int").alias("_positive"))
    return rows.groupBy(key).agg(F.max(F.coalesce("_positive", F.lit(0))).alias(out))


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def smallest_class(df: DataFrame, label: str = "label") -> DataFrame:
    return class_counts(df, label).agg(F.coalesce(F.min("n"), F.lit(0)).alias("n"))


def domain_counts(df: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Row counts over a fixed list of values, with 0 for the absent ones."""
    sums = df.agg(*[
        F.coalesce(F.count_if(F.col(column) == value), F.lit(0)).alias(f"_{i}") for i, value in enumerate(domain)
    ])
    pairs = F.array(*[F.struct(F.lit(v).alias(column), F.col(f"_{i}").alias("n")) for i, v in enumerate(domain)])
    return sums.select(F.inline(pairs))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Three weightings of a 0/1 label, one row per class.

    ``balanced`` is n / (2 n_c), ``positive_weight`` is negatives per positive with both counts
    floored at 1, and ``inverse`` is 1 / n_c.
    """
    both = df.agg(
        F.count_if(F.col(label) == 0).alias("n0"),
        F.count_if(F.col(label) == 1).alias("n1"),
    )
    floor = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    positive_weight = floor("n0") / floor("n1")

    def row(value: int, own: str) -> Column:
        n_c = F.col(own).cast("double")
        return F.struct(
            F.lit(value).alias(label),
            F.col(own).alias("n"),
            F.try_divide((F.col("n0") + F.col("n1")).cast("double"), 2 * n_c).alias("balanced"),
            positive_weight.alias("positive_weight"),
            (1.0 / (n_c + 1e-12)).alias("inverse"),
        )

    return both.select(F.inline(F.array(row(0, "n0"), row(1, "n1"))))


def with_balanced_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """Each row with the balanced weight of its class; two numbers, so scalar subqueries carry them."""
    counts = df.agg(
        F.struct(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).alias("c")
    )
    own = F.when(F.col(label) == 1, F.col("_c.n1")).otherwise(F.col("_c.n0"))
    total = (F.col("_c.n0") + F.col("_c.n1")).cast("double")
    return df.withColumn("_c", counts.scalar()).withColumn(out, total / (2.0 * own)).drop("_c")


def stratified_split(keys: DataFrame, key: str = "smiles", label: str = "label", seed: int = SEED,
                     holdout: float = HOLDOUT_FRACTION, min_per_class: int = MIN_PER_CLASS) -> DataFrame:
    """Exact train / val / test sizes per class over unique keys.

    Each class is cut by its own hash order: the first n - ceil(holdout n) keys train, the rest is
    halved with the odd key going to test. When a class has fewer than ``min_per_class`` keys all
    keys are cut as one class.
    """
    rows = keys.filter(F.col(key).isNotNull())
    enough = smallest_class(rows, label).select(F.col("n") >= min_per_class).scalar()
    grouped = rows.withColumn("_stratum", F.when(enough, F.col(label).cast("string")).otherwise(F.lit("all")))
    ranked = rank_by_hash(grouped, key, ["_stratum"], seed, out="_rank", total="_n")
    held = F.ceil(F.round(F.col("_n") * F.lit(holdout), 9))
    test = F.ceil(held / 2)
    split = (
        F.when(F.col("_rank") <= F.col("_n") - held, "train")
        .when(F.col("_rank") <= F.col("_n") - test, "val")
        .otherwise("test")
    )
    return ranked.withColumn("split", split).select(*keys.columns, "split")


def can_stratify(keys: DataFrame, label: str = "label", min_per_class: int = MIN_PER_CLASS) -> bool:
    """Whether every class is large enough; runs a count, for callers that want to warn."""
    return smallest_class(keys, label).first()["n"] >= min_per_class


def assign_splits(df: DataFrame, assignments: DataFrame, key: str = "smiles") -> DataFrame:
    """All rows, copies included, with the split of their key.

    One equi-join on a unique side; a hot key is spread by adaptive skew-join splitting.
    """
    return df.join(assignments.select(key, "split"), key)
