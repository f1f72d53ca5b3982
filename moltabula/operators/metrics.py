"""Exact classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltabula.functions.vectors import safe_ratio
from moltabula.operators.rank import bucket_offsets, range_bucket
from moltabula.scratch import written


def _confusion(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    one = F.lit(1) if weight is None else weight

    def cell(want_label: int, want_prediction: int, name: str) -> Column:
        hit = (label == want_label) & (predicted == want_prediction)
        return F.coalesce(F.sum(F.when(hit, one).otherwise(0)), F.lit(0)).cast("bigint").alias(name)

    return [cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(1, 1, "tp")]


def _rates(counts: DataFrame) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return (
        counts.withColumn("n_samples", tn + fp + fn + tp)
        .withColumn("accuracy", safe_ratio(tn + tp, tn + fp + fn + tp))
        .withColumn("precision", safe_ratio(tp, tp + fp))
        .withColumn("recall", safe_ratio(tp, tp + fn))
        .withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))
    )


def confusion_report(df: DataFrame, label: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: tn, fp, fn, tp, n_samples, accuracy, precision, recall, f1; 0 for an empty denominator."""
    return _rates(df.agg(*_confusion(F.col(label), F.col(predicted))))


def score_groups(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before the shuffle.

    Rows without a score are in no count, here and so in all reports.
    """
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"),
        F.count_if(F.col(label) == 0).alias("neg"),
    )


def cumulative_groups(groups: DataFrame, levels: int = 10) -> DataFrame:
    """Each score with the positives and negatives strictly below it and in all.

    The prefix sums run inside score buckets; the sums of the earlier buckets come from a table of
    ``2**levels`` rows, so no task sees all scores.
    """
    # cut points, bucket sums and the sums inside buckets all read the groups, so the scores behind
    # them are computed once
    bucketed = range_bucket(written(groups, "scores"), "score", levels=levels)
    sizes = bucketed.groupBy("_bucket").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    offsets = bucket_offsets(sizes, [], "_bucket", {"pos": "_p", "neg": "_n"})
    below = Window.partitionBy("_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.withColumn("_ip", F.coalesce(F.sum("pos").over(below), F.lit(0))).withColumn(
        "_in", F.coalesce(F.sum("neg").over(below), F.lit(0))
    )
    return inside.join(offsets, "_bucket").select(
        "score", "pos", "neg",
        (F.col("_ip") + F.col("_before_pos")).cast("double").alias("pos_below"),
        (F.col("_in") + F.col("_before_neg")).cast("double").alias("neg_below"),
        F.col("_all_pos").cast("double").alias("all_pos"),
        F.col("_all_neg").cast("double").alias("all_neg"),
    )


def _ranking() -> list[Column]:
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    p, n = F.max("all_pos"), F.max("all_neg")
    wins = F.sum(pos * (F.col("neg_below") + neg / 2))
    auc = F.when((p > 0) & (n > 0), F.try_divide(wins, p * n)).alias("roc_auc")
    # at threshold = score, everything not below it is predicted positive
    precision = (F.col("all_pos") - F.col("pos_below")) / (
        F.col("all_pos") - F.col("pos_below") + F.col("all_neg") - F.col("neg_below")
    )
    ap = F.when(p > 0, F.try_divide(F.sum(pos * precision), p)).otherwise(F.when(n > 0, 0.0))
    return [auc, ap.alias("average_precision")]


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """One row with the ROC AUC (ties half, null for one class) and the average precision."""
    return cumulative_groups(score_groups(df, label, score)).agg(*_ranking())


def roc_auc(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return ranking_metrics(df, label, score).select("average_precision")


def eval_report(df: DataFrame, label: str = "label", score: str = "score", threshold: float = 0.5,
                **constants: str) -> DataFrame:
    """The whole report of a scored table in one row.

    The decision is score >= threshold. Confusion counts and ranking metrics come from the same
    per-score counts. ``constants`` adds text columns such as paths.
    """
    groups = cumulative_groups(score_groups(df, label, score))
    predicted = (F.col("score") >= threshold).cast("int")
    cells = _confusion(F.lit(1), predicted, F.col("pos"))[2:] + _confusion(F.lit(0), predicted, F.col("neg"))[:2]
    report = _rates(groups.agg(*cells, *_ranking()))
    for name, value in constants.items():
        report = report.withColumn(name, F.lit(value))
    return report


def neighbour_report(df: DataFrame, label: str = "label", predicted: str = "pred_label",
                     score: str | None = None) -> DataFrame:
    """Metrics of a nearest-neighbour result; by default the hard prediction is also the score.

    A hard prediction has two thresholds, so its ranking metrics follow from the confusion counts and
    the predictions are evaluated once.
    """
    counts = confusion_report(df, label, predicted)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    pos, neg = tp + fn, tn + fp
    if score is None:
        auc = F.when((pos > 0) & (neg > 0), (F.try_divide(tp, pos) + F.try_divide(tn, neg)) / 2)
        hit = safe_ratio(tp, pos)
        ap = F.when(pos > 0, hit * safe_ratio(tp, tp + fp) + (1 - hit) * pos / (pos + neg)).when(neg > 0, 0.0)
    else:
        ranking = written(ranking_metrics(df, label, score), "ranking")
        auc, ap = (ranking.select(c).scalar() for c in ("roc_auc", "average_precision"))
    return counts.select(
        F.col("accuracy").alias("acc"),
        auc.alias("auroc"),
        ap.alias("auprc"),
        F.col("n_samples").alias("n_rows"),
        (F.col("tp") + F.col("fn")).alias("n_pos"),
    )


def best_epoch(history: DataFrame, epoch: str, metric: str, groups: list[str] | None = None) -> DataFrame:
    """The epoch with the highest metric, the first one on ties; null metrics never win."""
    best = F.max(F.struct(F.col(metric).alias("m"), (-F.col(epoch)).alias("e"))).alias("_best")
    known = history.filter(F.col(metric).isNotNull())
    return known.groupBy(*(groups or [])).agg(best).select(
        *(groups or []),
        (-F.col("_best.e")).alias(f"best_{epoch}"),
        F.col("_best.m").alias(f"best_{metric}"),
    )
