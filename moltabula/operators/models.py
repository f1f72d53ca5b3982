"""Training and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltabula.constants import N_BITS
from moltabula.functions.labels import decode_label
from moltabula.functions.vectors import as_doubles, sigmoid
from moltabula.operators.metrics import ranking_metrics
from moltabula.operators.rank import seeded_hash
from moltabula.operators.split import class_weights, with_balanced_weight
from moltabula.scratch import scratch_path, written


def train_linear(df: DataFrame, features: str = "features", label: str = "label", c: float = 1.0,
                 max_iter: int = 2000, tol: float = 1e-6) -> LogisticRegressionModel:
    """L2 logistic regression with balanced class weights and a free intercept.

    The loss is C sum w l + |b|^2 / 2. Spark averages the loss over the weights, and balanced weights
    sum to n, so its penalty is 1 / (C n). The model comes without its training summary, which would hold
    on to the session and could then not be sent to the executors.
    """
    weighted = written(with_balanced_weight(df.select(features, label), label), "training")
    n = weighted.count()
    estimator = LogisticRegression(
        featuresCol=features, labelCol=label, weightCol="weight", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, tol=tol,
    )
    path = scratch_path(df.sparkSession, "linear")
    estimator.fit(weighted).write().save(path)
    return LogisticRegressionModel.load(path)


def coefficients(model: LogisticRegressionModel, spark: SparkSession) -> DataFrame:
    """``(feature, weight)`` with the intercept as feature -1; as long as the feature width."""
    values = [(-1, float(model.intercept))] + [(i, float(w)) for i, w in enumerate(model.coefficients.toArray())]
    return spark.createDataFrame(values, "feature int, weight double")


def score_linear(model, df: DataFrame, out: str = "score") -> DataFrame:
    """P(y = 1) per row."""
    scored = model.transform(df)
    extra = [c for c in ("rawPrediction", "probability", "prediction") if c in scored.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*extra)


def score_from_weights(df: DataFrame, weights: DataFrame, on_bits: str = "on_bits", out: str = "score",
                       n_bits: int = N_BITS) -> DataFrame:
    """Sigmoid of the weight sum of the set bits, from a ``(feature, weight)`` table with intercept -1.

    The table becomes one array value of ``n_bits + 1`` numbers, the intercept first.
    """
    known = weights.agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature").cast("int"), "weight"))).alias("m"))
    places = F.sequence(F.lit(-1), F.lit(n_bits - 1))
    lookup = known.select(F.transform(places, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)))).scalar()
    terms = F.transform(on_bits, lambda b: F.get("_w", b.cast("int") + 1))
    margin = F.get("_w", F.lit(0)) + F.aggregate(terms, F.lit(0.0), lambda acc, w: acc + w)
    return df.withColumn("_w", lookup).withColumn(out, sigmoid(margin)).drop("_w")


def _chunk_gradient(on_bits: str, label: str, weight: str, coefficients_: np.ndarray, bias: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(coefficients_) + 1)
        mass = 0.0
        for batch in batches:
            lengths = batch[on_bits].map(len).to_numpy()
            if not len(lengths):
                continue
            bits = np.concatenate(batch[on_bits].to_list()).astype(np.int64)
            rows = np.repeat(np.arange(len(lengths)), lengths)
            margin = np.bincount(rows, weights=coefficients_[bits], minlength=len(lengths)) + bias
            error = (1.0 / (1.0 + np.exp(-margin)) - batch[label].to_numpy()) * batch[weight].to_numpy()
            total[:-1] += np.bincount(bits, weights=error[rows], minlength=len(coefficients_))
            total[-1] += error.sum()
            mass += batch[weight].sum()
        at = np.flatnonzero(total)
        yield pd.DataFrame({"feature": np.append(at, -1), "part": np.append(total[at], mass)})

    return run


def train_incremental(df: DataFrame, key: str, on_bits: str = "on_bits", label: str = "label", n_bits: int = N_BITS,
                      chunks: int = 10, alpha: float = 1e-4, rate: float = 1.0, seed: int = 42) -> DataFrame:
    """One pass of log-loss gradient steps over hashed chunks; ``(feature, weight)`` with intercept -1.

    Every task sums the gradient of its rows, the sums meet per feature on the cluster, and the
    driver holds only the weights. Rows are written once by chunk, so a step reads its chunk alone.
    """
    weighted = with_balanced_weight(df.select(key, on_bits, label), label, "_weight")
    chunk = F.conv(F.substring(seeded_hash(F.col(key), seed), 1, 8), 16, 10).cast("bigint") % chunks
    slice_of_chunk = F.pmod(F.xxhash64(key), F.lit(64))
    numbered = weighted.withColumn("_chunk", chunk.cast("int")).repartition("_chunk", slice_of_chunk).drop(key)
    stored = written(numbered, "chunks", ["_chunk"])
    weights, bias = np.zeros(n_bits), 0.0
    for step in range(chunks):
        rows = stored.filter(F.col("_chunk") == step).select(on_bits, label, "_weight")
        parts = rows.mapInPandas(_chunk_gradient(on_bits, label, "_weight", weights, bias), "feature int, part double")
        sums = {r["feature"]: r["s"] for r in parts.groupBy("feature").agg(F.sum("part").alias("s")).collect()}
        mass = sums.pop(-1, 0.0)
        if not mass or not sums:
            continue
        size = rate / np.sqrt(step + 1.0)
        gradient = np.zeros(n_bits + 1)
        gradient[list(sums)] = [value / mass for value in sums.values()]
        weights -= size * (gradient[:-1] + alpha * weights)
        bias -= size * gradient[-1]
    table = [(-1, float(bias))] + [(i, float(w)) for i, w in enumerate(weights)]
    return df.sparkSession.createDataFrame(table, "feature int, weight double")


def train_mlp(train: DataFrame, validation: DataFrame, features: str = "features", label: str = "label",
              width: int = 2048, hidden: tuple[int, ...] = (512, 256), iterations: tuple[int, ...] = (10, 25),
              seed: int = 42):
    """Feed-forward classifier; of several training lengths the one with the best validation AP is kept.

    Class balance comes from the rows, so pass resampled ones. Returns the model and its history
    as ``(epoch, val_ap)`` rows.
    """
    history, models = [], {}
    for steps in iterations:
        estimator = MultilayerPerceptronClassifier(
            featuresCol=features, labelCol=label, layers=[width, *hidden, 2], maxIter=steps, seed=seed, blockSize=128
        )
        models[steps] = estimator.fit(train.select(features, label))
        scored = score_linear(models[steps], validation.select(features, label))
        ap = ranking_metrics(scored, label, "score").first()["average_precision"]
        history.append((steps, float(ap if ap is not None else 0.0)))
    best = max(history, key=lambda row: (row[1], -row[0]))[0]
    return models[best], train.sparkSession.createDataFrame(history, "epoch int, val_ap double")


def train_mlp_epochs(train: DataFrame, validation: DataFrame, features: str = "features", label: str = "label", width: int = 2048,
                     hidden: tuple[int, ...] = (512, 256), epochs: int = 25, steps: int = 2, seed: int = 42):
    """One feed-forward network over ``epochs`` epochs of ``steps`` solver steps, each going on from the weights of the epoch before.

    Returns the model of the epoch with the best validation average precision, the first one on ties, and the history ``(epoch, train_loss,
    val_ap)``. Rows are stored once for all epochs; the driver holds the weights of the network only. Without validation rows ``val_ap`` is null and
    the last epoch is kept.
    """
    if epochs < 1 or steps < 1:
        raise ValueError("epochs and steps must be at least 1")
    rows = written(train.select(features, label), "epochs-train")
    held_out = written(validation.select(features, label), "epochs-validation")
    history, best, kept, weights = [], None, None, None
    for epoch in range(1, epochs + 1):
        estimator = MultilayerPerceptronClassifier(
            featuresCol=features, labelCol=label, layers=[width, *hidden, 2], maxIter=steps, seed=seed, blockSize=128
        )
        if weights is not None:
            estimator.setInitialWeights(weights)
        model = estimator.fit(rows)
        weights = model.weights
        loss = model.summary().objectiveHistory[-1]
        ap = ranking_metrics(score_linear(model, held_out), label, "score").first()["average_precision"]
        history.append((epoch, float(loss), None if ap is None else float(ap)))
        if best is None or ap is None or ap > best:
            best, kept = ap, model
    return kept, train.sparkSession.createDataFrame(history, "epoch int, train_loss double, val_ap double")


def linear_probe(df: DataFrame, vector: str, label: str = "label", held_out: DataFrame | None = None,
                 max_iter: int = 1000) -> DataFrame:
    """Average precision of a balanced linear model on embeddings.

    It is scored on the rows it was fitted on, or on ``held_out`` rows. With a single class there is
    no model and the value is null.
    """
    ready = lambda rows: rows.select(
        array_to_vector(as_doubles(F.col(vector))).alias("features"), F.col(label).cast("int").alias("label")
    )
    train = ready(df)
    if train.select("label").distinct().count() < 2:
        return df.sparkSession.createDataFrame([(None,)], "average_precision double")
    model = train_linear(train, max_iter=max_iter, tol=1e-6)
    scored = score_linear(model, train if held_out is None else ready(held_out))
    return ranking_metrics(scored).select("average_precision")


def project_2d(df: DataFrame, vector: str = "features", label: str = "label",
               columns: tuple[str, ...] = ("smiles", "source", "split")) -> DataFrame:
    """Two principal components of an ML vector column, in the six-column embedding form."""
    model = PCA(k=2, inputCol=vector, outputCol="_pc").fit(df)
    placed = model.transform(df).withColumn("_xy", vector_to_array("_pc"))
    return placed.select(
        *columns,
        F.col("_xy")[0].alias("component_1"),
        F.col("_xy")[1].alias("component_2"),
        decode_label(F.col(label)).alias("is_pks"),
    )


def model_metadata(df: DataFrame, label: str, feature_columns: list[str], **settings: str) -> DataFrame:
    """One row: features, label map, train rows, class counts and class weights, and text settings."""
    counts = class_weights(df, label)
    name = decode_label(F.col(label))
    row = counts.agg(
        F.map_from_entries(F.collect_list(F.struct(name, F.col(label)))).alias("label_mapping"),
        F.sum("n").alias("train_rows"),
        F.map_from_entries(F.collect_list(F.struct(name, F.col("n")))).alias("class_counts"),
        F.map_from_entries(F.collect_list(F.struct(name, F.col("balanced")))).alias("class_weight"),
    )
    row = row.withColumn("feature_columns", F.array(*[F.lit(c) for c in feature_columns]))
    for key, value in settings.items():
        row = row.withColumn(key, F.lit(value))
    return row


def save_model(model, metadata: DataFrame, path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def save_weights(weights: DataFrame, metadata: DataFrame, path: str) -> None:
    """A ``(feature, weight)`` table, as incremental training gives it, with its metadata."""
    weights.coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")
    metadata.coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def load_weights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/weights"), spark.read.parquet(f"{path}/metadata")


def load_linear(spark: SparkSession, path: str) -> tuple[LogisticRegressionModel, DataFrame]:
    return LogisticRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/metadata")
