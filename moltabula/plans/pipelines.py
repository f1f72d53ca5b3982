"""The stages put together; every function returns lazy tables unless it says that it writes."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltabula.constants import FINGERPRINT_SUFFIX, HELPER_VALUES, SPLIT_FILE, SPLITS
from moltabula.functions.labels import decode_label, encode_label
from moltabula.functions.text import normalize_key
from moltabula.operators.dedup import compile_dedup, first_seen_last_wins
from moltabula.operators.fingerprint import bit_vectors, hash_fingerprint
from moltabula.operators.metrics import eval_report, neighbour_report
from moltabula.operators.models import model_metadata, save_model, score_linear, train_linear
from moltabula.operators.rules import Rule, apply_rules, expand_one_step
from moltabula.operators.similarity import tanimoto_nn
from moltabula.operators.split import assign_splits, can_stratify, label_any, stratified_split
from moltabula.scratch import written
from moltabula.sources.readers import read_lines, tagged_union
from moltabula.sources.writers import write_record, write_table


def release(designs: DataFrame, text: str, design: str, rules: list[Rule]) -> DataFrame:
    """One released product per design from ordered release rules."""
    made = apply_rules(designs, text, rules, chain=True)
    products = made.withColumn("product", normalize_key(F.col("product")))
    return first_seen_last_wins(products, design, "product", ["rule_order", "site"])


def expand(products: DataFrame, column: str, bio_rules: list[Rule], chem_rules: list[Rule]) -> dict[str, DataFrame]:
    """The two candidate sets: the first keeps helpers, the second drops them."""
    return {
        "bio": expand_one_step(products, column, bio_rules),
        "chem": expand_one_step(products, column, chem_rules, exclude=HELPER_VALUES),
    }


def compile_molecules(producers: dict[str, DataFrame], column: str = "smiles") -> DataFrame:
    """``(smiles, source)`` from one table per source: normalised, invalid keys dropped, deduplicated."""
    named = {name: df.select(normalize_key(F.col(column)).alias("smiles")) for name, df in producers.items()}
    rows = tagged_union(named, "source").filter(F.col("smiles").isNotNull())
    return compile_dedup(rows)


def compile_from_files(spark: SparkSession, products: DataFrame, bio_path: str, chem_path: str) -> DataFrame:
    return compile_molecules({
        "PKS": products.select(F.col("smiles").cast("string")),
        "bio": read_lines(spark, bio_path, "smiles"),
        "chem": read_lines(spark, chem_path, "smiles"),
    })


def split_molecules(molecules: DataFrame, key: str = "smiles", warn: bool = False) -> DataFrame:
    """All rows with ``split``; all copies of a key land in one split."""
    keys = label_any(molecules, key, encode_label(F.col("source")) == 1)
    if warn and not can_stratify(keys):
        warnings.warn("a class has too few keys: splitting without strata", stacklevel=2)
    return assign_splits(molecules, stratified_split(keys, key), key)


def write_splits(molecules: DataFrame, base: str, suffix: str = "", fmt: str = "parquet") -> None:
    """One file set per split, in the usual layout; the rows are derived once and stored by split."""
    stored = written(molecules, "splits", ["split"])
    for split in SPLITS:
        path = SPLIT_FILE.format(base=base.rstrip("/"), split=split, suffix=suffix, ext=fmt)
        write_table(stored.filter(F.col("split") == split).drop("split"), path, fmt)


def fingerprint_molecules(molecules: DataFrame, text: str = "smiles", grams: int = 3) -> DataFrame:
    """Fingerprints of structured keys, from runs of characters."""
    return hash_fingerprint(molecules, text, grams=grams)


def write_fingerprints(molecules: DataFrame, base: str) -> None:
    write_splits(fingerprint_molecules(molecules), base, FINGERPRINT_SUFFIX)


def neighbour_baseline(fingerprints: DataFrame, ordinal: str = "ordinal", **options) -> tuple[DataFrame, DataFrame]:
    """Nearest-neighbour predictions of the test rows from the train rows, and their metrics."""
    rows = fingerprints.withColumn("label", encode_label(F.col("source")))
    test, train = (rows.filter(F.col("split") == s) for s in ("test", "train"))
    predictions = tanimoto_nn(test, train, ordinal, **options)
    return predictions, neighbour_report(predictions, "true_label", "pred_label")


def neighbour_table(fingerprints: DataFrame, key: str = "smiles", ordinal: str = "ordinal", **options) -> DataFrame:
    """The neighbour result as it is stored: key, named labels, similarity and the neighbour's key."""
    rows = fingerprints.withColumn("label", encode_label(F.col("source")))
    test, train = (rows.filter(F.col("split") == s) for s in ("test", "train"))
    found = tanimoto_nn(test, train, ordinal, carry=(key,), **options).join(test.select(ordinal, key), ordinal)
    return found.select(
        key, decode_label(F.col("true_label")).alias("true_label"), decode_label(F.col("pred_label")).alias("pred_label"),
        "nn_similarity", f"nn_{key}")


def linear_baseline(fingerprints: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fit on train, score test; gives the scored rows and the report, and saves both with a ``path``."""
    rows = bit_vectors(fingerprints.withColumn("label", encode_label(F.col("source"))))
    train, test = (rows.filter(F.col("split") == s) for s in ("train", "test"))
    model = train_linear(train)
    scored = score_linear(model, test)
    report = eval_report(scored)
    if path is not None:
        names = [f"fp_{i}" for i in range(model.numFeatures)]
        save_model(model, model_metadata(train, "label", names, solver="l-bfgs", penalty="l2"), path)
        write_record(report, f"{path}/report")
    return scored, report
