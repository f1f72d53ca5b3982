"""Time the headline queries: one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from moltabula.plans.table_queries import QUERIES  # noqa: E402
from moltabula.session import local_session  # noqa: E402

HEADLINE = [
    "compile_dedup", "label_any", "stratified_split", "split_rows", "split_leakage", "first_seen_last_wins",
    "enumerate_designs", "apply_rules", "expand_one_step", "distinct_lines", "hash_fingerprint",
    "graph_fingerprint_rows", "tanimoto_nn", "knn_graph", "overlap_nn", "eval_report", "roc_auc",
    "average_precision", "even_chunks", "epoch_batches", "weighted_resample", "feature_stats", "standardize",
    "supcon_loss", "score_from_weights", "train_linear", "train_incremental", "score_linear", "linear_probe", "train_mlp",
    "project_2d", "knn_lsh", "tanimoto_nn_prefix", "gram_fingerprint",
    "knn_descent", "own_geometric_mean", "own_top_three", "supcon_one_batch", "apply_rules_indexed",
    "udf_pair_bounded", "overlap_nn_bounded", "shard_merge_checked", "mlp_epochs", "linear_weights",
    "corrected_weights", "graph_layout",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
