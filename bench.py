"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from weaklabel.catalog import CATALOG  # noqa: E402
from weaklabel.session import local_session  # noqa: E402

HEADLINE = [
    "majority_vote_quality",
    "apply_rules",
    "rule_summary_gold",
    "label_model_score",
    "vote_pair_counts",
    "label_model_fit",
    "respiratory_votes_final",
    "collapse_visits",
    "longest_matching_runs",
    "enrich_chain",
    "outer_join_events",
    "outer_join_null_safe",
    "full_split",
    "stratified_fixed_split",
    "kfold_assignment",
    "promote_top_scores",
    "soft_targets",
    "standardized_features",
    "threshold_sweep_table",
    "confusion_counts",
    "rank_auc",
    "roc_curve_points",
    "precision_recall_points",
    "histogram_values",
    "box_summary_table",
    "dot_plot_rows",
    "nearest_vectors",
    "gaussian_bayes",
    "discriminant_scores",
    "random_forest_weighted",
    "scan_pipe_delimited",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, app="weaklabel-bench")
    # one small query first, so that no headline query pays for starting up
    CATALOG["threshold_sweep_table"].run(spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    line = {
        "metric": "headline_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
