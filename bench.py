"""Wall-clock seconds of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from siteworks.plans import PLANS
from siteworks.session import local_session

HEADLINE = [
    "ward_stats", "region_stats", "median_global", "quantile99", "anova_f", "geo_outlier",
    "knn_self", "knn_reference", "neighbor_rate_self", "neighbor_distances", "grid_density",
    "label_encode", "stratified_split", "stratified_kfold", "learning_curve_split", "interactions_core",
    "group_rate", "group_mean_std_max", "value_counts", "date_parts", "text_counts",
    "vote_weighted", "proba_weighted", "classification_report", "cv_summary",
    "batch_assign", "prompt_vertical", "response_normalize", "completeness_audit", "upsert_latest", "stream_upsert",
    "rf_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), 8)
    spark.sparkContext.setLogLevel("ERROR")
    PLANS["value_counts"](spark, sf_dir).count()
    seconds = {}
    for name in HEADLINE:
        started = time.time()
        PLANS[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
