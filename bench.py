"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import time

from foldwise.catalog import fits, load
from foldwise.session import local_session

HEADLINE = [
    "fold_assignment",
    "holdout_assignment",
    "method_comparison",
    "repeat_metrics",
    "roc_coordinates",
    "calibration_bins",
    "recalibration_fits",
    "paired_auc_bootstrap",
    "preprocessing_state",
    "standardized_holdout_cells",
    "stability_ranking",
    "nogueira_stability",
    "formal_inference",
    "feature_manifest",
    "saved_predictions_vs_plan",
    "elastic_net_tuning",
    "fitted_method_comparison",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    entries = load()
    # Start the JVM, the code generator and the Python workers outside the measured time.
    entries["class_counts"].build(spark, folder).collect()
    spark.range(64).repartition(8).groupBy("id").applyInPandas(lambda pdf: pdf, "id long").count()
    seconds = {}
    for name in HEADLINE:
        fits.forget()  # every query is timed from its inputs on
        start = time.perf_counter()
        entries[name].build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
