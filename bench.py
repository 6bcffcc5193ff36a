"""Wall time of the headline queries; prints one JSON line.

Each query runs twice on a warm session, writing to the no-op sink; the second
run counts. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "entry_threshold_and_auc", "ev1_confusion", "ev6_roc_auc", "ev7_average_precision", "ev8_roc_curve", "ev12_sweep_thousandths",
    "ev13_best_f1", "ev14_threshold_recall_95_highest", "ev17_evaluate_catalogue", "ev18_full_report",
    "lbl1_majority_integer", "lbl6_factorize_sorted", "spl1_stratified_split", "spl3_stratified_sample", "spl5_kfold", "spl7_sample_n",
    "wn1_class_rank", "ag1_profile", "ag1_profile_embedding", "ag10_top_values", "ag13_deterministic_values", "ag14_leakage_scan",
    "ag17_histogram", "st1_pearson", "st2_corr_pairs", "st3_mutual_info_discrete", "st4_mutual_info_binned", "st5_anova_f_lineitem",
    "pp1_medians", "pp2_scale", "jn2_align", "jn3_stack_probas", "jn9_knn_join", "ens2_mean_blend", "ens3_median_blend",
    "ca2_isotonic", "src1_read_fixed_csv", "sm2_stream_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    from tidewatch.plans import collect
    from tidewatch.session import local_session

    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = collect()
    seconds: dict[str, float] = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
