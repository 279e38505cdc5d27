"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; names
given as arguments replace the default list.
"""

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")

from cytomill import plans  # noqa: E402
from cytomill.session import local_session  # noqa: E402

HEADLINE = [
    "a13_field_profiles", "a14_robust_zscore", "a15_treatment_profiles", "a46_welch_vs_control", "a47_perturbation_scores",
    "a51_class_vs_rest", "w04_otsu_threshold", "w05_average_ranks", "a30_counting_errors", "a32_pooled_rollup", "a65_signed_rank",
    "w03_average_ranks", "j01_assign_points", "a18_build_expression", "j06_label_overlap", "j06_run_overlap", "a23_average_precision",
    "a26_dataset_scores", "a44_score_cell_types", "a41_differential_expression", "a42_correlate_with_morphology", "j14_knn_graph",
    "a37_morans_i", "a38_getis_ord", "a06_moment_shapes", "g03_outline_pixels", "a07_intensity_stats", "a10_haralick", "g07_grey_opening",
    "g13_merge_blocks", "g14_stitch_slices", "a54_clustering_scores", "a49_class_consistency", "k07_weighted_sample", "a78_corpus_rollup",
    "t05_tumbling",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    qs = plans.queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # JVM warm-up
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
