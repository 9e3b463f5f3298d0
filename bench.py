"""Headline queries, timed once each after a warm-up; prints one JSON line.

The first query of a session pays for JVM start-up and code generation, so a small
warm-up query runs first and is not counted. Base maps that several queries share are
traced once (`ray2_base_maps` times the tracing itself, without any reuse).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "ray2_base_maps", "ray5_geometry_reuse", "smp1_sparse_anchors", "fit1_log_distance", "fit2_multi_wall", "idw1_predict_points", "idw4_multi_wall_residual",
    "idw7_fewshot_target_idw", "knn1_nearest_anchors", "fea1_feature_table", "met1_core_errors", "met5_non_anchor", "met7_metric_rows",
    "met10_point_metrics", "met12_pooled_metrics", "met19_subgroup_summary", "spl5_folds", "sta2_paired_comparisons", "sta3_win_rates",
    "sta5_cluster_bootstrap", "sta14_point_comparison", "sta16_adaptation_gains", "src2_scene_arrays", "src4_image_cells", "src8_campaign_scan",
    "prj10_row_cleaning", "aud4_baselines_ignore_dense_labels", "aud11_prediction_audit", "lrn2_extra_trees_stump", "lrn2_extra_trees",
)


def main() -> None:
    from signalgrid.queries import load_all
    from signalgrid.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "signalgrid-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = load_all()
    only = sys.argv[1:]
    queries["mth1_distance_map"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        queries[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
