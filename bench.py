"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of local cores, ``BENCH_QUERIES`` an
optional comma-separated list of query names (``all`` for every query). A query's time is planning
plus a full run into the no-op sink, after one small warm-up query for the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cellcast import catalog  # noqa: E402
from cellcast.session import local_session  # noqa: E402

HEADLINE = (
    "agg_cell_day_mean", "agg_snapped_mean", "join_cell_day_left", "join_events_left",
    "join_transition_broadcast", "plan_master", "win_trailing_mean", "win_trailing_mean_days",
    "win_trailing_mean_fanout", "plan_features", "sample_negatives", "split_temporal",
    "ml_score_linear_fixed", "udf_batch_scorer", "agg_monthly_index",
    "agg_weighted_index_by_target", "agg_monthly_distinct_by_target", "plan_monthly_index",
    "win_rank_auc", "win_average_precision", "eval_classifier_report",
    "join_point_polygon_distance", "win_first_hit", "agg_laplace_smooth", "join_gap_safe_lag",
    "ml_walk_forward_oof", "ml_multi_target", "ml_event_classifier", "src_grid_explode",
    "snk_partitioned",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "")
    runs = catalog.queries()
    wanted = list(runs) if names == "all" else [n for n in names.split(",") if n] or list(HEADLINE)
    spark = local_session(cores, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
