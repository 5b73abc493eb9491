"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from foretrace.plans import catalogue  # noqa: E402
from foretrace.session import build_session, clean_up  # noqa: E402

HEADLINE = (
    "flagship entity_game_rollup opponent_rollup trailing_block trailing_opponent prefix_rate split_prefix count_window "
    "count_window_lineitem day_window_lineitem mix_share bucket_prefix lag_window_std slate_percentile latest_non_null "
    "audited_join join_audit dim_join nearest_hour shrunk_index name_cascade upsert_history locked_merge greedy_caps "
    "probable_lineup settle expanding_folds rolling_holdouts prob_metrics threshold_sweep policy_search score_deciles "
    "ranked_output top_reasons coverage_audit stream_rollup"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(catalogue.QUERIES)
    spark = build_session("bench", f"local[{cpus}]", 2 * int(cpus) if cpus.isdigit() else None, os.environ.get("BENCH_CHECKPOINT"))
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["flagship"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.time()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))
    clean_up(spark)
    spark.stop()


if __name__ == "__main__":
    main()
