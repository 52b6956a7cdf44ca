"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose the data and the cores. Every query runs once to warm up and
is then timed; all rows are computed and thrown away. Names on the command line replace the headline list.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from brindle import queries as registry
from brindle.queries import models
from brindle.session import local_session

HEADLINE = [
    "category_rate", "summary_stats", "billing_summary", "billing_stats", "combo_means", "group_agg", "q_two_key_rate",
    "q_sum_by_group", "top_n", "safe_select", "infer_types", "coerce_values", "semantic_types", "profile", "impute",
    "injection_screen", "lag_features", "rolling_features", "pct_change", "trend_fit", "change_points", "chunk_words",
    "embed_corpus", "vector_search_batch", "keyword_search", "route_questions", "tag_query_spec", "split_stratified",
    "classifier_metrics", "anomaly_zscore", "anomaly_iforest", "rate_limit_sliding", "rate_limit_fixed", "events_sliding",
    "vector_search", "train_rf", "score_batch", "rate_limit_fixed_stream", "asof_join", "range_join", "interval_join", "events_session",
    "vector_index_search", "global_ranks", "cube_totals",
]


def timed(name, build, spark, folder) -> float:
    """Seconds of one run. A query that trains fits anew; one that scores uses the fit of the run before, so that scoring is timed apart."""
    if name.startswith("train"):
        models.forget()
    start = time.perf_counter()
    build(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    registry.load_all()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        build = registry.QUERIES[name]
        timed(name, build, spark, folder)
        times[name] = round(statistics.median(timed(name, build, spark, folder) for _ in range(repeats)), 3)
    print(json.dumps({
        "metric": "total_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
