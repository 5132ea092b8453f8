"""Times the headline queries and prints one line of JSON.

BENCH_SF_DIR names the folder of the tables, BENCH_CPUS the number of local cores. Each query runs
BENCH_RUNS times (default 2) after one warm-up; the median counts, the value is the sum. From
post_features on a query reads the tables that earlier steps stored, as the pipeline does; building
each of them is timed once, with a JVM that the queries before it have warmed, as a line of its own.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "clean_typed",
    "quality_summary",
    "first_per_key",
    "unique_posts",
    "post_engagement",
    "degree_counts",
    "author_statistics",
    "text_features",
    "top_categories",
    "post_features",
    "labels",
    "overview",
    "category_summary",
    "rules",
    "sensitivity_grid",
)

# Built in this order, each from the one before.
STORED = ("stored_posts", "stored_authors", "stored_features", "labelled")


def main() -> None:
    from tallyreach.session import build_session
    from workload import queries
    from workload.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in HEADLINE:
        if name == "post_features":
            for step in STORED:
                start = time.perf_counter()
                getattr(queries, f"_{step}")(spark, folder)
                timings[step] = round(time.perf_counter() - start, 3)
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, summed",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
