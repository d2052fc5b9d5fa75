"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HEADLINE = "q1 q3 q5 q6 q10 q14 q18 asof_join_sum asof_join_bucketed range_join window_sliding window_session gramian_matrix approximate_quantile word_count knn_of_probes cep_pattern".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera import queries

    sf_dir, cpus, rounds = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count())), int(os.environ.get("BENCH_ROUNDS", "3"))
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true"}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries.load()
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(rounds):
            began = time.perf_counter()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:] or runs), 3)  # the first also compiles
        print(name, took[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
