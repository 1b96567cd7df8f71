"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from siteweave.plans.catalog import QUERIES
from siteweave.session import session

NAMES = ("score_test_central", "score_test_fed", "meta_analysis", "irls_moments", "irls_fit", "overlap_join_all", "overlap_join_first", "interval_subtract", "merge_gap", "nearest_dist", "geno_impute", "geno_subset_outer", "mat_mul", "mat_mul_blocked", "kmeans_soft_step", "quantile_norm", "transition", "hist_marginals")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark__sql__shuffle__partitions": cpus, "spark__driver__memory": "8g", "spark__ui__enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    out = {}
    for name in NAMES:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        out[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "total of median seconds", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
