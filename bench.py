"""Times headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3, after
one warm-up). The billing tables are written once before timing, so a figure is the operator's own
work. A query's figure is the median; the value is their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from leasebook import build_session
from leasebook.plans import catalogue
from leasebook.sources.star_views import VIEWS, StarSource
from leasebook.sources.store import PackageStore

HEADLINE = [
    "renewal_cost", "expiring_finder", "finder_current", "finder_all", "version_cost", "viewer_items",
    "previous_header", "active_items", "validate_lines", "diff_details", "detail_log_rows", "change_log_rows",
    "change_log_rows_soft", "store_save",
]


def written(spark, sf_dir: str, folder: str) -> StarSource:
    """The billing views of the star schema as tables of their own."""
    source, stored = StarSource(spark, sf_dir), StarSource(spark, sf_dir)
    for name in VIEWS:
        source.view(name).write.parquet(f"{folder}/{name}")
        stored.keep(name, spark.read.parquet(f"{folder}/{name}"))
    return stored


def run_once(source: StarSource, name: str, folder: str) -> float:
    if name == "store_save":  # one package in ten is submitted to a fresh store
        store = PackageStore(source.spark, tempfile.mkdtemp(dir=folder), buckets=16)
        store.create(source.tables())
        start = time.time()
        store.save(source.view("submissions").where("submission_id % 10 = 0"),
                   source.view("submission_lines").where("submission_id % 10 = 0"), catalogue.AS_OF)
        return time.time() - start
    start = time.time()
    catalogue.QUERIES[name](source).write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("leasebook-bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    with tempfile.TemporaryDirectory(prefix="leasebook-bench-") as folder:
        source = written(spark, sf_dir, folder)
        for name in HEADLINE:
            run_once(source, name, folder)
            seconds[name] = round(statistics.median(run_once(source, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
