"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

One warm-up run at the same size, then the median of three timed runs. Every
result is written to the ``noop`` sink, so nothing is pruned away or collected.
"""
from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindings import QUERIES  # noqa: E402
from studycorpus import session  # noqa: E402

HEADLINE = ["dedup_exact", "chunk_units", "corpus_stats", "near_duplicates", "refresh_plan", "reachable", "progress",
            "throttle", "match_catalog", "page_links", "size_budget", "redact", "validate_corpus", "exam_context", "catalog_from_tables",
            "corpus_mixed"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build("bench", f"local[{cpus}]", **{
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"), "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false", "spark.studycorpus.spread": cpus,
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(","):
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
