"""Times the headline queries over stored tables made from $BENCH_SF_DIR. Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weir.plans.agents import traces
from weir.sources import bridge
from weir.store import Store

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 5


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    store = Store(spark, tempfile.mkdtemp(prefix="spark-bench-"))
    took: dict[str, float] = {}

    def timed(name: str, run, runs: int = RUNS) -> None:
        all_ = []
        for _ in range(runs):
            began = time.perf_counter()
            run()
            all_.append(time.perf_counter() - began)
        took[name] = round(statistics.median(all_), 4)

    spans = bridge.spans(spark, SF_DIR)
    timed("write_spans", lambda: store.write("spans", spans), 1)
    timed("write_metrics", lambda: store.ingest_metrics(spans), 1)
    timed("write_traces", lambda: store.write("traces", traces(spark, SF_DIR)), 1)
    last = spans.agg(F.max("request_us")).first()[0] // 1_000_000 + 1
    hour = last - 3600
    timed("spans_page", lambda: store.spans_page(hour, last).collect())
    timed("summary", lambda: store.summary(hour, last).collect())
    timed("timeseries", lambda: store.timeseries(["call_count", "ttft_avg", "e2e_p95"], "1m", hour, last).collect())
    timed("traces_page", lambda: store.traces_page(0, last).collect())
    timed("services", lambda: store.services(0, last, 50).collect())
    timed("services_hour", lambda: store.services(hour, last, 50).collect())
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
