"""Times the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set folder and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "json_w1", "json_w2", "json_w3", "w3_selective", "json_w4", "json_w5", "json_k1", "json_k4",
    "join_customer_orders", "groupby_avg", "sort_numeric", "breakpoint_good",
)
RUNS = 3


def control(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Seconds from a pause's request until it is granted, of W3 as a run, and what a count
    breakpoint half-way and the resume after it add to that run."""
    from loomline import demo
    from loomline.sources.store import scratch
    from loomline.streaming import CountBreakpoint
    from loomline.streaming.plan_run import plan_run

    def ready():  # noqa: ANN202
        return plan_run(spark, demo.plans(sf_dir)["w3"], scratch(spark, "bench"))

    def timed(run) -> float:  # noqa: ANN001
        began = time.perf_counter()
        run.run().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    pauses, plain, stopped = [], [], []
    half = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() // 2
    for _ in range(RUNS + 1):
        plain.append(timed(ready()))
        marked = ready()
        marked.set_breakpoint(CountBreakpoint("half", half, "Filter"))
        stopped.append(timed(marked))
        paused = ready().start()
        time.sleep(plain[-1] / 3)
        began = time.perf_counter()
        paused.pause()
        pauses.append(time.perf_counter() - began)
        timed(paused)
    middle = lambda x: sorted(x[1:])[RUNS // 2]
    return {"pause_latency": round(middle(pauses), 3), "run_w3": round(middle(plain), 3), "breakpoint_and_resume_overhead": round(middle(stopped) - middle(plain), 3)}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from loomline.queries import QUERIES

    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):  # the first compiles code
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times[1:])[RUNS // 2], 3)
    print(json.dumps({"metric": "headline queries, median of 3 warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "control": control(spark, sf_dir), "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
