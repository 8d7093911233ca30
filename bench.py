"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from kinfold.queries import QUERIES

HEADLINES = ["landing_dedupe", "exact_kind_counts", "grouping_key", "scored_kind_counts", "contributions",
             "profile_completeness", "profile_fold", "resolve_components", "child_rows", "upsert_replace",
             "kind_frequency", "field_frequency", "stream_landing", "stream_kind_counts", "stream_profiles", "publish_late_profiles",
             "wide_type_change", "export_partial_rewrite", "stream_kind_sets", "stream_profile_counters"]


def yardstick(spark: SparkSession) -> float:
    """Seconds of a fixed aggregation that reads no table: how fast this machine is, to compare runs by."""
    def run() -> None:
        spark.range(60_000_000).selectExpr("id % 1000 as k", "xxhash64(id) as h").groupBy("k").agg({"h": "max"}).write.format(
            "noop").mode("overwrite").save()
    run()
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["exact_kind_counts"](spark, sf_dir).collect()
    measure, seconds = yardstick(spark), {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "supplier", "orders", "events")}
    messages = 2 * tables["customer"] + tables["supplier"] + tables["orders"] + tables["events"]
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "yardstick_seconds": measure, "messages": messages,
        "profile_messages_per_sec": round(messages / seconds["profile_fold"], 1),
        "landed_messages_per_sec": round(tables["events"] / seconds["stream_landing"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
