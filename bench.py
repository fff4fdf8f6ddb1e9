"""Headline queries, timed; prints one JSON line.

Each query is planned and run once to warm up and then three times; the median
counts.  Results are written to the no-op sink, so every column of every row is
computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from promptward.plans import planted as pl
from promptward.plans.queries import QUERIES

HEADLINE = (
    "verdicts_raw",
    "verdicts",
    "pii_matches",
    "masked_corpus",
    "injection_signals",
    "vector_check",
    "risk_level",
    "forwardable",
    "audit_rows",
    "hourly_timeline",
    "session_ranking",
    "summary_metrics",
    "prompt_repeats",
    "recent_scans",
)
RUNS = 3


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One file per core: scanning is bound by CPU, and a file of one row group is one task.
    given, sf_dir = sf_dir, tempfile.mkdtemp(prefix="bench-")
    for path in Path(given).glob("*.parquet"):
        rows = spark.read.parquet(str(path))
        files = int(cpus) * 2 if path.stem == "documents" else 1
        rows.repartition(files).write.parquet(f"{sf_dir}/{path.name}")
    seconds = {}
    for name in HEADLINE:
        query = QUERIES[name]
        times = [timed(lambda: run(query(spark, sf_dir))) for _ in range(RUNS + 1)]
        seconds[name] = round(statistics.median(times[1:]), 3)
    size = pl.documents(spark, sf_dir).agg(
        F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")
    ).first()
    scan = seconds["verdicts_raw"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": given.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "documents_per_sec": round(size["n"] / scan),
                "mb_per_sec": round(size["bytes"] / scan / 1e6, 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
