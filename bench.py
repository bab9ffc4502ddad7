"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from ledgerbeam.operators.partitioning import drop_cuts
from ledgerbeam.plans.queries import QUERIES
from ledgerbeam.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = ["flagship_records", "master_sheet_records", "tag_length_value_records", "microfinance_records", "file_counts",
             "duplicate_accounts", "gate_decisions", "findings_rollup", "address_split", "legend_lookup", "upload_positions",
             "guarantor_unpivot", "compare_lines", "comparison_summary", "column_bindings"]


def main() -> None:
    spark = local_session(CPUS, partitions=int(CPUS) if CPUS.isdigit() else 8, memory="16g")
    spark.read.parquet(f"{SF_DIR}/region.parquet").count()  # start the JVM's readers before timing
    times: dict[str, float] = {}
    for name in os.environ.get("BENCH_QUERIES", ",".join(HEADLINES)).split(","):
        start = time.time()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        drop_cuts(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS}))


if __name__ == "__main__":
    main()
