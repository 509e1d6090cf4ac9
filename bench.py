"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of the tables, BENCH_CPUS the number of local threads.
Each query runs once to its last row, planning and files it writes on the way included.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from jumptrail.plans import fixtures  # noqa: E402
from jumptrail.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "appid_candidates", "path_ambiguity", "appid_collisions", "guid_containment",
    "identify_apps", "candidate_matches", "unidentified", "resolve_processes",
    "container_counts", "recent_docs", "recent_docs_top", "frequent_docs", "usage_summary",
    "activity_by_day", "timeline_gaps", "admissible_adds", "sort_by_path", "sort_all_by_path",
    "entries_xml_roundtrip", "eligible_containers", "report_rows", "report_html",
    "crc64_values", "hexdump", "reverse_bytes", "bytes_from_hex", "stream_ingest", "stream_recents",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The tables that joins read; the first step also pays for the start of the workers.
    start = time.perf_counter()
    fixtures.containers(spark, sf_dir).count()
    seconds = {"written_tables": round(time.perf_counter() - start, 3)}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
