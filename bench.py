"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from logfold.operators.ingest import ingest  # noqa: E402
from logfold.queries import registry  # noqa: E402
from logfold.sources.tables import PACKAGE, captured_lines, event_capture, event_lines, event_logs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Many buckets per device even on small tables: the seams between them get work.
NARROW_BITS = 10

HEADLINES = [
    "late_drop", "dedup_lines", "sessionize", "merge_multiline", "error_summary_all_sessions", "tag_summary_all_sessions",
    "session_stats", "query_logs_folded", "search_logs", "search_documents_pattern", "error_contexts", "fold_runs",
    "fold_events", "render_entries", "render_folded", "retention_full", "stream_ingest",
]


def session():
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("logfold-bench")
    for key, value in {
        "spark.sql.shuffle.partitions": CPUS,
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
        # The test tables are small; let their shuffles use all cores.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(make):
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main():
    spark = session()
    queries = registry.queries()
    lines = event_lines(spark, SF_DIR).count()
    event_logs(spark, SF_DIR)
    event_capture(spark, SF_DIR)

    times = {
        "ingest": timed(lambda: ingest(event_lines(spark, SF_DIR), PACKAGE)),
        "ingest_narrow_buckets": timed(lambda: ingest(event_lines(spark, SF_DIR), PACKAGE, bits=NARROW_BITS)),
        "ingest_text_files": timed(lambda: ingest(captured_lines(spark, SF_DIR), PACKAGE)),
    }
    times |= {name: timed(lambda n=name: queries[n](spark, SF_DIR)) for name in HEADLINES}
    print(json.dumps({
        "metric": "total time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "raw_lines": lines,
        "lines_per_sec": {name: round(lines / times[name]) for name in times if "ingest" in name},
        "cores": int(CPUS),
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
