"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from leafwise.plans import QUERIES  # noqa: E402
from leafwise.session import build_session  # noqa: E402

HEADLINES = (
    "score_gaps",
    "gap_report",
    "score_pairs",
    "review_decisions",
    "cluster_table",
    "select_non_overlapping",
    "score_rasters",
    "diagnose_damage",
    "what_if_insert",
    "insert_blanks",
    "delete_entries",
    "normalize_spine",
    "apply_preset_v2",
    "build_series",
    "validate_volumes",
    "preflight_report",
    "package_violations",
    "progress_latest",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    spark = build_session(
        "leafwise-bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the session
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}
    print(json.dumps(line))


if __name__ == "__main__":
    main()
