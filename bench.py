"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full computation,
nothing collected). A trivial job runs first so JVM start-up is not charged to
the first query. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from routelens.plans import catalog  # noqa: E402
from routelens.session import build_session  # noqa: E402

HEADLINE = [
    "endpoint_inventory", "op_keep_first", "endpoint_prf", "composite_score", "framework_detect",
    "route_file_detect", "auth_context", "corpus_grep", "call_table", "stall_detect", "hint_parse",
    "build_ref", "reference_closure", "resolve_indexed", "operation_id_dedup", "completeness", "job_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus) * 2)
    qs = catalog.queries()
    spark.range(1000).selectExpr("sum(id)").collect()  # session / JVM warm-up, not timed
    times, failed = {}, {}
    for n in names:
        t0 = time.time()
        try:
            qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report the failure, keep timing the rest
            failed[n] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
