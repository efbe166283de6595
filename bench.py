"""Benchmark: the ingest job plus the headline operators.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line.  ``ingest_store`` is the full ingest (staging reads,
validation, matrix verification, assembly, v1 hashing, K1-K3 writes into a
fresh store); every other entry is one registered query, forced with the
``noop`` sink (all rows computed, nothing collected to the driver) over the
store written by that ingest.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # ingest-side operators (lazy over the staging tables)
    "assemble_snapshots", "snapshot_hash", "integrity_audit", "validate_ids",
    "reject_duplicates", "completeness_check", "matrix_verify", "ingest_outcomes",
    "pivot_market_data", "landing_dedupe", "landing_rejects", "backfill_counts", "ingest_status",
    "rejects_by_reason", "validate_matrix_refs",
    # query operators over the stored tables
    "snapshot", "snapshot_lookup", "by_trade_scan", "by_trade", "by_trade_ids", "fx_rates", "portfolio_topn", "who_matters",
    "exposure_history", "product_notional", "trade_notional_series",
    # diff and history
    "diff_trades_added", "diff_agreement", "diff_fx", "diff_summary", "change_log",
    "agreement_history", "exposure_anomalies",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("COBFRAME_CHECKPOINT_DIR", tempfile.mkdtemp(prefix="cobframe-bench-"))
    from cobframe.plans import catalog, domain
    from cobframe.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")),
                          app="cobframe-bench")
    times: dict[str, float] = {}
    t0 = time.time()
    domain.order_store(spark, sf_dir)
    times["ingest_store"] = round(time.time() - t0, 3)
    queries = catalog.queries()
    names = [n for n in HEADLINE if n in queries]
    if os.environ.get("BENCH_ALL"):
        names = list(queries)
    for name in names:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
