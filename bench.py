"""Benchmark of the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Runs each query to completion with the ``noop`` sink (full execution, nothing
collected) on ``local[$BENCH_CPUS]`` and prints one JSON line.  Every timed
query but the longest (``COLD``) is first run once on sf0.01 (the next smaller scale: other files, so no
result is reused) and that run is not counted -- the session is warm, as in
the baseline's own measurement, and the timings show steady-state work rather
than JIT and Python-worker start-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from txlens.plans import catalog  # noqa: E402
from txlens.session import build_session  # noqa: E402

HEADLINE = [
    "features_job",                  # feed -> dedupe -> 24 h / 10 min features (sweep) -> rule
    "win8_rolling_features_sweep",   # same plan, timed a second time: the spread of one run
    "win8_rolling_features_window",  # same through the single-shuffle Window strategy
    "win7_dedupe_latest",
    "agg1_user_risk",                # risk run: cities, oversampling, min-max score, user means
    "agg2_hotspots",
    "led1_balance_gate",             # ordered balance fold over the orders ledger
    "led3_process_transactions",
    "agg3_summary",
    "lim2_top_risk",
    "ml8_score_model",
    "ml9_evaluate",
    "smp2_stratified_split",
    "snk2_write_risk_outputs",       # the whole risk run with clustering (10 k-means starts), published
    "str1_feature_stream",           # three micro-batches of ten days each
    "str2_rolling_state",
    "str6_decision_stream",          # four micro-batches
]
#: One warm run of these on sf0.01 would cost more than it steadies.
COLD = {"snk2_write_risk_outputs", "str1_feature_stream", "str2_rolling_state", "str6_decision_stream"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, cpus * 2))))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=parts, app_name="txlens-bench")
    catalog.load_all()
    warm = os.path.join(os.path.dirname(sf_dir.rstrip("/")), os.environ.get("BENCH_WARM_SF", "sf0.01"))
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in (n for n in names if n not in COLD):
            catalog.QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
