"""Job entry points for spark-submit.

    spark-submit txlens/jobs.py features --input FEED --output TABLE
    spark-submit txlens/jobs.py features --input FEED --output TABLE --watch 8 --state DIR
    spark-submit txlens/jobs.py risk --input TABLE --output DIR --flagged-at "2024-02-01 00:00:00"
    spark-submit txlens/jobs.py decisions --input FEED --output DIR --state DIR \\
        --profiles TABLE --blacklist TABLE [--feed DIR] [--watch 8]

Without ``--watch`` a job processes what is there and ends; with it, it runs as
a stream with that period in seconds.  The session is the one spark-submit
configures (``spark.checkpoint.dir`` must name a shared folder on a cluster).
"""

from __future__ import annotations

import argparse
import os
import sys

if __name__ == "__main__":   # run as a script: the package's parent must be importable
    sys.path[0] = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from txlens.plans.features import feature_job
from txlens.plans.risk_job import risk_job
from txlens.session import delete_materialized, ensure_session_defaults
from txlens.sources.feed import read_features, read_transactions
from txlens.sources.sinks import write_features, write_risk_outputs
from txlens.streaming.feature_stream import start_decision_stream, start_feature_stream


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="txlens")
    p.add_argument("job", choices=["features", "risk", "decisions"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--state", help="folder for the state and checkpoints of a stream")
    p.add_argument("--watch", type=float, metavar="SECONDS", help="run as a stream with this period")
    p.add_argument("--buckets", type=int, default=64)
    p.add_argument("--multi-line", action="store_true", help="CSV fields may hold line breaks")
    p.add_argument("--flagged-at", help="run time written into the blacklist")
    p.add_argument("--profiles")
    p.add_argument("--blacklist")
    p.add_argument("--feed", help="folder that gets the accepted rows")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName(f"txlens-{a.job}").getOrCreate()
    ensure_session_defaults(spark)
    if (a.watch or a.job == "decisions") and not a.state:
        raise SystemExit("--state is needed")
    period = f"{a.watch} seconds" if a.watch else None
    if a.job == "features" and a.watch:
        start_feature_stream(spark, a.input, a.output, f"{a.state}/checkpoint", trigger=period,
                             multi_line=a.multi_line, buckets=a.buckets).awaitTermination()
    elif a.job == "features":
        feed = read_transactions(spark, a.input, a.multi_line)
        if feed is None or not write_features(feature_job(feed), a.output):
            print("nothing to process")
    elif a.job == "risk":
        if not a.flagged_at:
            raise SystemExit("--flagged-at is needed")
        write_risk_outputs(risk_job(read_features(spark, a.input), a.flagged_at), a.output)
    else:
        if not a.profiles or not a.blacklist:
            raise SystemExit("--profiles and --blacklist are needed")
        start_decision_stream(spark, a.input, f"{a.state}/checkpoint", trigger=period, multi_line=a.multi_line,
                              blacklist_path=a.blacklist, opening_profiles_path=a.profiles, decisions_dir=a.output,
                              feed_dir=a.feed).awaitTermination()
    delete_materialized(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
