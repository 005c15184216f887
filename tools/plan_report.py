"""Summarise the executed (AQE-final) physical plans of the headline queries.

    python tools/plan_report.py [sf_dir] > PLANS.md

Per query: shuffles, map-side limits, join strategies, Python stages and what
each parquet scan reads (pruned schema, pushed filters).  Tables that a query
stores while it is built (``materialize``) are listed with the nodes of the
plan that made them, and so is the number of Spark jobs before the last plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql.readwriter import DataFrameWriter  # noqa: E402

from bench import COLD, HEADLINE  # noqa: E402
from txlens.plans import catalog  # noqa: E402
from txlens.session import build_session  # noqa: E402

NODES = ["Exchange", "ReusedExchange", "BroadcastExchange", "WindowGroupLimit", "Window", "HashAggregate",
         "SortAggregate", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin",
         "CartesianProduct", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "Generate"]


def summarise(df) -> dict:
    # Execute this DataFrame's own plan (a noop write would plan a new query
    # execution), so the AQE plan read below is the final one, with reused
    # exchanges and runtime join choices.  No rows go to Python.
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    plan = qe.executedPlan().toString()
    if "== Final Plan ==" in plan:  # count the final plan only, not the initial one printed after it
        plan = plan.split("== Final Plan ==", 1)[1].split("== Initial Plan ==", 1)[0]
    counts = {n: len(re.findall(rf"(?<![A-Za-z]){n}(?![A-Za-z])", plan)) for n in NODES}
    scans = re.findall(r"FileScan parquet [^\n]*", plan)
    reads = []
    for s in scans:
        table = re.search(r"Location: [^\[]*\[(?:file:)?[^\],]*/([^/\],]+)[\],]", s)
        schema = re.search(r"ReadSchema: (struct<[^>]*>)", s)
        pushed = re.search(r"PushedFilters: (\[[^\]]*\])", s)
        reads.append((table.group(1) if table else "?", schema.group(1) if schema else "?",
                      pushed.group(1) if pushed else "[]"))
    return {"counts": {k: v for k, v in counts.items() if v}, "reads": reads}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", 16, app_name="txlens-plans")
    catalog.load_all()
    print(f"# Executed plans of the headline queries ({os.path.basename(sf_dir)}, AQE final plans)\n")
    print("Generated by `tools/plan_report.py`. Node counts are taken from the executed plan; "
          "scans list the file, the pruned read schema and the filters pushed into the reader.\n")
    stored: list[str] = []
    write = DataFrameWriter.parquet

    def recorded(self, path, *args, **kwargs):
        plan = self._df._jdf.queryExecution().executedPlan().toString()
        counts = {n: len(re.findall(rf"(?<![A-Za-z]){n}(?![A-Za-z])", plan)) for n in NODES}
        stored.append(f"columns {', '.join(self._df.columns[:6])}{' ...' if len(self._df.columns) > 6 else ''}: "
                      + (", ".join(f"{v} {k}" for k, v in counts.items() if v) or "scan and project only"))
        return write(self, path, *args, **kwargs)

    DataFrameWriter.parquet = recorded
    for name in (n for n in HEADLINE if n not in COLD):
        stored.clear()
        spark.sparkContext.setJobGroup(name, name)
        df = catalog.QUERIES[name](spark, sf_dir)
        eager = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
        s = summarise(df)
        doc = (catalog.QUERIES[name].__doc__ or "").strip().splitlines()
        print(f"## {name}\n")
        if doc:
            print(doc[0] + "\n")
        print(f"Jobs before the last plan: {eager}; tables stored: {len(stored)}.\n")
        for x in stored:
            print(f"- stored, {x}")
        if stored:
            print()
        print("| node | count |\n| --- | --- |")
        for k, v in s["counts"].items():
            print(f"| {k} | {v} |")
        print()
        seen = set()
        for t, schema, pushed in s["reads"]:
            if (t, schema, pushed) in seen:
                continue
            seen.add((t, schema, pushed))
            print(f"- scan `{t}` reads `{schema}`; pushed filters `{pushed}`")
        print()


if __name__ == "__main__":
    main(sys.argv)
