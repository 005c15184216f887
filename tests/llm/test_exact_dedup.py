"""Exact dedup against a dictionary, with heavy groups on and off the broadcast."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest

from tests.llm import corpora
from txlens.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        key = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()
        groups[key].append(doc_id)
    out = Counter()
    for key, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[(i, key, keep, len(ids), i == keep)] += 1
    return out


@pytest.mark.parametrize("support", [1 / 1024, 0.02, 0.2])
def test_assignments(spark, support):
    rows = corpora.rows() + [(1000 + i, "hot copy", "en", "s", 8) for i in range(60)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(5)
    got = exact_dedup.dedup_assignments(docs, support=support)
    assert Counter((r.doc_id, r.digest, r.keep_id, r.group_size, r.kept) for r in got.collect()) == brute(rows)


def test_heavy_winners_are_verified(spark):
    rows = [(i, f"d{i}") for i in range(500)] + [(1000 + i, "hot") for i in range(250)]
    table = spark.createDataFrame(rows, "doc_id long, digest string")
    assert [tuple(r) for r in exact_dedup.heavy_winners(table, 0.1).collect()] == [("hot", 1000, 250)]


def test_deduplicate_keeps_one_whole_row_per_text(spark):
    docs = corpora.clashing(spark)
    got = exact_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    want = {k[1]: k[2] for k in brute(corpora.rows(2, 30))}
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert {key(r.text): r.doc_id for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("support", [1 / 1024, 0.1])
def test_deduplicate_settles_heavy_groups_by_broadcast(spark, support):
    rows = corpora.rows() + [(1000 + i // 3, "hot  copy" if i % 2 else "hot copy", "en", "s", 8) for i in range(150)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(5)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for name in names:
        spark.conf.set(name, "-1")
    try:
        got = exact_dedup.deduplicate(docs, support=support)
        plan = got._jdf.queryExecution().executedPlan().toString()
        out = got.collect()
    finally:
        for name in names:
            spark.conf.unset(name)
    assert plan.count("BroadcastHashJoin") >= 2
    want = {k[1]: k[2] for k in brute(rows)}
    key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert {key(r.text): r.doc_id for r in out} == want and len(out) == len(want)


def test_empty_table(spark):
    assert exact_dedup.dedup_assignments(corpora.empty(spark)).count() == 0
    assert exact_dedup.deduplicate(corpora.empty(spark)).count() == 0


def test_no_python_in_the_plan(spark):
    got = exact_dedup.dedup_assignments(corpora.documents(spark))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan
