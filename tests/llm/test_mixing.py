"""Temperature mixing: exponent, budgets and block permutations by hand."""

import math
from collections import Counter, defaultdict

import pytest

from tests.llm import corpora
from txlens.llm import mixing


def table_of(spark, tokens):
    return mixing.shares(spark.createDataFrame([(k, v) for k, v in tokens.items()], "source string, tokens long"))


def share(tokens, a):
    total = sum(tokens.values())
    power = {k: (v / total) ** a for k, v in tokens.items()}
    z = sum(power.values())
    return {k: v / z for k, v in power.items()}


def test_exponent_meets_the_repetition_limit(spark):
    tokens = {"a": 9000, "b": 1000, "c": 500, None: 2000}
    a = mixing.find_exponent(table_of(spark, tokens), max_repeats=3.0)
    assert a == pytest.approx(1 - math.log(3) / math.log(18), abs=1e-6)
    assert mixing.find_exponent(table_of(spark, tokens), max_repeats=100.0) == 0.0


def test_exponent_meets_the_entropy(spark):
    tokens = {"a": 9000, "b": 1000, "c": 500}
    a = mixing.find_exponent(table_of(spark, tokens), entropy=0.9)
    assert -sum(w * math.log(w) for w in share(tokens, a).values()) == pytest.approx(0.9, abs=1e-5)


def test_exponent_under_a_fixed_budget(spark):
    tokens = {"a": 9000, "b": 1000}
    a = mixing.find_exponent(table_of(spark, tokens), max_repeats=2.0, budget=10_000.0)
    w = share(tokens, a)
    assert w["b"] * 10_000 / 1000 == pytest.approx(2.0, abs=1e-4)


def counted(rows):
    out = defaultdict(Counter)
    for r in rows:
        out[r.source][r.doc_id] += 1
    return out


def test_every_document_once_and_small_sources_up_to_the_limit(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "big" if i < 4000 else f"s{i % 3}", 1) for i in range(5000)]
    got = mixing.mix(spark.createDataFrame(rows, corpora.SCHEMA), max_repeats=2.5).collect()
    by_source = counted(got)
    assert {k for c in by_source.values() for k in c} == {r[0] for r in rows}
    assert set(by_source["big"].values()) == {1}
    natural = Counter()
    for _, t, _, s, _ in rows:
        natural[s] += len(t.split())
    taken = Counter()
    for r in got:
        taken[r.source] += len(r.text.split())
    a = 1 - math.log(2.5) / math.log(max(natural.values()) / min(natural.values()))
    w = share(natural, a)
    budget = natural["big"] / w["big"]
    for s in natural:
        assert -6 <= taken[s] - w[s] * budget <= 1       # short of the budget by less than a document
        assert set(by_source[s].values()) <= {1, 2, 3}
    assert max(taken[s] / natural[s] for s in natural) <= 2.5
    # an epoch holds no document twice, and blocks share one place in the order
    assert len({(r.doc_id, r.epoch) for r in got}) == len(got)
    assert len({(r.epoch, r.source, r.block) for r in got}) == len({(r.epoch, r.source, r.block, r.mix_order) for r in got})


def test_default_budget_holds_every_token_of_the_largest_source(spark):
    # beyond 2^34 tokens the doubles around a budget are too coarse to floor it
    table = table_of(spark, {"a": 33_000_000_019, "b": 30_000_000_001, "c": 3_000_017, None: 500}).cache()
    for i in (9, 15, 20, 27, 32, 42, 50, 64):
        for r in mixing.weights(table, i / 64).collect():
            assert r.whole >= 1 and r.budget == r.whole * r.tokens + r.rest >= r.tokens
    table.unpersist()


def test_head_of_the_permutation_under_a_small_budget(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    rows = [(i, "w " * 4, "en", f"s{i % 2}", 1) for i in range(1000)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA)
    got = mixing.mix(docs, budget=2000.0, max_repeats=None, entropy=math.log(2)).collect()
    assert Counter(r.source for r in got) == {"s0": 250, "s1": 250} and {r.epoch for r in got} == {0}
    # whole blocks but for one per source
    size = Counter((r.source, r.block) for r in mixing.mix(docs).collect())
    part = Counter((r.source, r.block) for r in got)
    assert sum(part[k] not in (0, size[k]) for k in size) <= 2
    again = mixing.mix(docs.repartition(7), budget=2000.0, max_repeats=None, entropy=math.log(2)).collect()
    assert {r.doc_id for r in again} == {r.doc_id for r in got}


def test_awkward_rows_and_clashing_columns(spark):
    docs = corpora.clashing(spark)
    got = mixing.mix(docs)
    assert set(got.columns) == set(docs.columns)
    before = Counter((r.doc_id, r.text) for r in docs.collect())
    after = Counter((r.doc_id, r.text) for r in got.collect())
    assert set(before) == set(after) and all(after[k] % before[k] == 0 for k in before)


def test_empty_and_tokenless(spark):
    assert mixing.mix(corpora.empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, "", None, "a", 0), (2, None, None, None, 0)], corpora.SCHEMA)
    assert sorted(r.doc_id for r in mixing.mix(blank).collect()) == [1, 2]


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(corpora.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_named_like_the_cuts(spark):
    docs = corpora.clashing(spark).withColumnsRenamed({"leak": "__cut_whole", "digest": "__cut_source", "state": "__CUT__rest"})
    assert mixing.mix(docs).columns[-3:] == ["epoch", "block", "mix_order"]
    assert {"__cut_whole", "__CUT__rest"} <= set(mixing.mix(docs).columns) and mixing.mix(docs).count() >= docs.count()
