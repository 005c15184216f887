"""Edit-aware counts against encoding the whole edited text again."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import corpora
from txlens.llm import token_counts as tc

COUNT = tc.counter()


def edited(text, edits):
    for start, n, insert in edits:
        start = min(max(start or 0, 0), len(text))
        text = text[:start] + (insert or "") + text[min(start + max(n or 0, 0), len(text)):]
    return text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab I'lst. \n\t09é !")), max_size=200), st.integers(1, 12))
def test_leaves_cut_at_pre_tokens(text, leaf):
    leaves = tc.split_leaves(text, leaf)
    assert "".join(leaves) == text and sum(map(COUNT, leaves)) == COUNT(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab I'lst. \n\t09é!")), max_size=300),
       st.lists(st.tuples(st.integers(-3, 320), st.integers(0, 60), st.text(alphabet="a 'ls\n1", max_size=30)), max_size=6))
def test_edits(text, edits):
    leaves = tc.split_leaves(text, 8)
    now = tc.Counted(text, [len(x) for x in leaves], [COUNT(x) for x in leaves], COUNT)
    for e in edits:
        now.edit(*e)
        assert now.tree.chars[1] == len("".join(now.leaves))
    want = edited(text, edits)
    assert "".join(now.leaves) == want and now.tree.tokens[1] == COUNT(want)
    chars, tokens = now.state()
    assert sum(chars) == len(want) and sum(tokens) == COUNT(want)


def test_only_touched_leaves_are_encoded():
    rng = random.Random(2)
    text = corpora.sentence(rng, 20_000)
    leaves = tc.split_leaves(text)
    now = tc.Counted(text, [len(x) for x in leaves], [COUNT(x) for x in leaves], COUNT)
    now.edit(len(text) // 2, 10, "changed")
    assert now.encoded < 3 * tc.LEAF and now.updated < 40
    assert now.tree.tokens[1] == COUNT("".join(now.leaves))


def test_documents_and_a_second_session_of_edits(spark):
    docs = corpora.clashing(spark).drop("state", "edits")
    rng = random.Random(4)
    edits = [(i, s, rng.randrange(0, 400), rng.randrange(0, 50), rng.choice(["x", " word", "", None, "\n\n"]))
             for i in range(40) for s in range(rng.randrange(4))] + [(None, 1, 0, 1, "lost"), (5, 9, None, None, None), (6, 9, -4, 2, "neg")]
    table = spark.createDataFrame(edits, "doc_id long, seq long, start long, n_delete long, insert string")
    state = tc.attach_edits(tc.build_state(docs), table)
    got = tc.apply_edits(state).collect()
    assert len(got) == docs.count()
    for r in got:
        todo = [(e["start"], e["n_delete"], e["insert"]) for e in r.edits or ()]
        assert len(todo) == sum(e[0] == r.doc_id for e in edits if r.doc_id is not None)
        want = edited(r.text or "", todo)
        assert r.edited.text == want and r.edited.n_tokens == COUNT(want)
        assert sum(r.state.tokens) == COUNT(r.text or "")
    # the state that came out takes further edits
    again = tc.apply_edits(tc.apply_edits(state).select(
        "doc_id", F.col("edited.text").alias("text"), F.struct("edited.chars", "edited.tokens").alias("state"),
        F.array(F.struct(F.lit(3).cast("long").alias("start"), F.lit(2).cast("long").alias("n_delete"),
                         F.lit("more ").alias("insert"))).alias("edits"))).collect()
    assert all(r.edited.n_tokens == COUNT(edited(r.text, [(3, 2, "more ")])) for r in again)


@pytest.mark.parametrize("make", [corpora.empty])
def test_empty_table(spark, make):
    docs = tc.build_state(make(spark)).withColumn("edits", F.lit(None).cast(f"array<{tc.EDIT}>"))
    assert tc.apply_edits(docs).count() == 0


def test_query_counts_are_exact(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF001
    got = {r.doc_id: r for r in entry.queries()["op4_edit_token_counts"](spark, SF001).collect()}
    texts = spark.read.parquet(f"{SF001}/documents.parquet").collect()
    assert len(got) == len(texts) and all(got[r.doc_id].n_tokens == COUNT(r.text) for r in texts)
    assert sum(r.chars_encoded for r in got.values()) < 3 * sum(min(2048, r.n_chars + 80) for r in got.values())
