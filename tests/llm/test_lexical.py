"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm import corpora
from txlens.llm import lexical

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, k=20):
    own = [(d[0], Counter(words(d[1]))) for d in docs]
    n_docs = sum(1 for _, c in own if c)
    total = sum(sum(c.values()) for _, c in own)
    out = []
    for item, text in set(items):
        scores = []
        for doc_id, c in own:
            s = 0
            for t in words(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(1 for _, x in own if x[t]) + 1)))
                    m = 75 + 25 * sum(c.values()) * n_docs // total
                    s += w * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, items, partitions=3, **options):
    d = spark.createDataFrame([x[:2] for x in docs], "doc_id long, text string").repartition(partitions)
    b = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, lexical.search(d, b, **options).collect()), key=repr)


def queries():
    t = corpora.texts()
    return [(1, t[1]), (2, " ".join(t[65].split()[50:90])), (3, "x Élan"), (4, ""), (5, None), (6, "nowhere said"),
            (None, t[8]), (7, "the the the of THE"), (1, t[1]), (1, t[2])]


@pytest.mark.parametrize("k", [1, 5, 20])
@pytest.mark.parametrize("blocks", [None, 7])
def test_search_equals_scoring_everything(spark, monkeypatch, k, blocks):
    if blocks:
        monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", blocks)
    docs = corpora.rows()
    assert found(spark, docs, queries(), k=k) == brute(docs, queries(), k)


def test_ties_and_copies(spark):
    docs = [(i, "equal words here") for i in range(200, 0, -1)] + [(500 + i, f"equal {i}") for i in range(30)] + [(None, "equal words here")]
    items = [(1, "equal"), (2, "words here"), (3, "here")]
    assert found(spark, docs, items, partitions=5) == brute(docs, items)
    assert sorted(r[2] for r in found(spark, docs, items) if r[0] == 2) == list(range(1, 21))


def test_query_blocks_and_text_ids(spark):
    docs, items = corpora.rows(), [(i, t) for i, t in enumerate(corpora.texts(5, 40)) if t and len(t) < 900]
    assert found(spark, docs, items, max_block_bytes=2000) == brute(docs, items)
    d = spark.createDataFrame([(f"d{x[0]}", x[1]) for x in docs], "key string, body string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.search(d, b, id_col="key", text_col="body").collect()
    assert {(r.item_id, r["rank"], r.score) for r in got} == {(i, r, s) for i, r, _, s in brute(docs, items)}


def test_stops_before_the_end():
    """One rare term decides: most documents are never met."""
    rng = random.Random(4)
    n = 4000
    terms = [np.sort(np.array(rng.sample(range(n), c))) for c in (3000, 2000, 25)]
    doc, term = np.concatenate(terms), np.repeat([0, 1, 2], [3000, 2000, 25])
    tf = np.ones(len(doc), "int64")
    lengths = np.array([rng.randint(20, 400) for _ in range(n)])
    weight = np.array([300, 700, 5000])
    lists = lexical.ImpactLists(lengths, term, doc, tf, weight, n, int(lengths.sum()))
    docs, scores, met = lexical.best_positions(lists, [0, 1, 2], [1, 1, 1], 20, 0)
    total = np.bincount(doc, lists.impact, n)
    want = np.lexsort((np.arange(n), -total))[:20]
    assert docs.tolist() == want.tolist() and scores.tolist() == total[want].astype(int).tolist()
    assert met < n // 2
    # a good k-th score from elsewhere ends it sooner and leaves nothing below it
    docs, scores, fewer = lexical.best_positions(lists, [0, 1, 2], [1, 1, 1], 20, int(total[want[4]]))
    assert fewer <= met and set(want[:5].tolist()) <= set(docs.tolist()) and (scores >= int(total[want[4]])).all()


def test_ties_at_the_bound_are_looked_at():
    """All impacts equal: the smallest documents win although they stand anywhere."""
    n = 300
    lists = lexical.ImpactLists(np.full(n, 5), np.zeros(n, "int64"), np.arange(n), np.ones(n, "int64"),
                                np.array([1000]), n, 5 * n)
    docs, _, _ = lexical.best_positions(lists, [0], [1], 20, 0)
    assert docs.tolist() == list(range(20))
    lists.ranked_doc = lists.ranked_doc[::-1].copy()
    lists.position = lists.position[::-1].copy()
    assert lexical.best_positions(lists, [0], [1], 20, 0)[0].tolist() == list(range(20))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(corpora.empty(spark), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0
    assert lexical.search(corpora.clashing(spark), none).count() == 0
    assert lexical.search(corpora.clashing(spark), spark.createDataFrame([(1, "the")], "item_id long, text string")).count() > 0
