"""SimHash near-dedup against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import corpora
from txlens.llm import simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < 4 else [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def classes(codes, distance):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def test_fingerprints():
    texts = corpora.texts()
    got = simhash.fingerprints([(t or "").encode() for t in texts])
    assert got.tolist() == [fingerprint(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(2, 400), st.integers(0, 6), st.integers(1, 3))
def test_cell_index_finds_every_component(seed, n, distance, cells):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    codes = {rng.getrandbits(64) if rng.random() < 0.3 else rng.choice(centres) ^ sum(
        1 << rng.randrange(64) for _ in range(rng.randrange(5))) & (1 << 64) - 1 for _ in range(n)}
    codes = np.array(sorted(codes), "uint64")
    cell = np.array([rng.randrange(cells) for _ in codes])
    a, b = simhash.gray_links(cell, codes, distance)
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, y in zip(a.tolist(), b.tolist()):
        assert cell[x] == cell[y]
        root[max(find(x), find(y))] = min(find(x), find(y))
    for c in range(cells):
        own = np.flatnonzero(cell == c).tolist()
        want = classes([int(codes[i]) for i in own], distance)
        got = [find(i) for i in own]
        assert len({*zip(want, got)}) == len(set(want)) == len(set(got))


@pytest.mark.parametrize("distance", [0, 2, 4, 7])
def test_links_over_all_routes(spark, distance, monkeypatch):
    monkeypatch.setattr(simhash, "MIN_CELL", 16)       # large buckets are cut into pieces
    routes = simhash.routes
    if distance in (2, 4):                             # as on a large table: longer keys, more routes
        monkeypatch.setattr(simhash, "routes", lambda d, total: routes(d, total << 20))
    if distance == 2:
        monkeypatch.setattr(simhash, "MAX_LISTED", 1)      # the list of large buckets is joined by shuffle
    monkeypatch.setattr(simhash, "HUB", 8)
    rng = random.Random(distance)
    centre = rng.getrandbits(64)
    codes = sorted({rng.getrandbits(64) for _ in range(200)} | {centre ^ (1 << i) ^ (1 << j) for i in range(64) for j in range(0, 40, 3)})
    rows = [(i, int(np.array(c, "uint64").view("int64"))) for i, c in enumerate(codes)]
    got = {r.fp: r.component_id for r in simhash.near_classes(
        spark.createDataFrame(rows, "doc_id long, fp long"), distance).collect()}
    want = classes(codes, distance)
    assert [got[fp] for _, fp in rows] == want


def test_documents(spark):
    rows = corpora.rows()
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(5)
    got = simhash.near_duplicates(docs).collect()
    codes = [fingerprint(r[1]) for r in rows]
    root = classes(codes, 4)
    least = {}
    for r, c in zip(rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = sorted(((r[0], c, least.get(k)) for r, c, k in zip(rows, codes, root)), key=repr)
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == want
    assert len({c for c in root}) < len(rows)


def test_keep_one(spark):
    docs = corpora.clashing(spark)
    got = simhash.keep_one(docs)
    rows = corpora.rows(2, 30)
    root = classes([fingerprint(r[1]) for r in rows], 4)
    assert got.columns == docs.columns
    kept = got.collect()
    assert len(kept) == len(set(root))
    least = {}
    for r, c in zip(rows, root):
        least.setdefault(c, []).append(r[0])
    want = sorted((min((i for i in ids if i is not None), default=None) for ids in least.values()), key=repr)
    assert sorted((r.doc_id for r in kept), key=repr) == want


def test_empty_and_all_alike(spark):
    assert simhash.near_duplicates(corpora.empty(spark)).count() == 0
    assert simhash.keep_one(corpora.empty(spark)).count() == 0
    same = spark.createDataFrame([(i, "one text", None, None, None) for i in range(50)], corpora.SCHEMA)
    assert {r.component_id for r in simhash.near_duplicates(same).collect()} == {0}
    assert [r.doc_id for r in simhash.keep_one(same).collect()] == [0]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 7), st.integers(0, 1 << 34), st.integers(0, 1 << 64), st.data())
def test_routes_meet_every_pair(distance, total, code, data):
    """Whatever the bits that differ, some mask leaves them all out; buckets stay small."""
    masks = simhash.routes(distance, total)
    other = code
    for _ in range(distance):
        other ^= 1 << data.draw(st.integers(0, 63))
    assert any((code ^ other) & m == 0 for m in masks)
    assert total >> min(m.bit_count() for m in masks) <= simhash.MEAN_BUCKET


def test_routes_by_table_size():
    sizes = [(len(m), min(x.bit_count() for x in m)) for m in (simhash.routes(4, 1 << n) for n in (0, 23, 24, 31, 32, 38))]
    assert sizes == [(5, 12), (5, 12), (15, 20), (15, 20), (35, 27), (35, 27)]


def test_hubs_of_a_star(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HUB", 3)
    edges = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(5, i) for i in range(30, 50)] + [(49, 99)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == dict.fromkeys([*range(50), 99], 0)
