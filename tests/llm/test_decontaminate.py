"""Decontamination against a direct scan."""

import hashlib
import re

from tests.llm import corpora
from txlens.llm import decontaminate

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(docs, items, n=10):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(n, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for gram, ids in windows.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), sorted(x for x in found if x is not None)))
    return sorted(out, key=repr)


def fixture():
    docs = corpora.rows()
    source = [d[1] for d in docs if d[1]]
    long = corpora.texts()[65]
    passage = " ".join(source[5].split()[:12])
    items = [(1, source[1]), (2, " ".join(long.split()[5000:5040])), (10, passage), (11, passage), (3, "x"), (4, ""),
             (5, None), (None, source[8]), (6, "ÉLAN vital, où"), (1, source[9]), (7, "never said by anyone at all")]
    docs = docs + [(500, "Before. " + passage.upper().replace(" ", "--") + "! After " + passage, "en", "s", 1),
                   (501, passage + " " + passage + " tail", "en", "s", 1)]
    return docs, items


def test_leaks(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, corpora.SCHEMA).repartition(4)
    b = spark.createDataFrame(items, "item_id long, text string")
    for limit in (1 << 24, 2000):         # one block, then several
        got = decontaminate.find_leaks(d, b, max_block_bytes=limit).collect()
        assert sorted(((r.doc_id, r.leak.n_words, r.leak.n_hit, r.leak["items"]) for r in got), key=repr) == brute(docs, items)


def test_copies_of_one_text_do_not_exceed_a_block(spark):
    text = "one item that many benchmark rows repeat word by word " * 4
    items = [(i, text) for i in range(300)] + [(None, text)] * 50 + [(7, text)] * 50 + [(900, "x y " * 400)]
    items += [(1000 + i, f"other item {i} " * 10) for i in range(100)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    blocks = [b.collect() for b in decontaminate._blocks(bench, "item_id", "text", 3000)]
    assert all(len(b) == 1 or sum(len(r.text) for r in b) <= 3000 for b in blocks)
    assert sorted({(r.item, bytes(r.text).decode()) for b in blocks for r in b}, key=repr) == sorted(set(items), key=repr)


def test_text_ids_and_index_size(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, corpora.SCHEMA)
    named = [(None if i is None else f"gsm8k-{i}", t) for i, t in items]
    for limit in (1 << 24, 2000):
        got = decontaminate.find_leaks(d, spark.createDataFrame(named, "item_id string, text string"), max_block_bytes=limit)
        want = [(a, b, c, sorted(f"gsm8k-{x}" for x in found)) for a, b, c, found in brute(docs, items)]
        assert sorted(((r.doc_id, r.leak.n_words, r.leak.n_hit, r.leak["items"]) for r in got.collect()), key=repr) == sorted(want, key=repr)
    rng = __import__("random").Random(1)
    text = " ".join(str(rng.randrange(10 ** 6)) for _ in range(40_000))
    state = decontaminate.WindowIndex.build([(1, text.encode()), (2, text.encode())], 10)
    arrays = sum(a.nbytes for parts in state[3].values() for a in parts)
    assert arrays < 45 * len(text) and len(state[3][10][0]) <= 40_000


def test_removal(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, corpora.SCHEMA)
    b = spark.createDataFrame(items, "item_id long, text string")
    clean = {x[0] for x in brute(docs, items) if x[2] == 0}
    assert {r.doc_id for r in decontaminate.remove_documents(d, b).collect()} == clean
    cut = {r.doc_id: r.text for r in decontaminate.remove_spans(d, b).collect() if r.doc_id and r.doc_id >= 500}
    assert cut == {500: "Before. ! After ", 501: " tail"}


def test_clashing_columns_and_empty_tables(spark):
    d = corpora.clashing(spark)
    b = spark.createDataFrame([(1, "x")], "item_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.remove_documents(d, b).columns == d.columns
    assert decontaminate.remove_documents(d, none).count() == d.count()
    assert decontaminate.find_leaks(corpora.empty(spark), b).count() == 0


def test_digest_of_item_ids_sorts_as_strings(spark):
    import __spark_entry__ as entry
    from tests.conftest import SF001
    got = entry.queries()["op9_decontamination"](spark, SF001).filter("n_items = 0").first()
    assert got.items_sha256 == hashlib.sha256(b"").hexdigest()
