"""Token id files: Elias-Fano against plain lists, tokenising by runs against whole
texts, and a whole round trip."""

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF001
from tests.llm import corpora
from txlens.llm import token_ids
from txlens.llm.catalog import tokenizer_json
from txlens.llm.token_ids import EliasFano, Segment


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizer_json()


@lru_cache
def library(tokenizer):
    from tokenizers import Tokenizer
    return Tokenizer.from_str(tokenizer)


def whole(tokenizer, text):
    return library(tokenizer).encode(text or "", add_special_tokens=False).ids


@settings(deadline=None, max_examples=150)
@given(st.lists(st.integers(0, 2 ** 64 - 1) | st.integers(0, 50), max_size=400))
def test_elias_fano_equals_the_list(values):
    values = sorted(values)
    ef = EliasFano(EliasFano.pack(np.array(values, "uint64")))
    assert len(ef) == len(values) and ef.all().tolist() == values
    assert [ef[i] for i in range(len(values))] == values
    for v in {0, 25, *values[:5]}:
        assert ef.before(v) == sum(x <= v for x in values)


def test_elias_fano_is_small():
    rng = np.random.default_rng(0)
    values = np.cumsum(rng.integers(1, 1200, 200_000))
    packed = EliasFano.pack(values)
    assert len(packed) * 8 / len(values) < 2 + np.log2(values[-1] / len(values)) + 1     # select samples included
    ef = EliasFano(packed)
    for i in rng.integers(0, len(values), 300):
        assert ef[int(i)] == values[i]


def test_segment():
    docs, ids = [None, -5, -5, 2 ** 62], [[2], [7, 8, 2], [2], [65535] * 70_000 + [2]]
    flat = np.concatenate([np.array(x, "<u2") for x in ids])
    data, _ = Segment.pack(3, docs, [len(x) for x in ids], flat.tobytes(), 2)
    s = Segment(data + b"\n")
    assert (s.number, s.n_ids) == (3, len(flat))
    assert [s.doc_id(i) for i in range(4)] == docs and [s[i].tolist() for i in range(4)] == ids
    assert [s.document_at(p) for p in (0, 1, 3, 4, 5, len(flat) - 1)] == [0, 1, 1, 2, 3, 3]


PIECES = st.sampled_from(["don't", "'s", "''s", "!'S", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "É", "é", "ΑΣ", "ΑΣ.", "İ",
                          " ", "\n", "\t\x0b", "\x1c", "\x85", " ", "　", "12a", "_", "a.b", "𝒳", "日本", "́x", "\x00",
                          "WE'LL", "ﬁ", "ǅ", "I'M", "x'", "ÀÉ", "ß½²", "\u024f\u0250", "\xa0", "\xad\x7f", "ÿŸ", "'SÉ"])


@settings(deadline=None, max_examples=300)
@given(st.lists(PIECES | st.text(max_size=6), max_size=30))
def test_encoding_by_pre_tokens_equals_whole_texts(tokenizer, parts):
    text = "".join(parts).encode("utf-8", "replace").decode()
    if not hasattr(test_encoding_by_pre_tokens_equals_whole_texts, "encode"):
        test_encoding_by_pre_tokens_equals_whole_texts.encode = token_ids.make_encoder(tokenizer)
    encode = test_encoding_by_pre_tokens_equals_whole_texts.encode
    assert [x.tolist() for x in encode([text, text + " a", ""])] == [whole(tokenizer, t) for t in (text, text + " a", "")]


def test_pre_tokens_are_forgotten_at_the_bound(tokenizer, monkeypatch):
    monkeypatch.setattr(token_ids, "KNOWN", 20)
    encode = token_ids.make_encoder(tokenizer)
    texts = corpora.texts()
    for t in (x or "" for x in texts):
        assert encode([t])[0].tolist() == whole(tokenizer, t)


def test_other_tokenizers_get_whole_texts():
    byte_level = tokenizer_json("byte_bpe_50k.json")
    assert not token_ids.pre_token_wise(byte_level)
    encode = token_ids.make_encoder(byte_level)
    assert [x.tolist() for x in encode(["a  b", " x\n"])] == [whole(byte_level, "a  b"), whole(byte_level, " x\n")]


def expected(tokenizer, rows):
    """Sorted by id; rows of one id in any order, so their ids are compared as a multiset."""
    out = {}
    for doc_id, text, *_ in rows:
        out.setdefault(doc_id, []).append(whole(tokenizer, text) + [2])
    return out


@pytest.mark.parametrize("segment_bytes", [1 << 24, 2000, 1])
def test_round_trip(spark, tmp_dir, tokenizer, segment_bytes):
    rows = corpora.rows() + [(-7, "negative", "en", "s", 1), (2 ** 62, "far", "en", "s", 1)]
    docs = spark.createDataFrame(rows, corpora.SCHEMA).repartition(3)
    n = token_ids.write_ids(docs, f"{tmp_dir}/ids", tokenizer, 2, segment_bytes=segment_bytes)
    got = token_ids.read_ids(spark, f"{tmp_dir}/ids").orderBy("start").collect()
    files = spark.read.format("binaryFile").load(f"{tmp_dir}/ids").count()
    assert {1 << 24: 1, 2000: 10, 1: len(rows) - 10}[segment_bytes] <= files // 2 <= n
    want = expected(tokenizer, rows)
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        at += len(ids)
    assert not any(want.values())


def test_equal_rows_are_dealt_over_segments(spark, tmp_dir, tokenizer):
    rows = [(5, "the same text", "en", "s", 1)] * 400 + [(9, "after it", "en", "s", 1), (1, "before", "en", "s", 1)]
    n = token_ids.write_ids(spark.createDataFrame(rows, corpora.SCHEMA).repartition(3), f"{tmp_dir}/ids", tokenizer, 2,
                            segment_bytes=700)
    got = token_ids.read_ids(spark, f"{tmp_dir}/ids").orderBy("start").collect()
    assert n >= 6 and [r.doc_id for r in got] == [1] + [5] * 400 + [9]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    held = spark.read.format("binaryFile").load(f"{tmp_dir}/ids").selectExpr("max(length)").first()[0]
    assert held < 3000


def test_no_rows_and_clashing_columns(spark, tmp_dir, tokenizer):
    assert token_ids.write_ids(corpora.empty(spark), f"{tmp_dir}/none", tokenizer, 2) == 0
    assert token_ids.read_ids(spark, f"{tmp_dir}/none").count() == 0
    docs = corpora.clashing(spark).withColumnsRenamed({"leak": "ids", "digest": "row", "state": "segment", "fp": "n"})
    token_ids.write_ids(docs, f"{tmp_dir}/clash", tokenizer, 2)
    assert token_ids.read_ids(spark, f"{tmp_dir}/clash").count() == docs.count()


def test_query_against_the_library(spark, tokenizer):
    import __spark_entry__ as entry
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want, at = [], 0
    for r in docs:
        ids = whole(tokenizer, r.text) + [2]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = entry.queries()["op11_token_ids"](spark, SF001)
    assert sorted(map(tuple, got.collect())) == want
