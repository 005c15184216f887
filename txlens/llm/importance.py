"""Importance resampling towards a target: documents are weighted by how much
likelier the target's hashed n-grams make them, and the best Gumbel-perturbed
weights are drawn without replacement.

Features are all runs of 1 to ``n`` consecutive words (runs of ``0-9``, ``a-z``
after lower-casing A-Z, and non-ASCII characters), joined by one blank; a
feature's bucket is the CRC-32 of its bytes modulo ``buckets``.

The CRCs of a batch come from a position table.  CRC-32 without its constants is
linear, so the value of a span is the XOR of what each byte contributes at its
distance from the end (``TABLE[distance][byte]``); one ``bitwise_xor.reduceat``
adds up all spans of the batch, and a constant by length makes them CRC-32.
Spans longer than the table are cut into blocks from the end; the blocks of all
long spans are folded pairwise, the earlier one advanced by the zero bytes that
follow it (four byte tables a level, squared from level to level).

How it runs: (1) one pass over the texts stores every document's bucket numbers
(two bytes a feature) in the shared folder; (2) bucket counts of all documents
and of all target texts are vectors added up on the executors; (3) a document's
weight is the floored mean gain of its features, in tasks; (4) the eligible rows
are numbered in score order by ranges.  The only broadcast is one number a
bucket.  Texts are cut into pieces of ``PIECE`` bytes with the last words carried
over, so memory does not follow the longest text.

Defined results: NULL text has no words; no features: weight 0; a NULL id is
hashed as the text ``null`` and comes last among equal scores; rows that repeat
an id are drawn one by one; an empty target gives gains that follow the
documents alone; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.llm.common import bound_batches, col, fresh, sum_vectors, utf8
from txlens.llm.decontaminate import FOLD
from txlens.operators.ordering import global_position
from txlens.session import materialize

N = 2
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
REACH = 64              # distances from the end in the position table
PIECE = 1 << 20
POLYNOMIAL = 0xEDB88320
BLANK = 32


# -- CRC-32 of many spans -----------------------------------------------------

def _step(value: np.ndarray) -> np.ndarray:
    """The register after one zero bit."""
    return (value >> np.uint32(1)) ^ np.where(value & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))


def position_table(reach: int = REACH) -> np.ndarray:
    """reach x 256: what a byte contributes at each distance from the end."""
    out = np.empty((reach, 256), "uint32")
    value = np.arange(256, dtype="uint32")
    for d in range(reach):
        for _ in range(8):
            value = _step(value)
        out[d] = value
    return out


def advance_tables(zero_bytes: int) -> np.ndarray:
    """4 x 256: a register, byte by byte, after so many zero bytes."""
    bits = np.uint32(1) << np.arange(32, dtype="uint32")
    for _ in range(8 * zero_bytes):
        bits = _step(bits)
    out = np.zeros((4, 256), "uint32")
    for k in range(4):
        for j in range(8):
            out[k] ^= np.where(np.arange(256) >> j & 1, bits[8 * k + j], np.uint32(0))
    return out


def advance(tables: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (tables[0][value & 255] ^ tables[1][value >> 8 & 255] ^ tables[2][value >> 16 & 255] ^ tables[3][value >> 24])


class SpanCrc:
    """CRC-32 of spans of a byte array."""

    def __init__(self, reach: int = REACH):
        self.reach = reach
        self.table = position_table(reach).ravel()
        self.constant = np.array([zlib.crc32(bytes(k)) for k in range(reach + 1)], "uint32")
        self.levels = [advance_tables(reach)]       # level k: after reach * 2^k zero bytes

    def __call__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``length`` must be positive."""
        long = np.flatnonzero(length > self.reach)
        if not len(long):
            return self.linear(data, start, length) ^ self.constant[length]
        short = np.flatnonzero(length <= self.reach)
        out = np.empty(len(start), "uint32")
        out[short] = self(data, start[short], length[short])
        out[long] = self.folded(data, start[long], length[long])
        return out

    def linear(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span's bytes."""
        if not len(start):
            return np.zeros(0, "uint32")
        end = np.cumsum(length)
        run = np.arange(end[-1])
        at = run + np.repeat(start - (end - length), length)
        distance = np.repeat(end - 1, length) - run
        return np.bitwise_xor.reduceat(self.table[distance * 256 + data[at]], end - length)

    def folded(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Spans longer than the table, in blocks counted from the end."""
        blocks = -(-length // self.reach)
        first = np.cumsum(blocks) - blocks
        k = np.arange(blocks.sum()) - np.repeat(first, blocks)                  # 0: the last block
        stop = np.repeat(start + length, blocks) - k * self.reach
        begin = np.maximum(stop - self.reach, np.repeat(start, blocks))
        value = np.concatenate([self.linear(data, begin[i:i + 16_384], (stop - begin)[i:i + 16_384])
                                for i in range(0, len(begin), 16_384)])
        level = 0
        while k.any():
            if level == len(self.levels):
                t = self.levels[-1]
                self.levels.append(np.stack([advance(t, x) for x in t]))
            odd = np.flatnonzero(k & 1)
            value[odd - 1] ^= advance(self.levels[level], value[odd])
            even = (k & 1) == 0
            value, k, level = value[even], k[even] >> 1, level + 1
        return value ^ self.length_constants(length)

    def length_constants(self, length: np.ndarray) -> np.ndarray:
        """CRC-32 of so many zero bytes, for each length beyond the table."""
        kinds, at = np.unique(length, return_inverse=True)
        ones = np.full(len(kinds), 0xFFFFFFFF, "uint32")
        rest = kinds.copy()
        tables = advance_tables(1)
        while rest.any():
            ones = np.where(rest & 1, advance(tables, ones), ones)
            rest >>= 1
            tables = np.stack([advance(tables, x) for x in tables])
        return (ones ^ np.uint32(0xFFFFFFFF))[at]


# -- features -----------------------------------------------------------------

def pieces(text: bytes, n: int, size: int = PIECE) -> list[tuple[bytes, int]]:
    """The folded text in pieces cut between words; the number says how many
    words at a piece's head are those the last piece ended with."""
    folded = text.translate(FOLD)
    out, at, head = [], 0, []
    while at < len(folded) or not out:
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        piece = b" ".join([*head, folded[at:end]])
        out.append((piece, len(head)))
        head = piece.rsplit(None, n - 1)[-(n - 1):] if n > 1 else []
        at = end
    return out


def bucket_numbers(texts: list[bytes], n: int, buckets: int, crc: SpanCrc) -> Iterator[tuple[int, np.ndarray]]:
    """(words, bucket of every feature) of each text."""
    held: list[tuple[int, bytes, int]] = []
    words = np.zeros(len(texts), "int64")
    found: list[list[np.ndarray]] = [[] for _ in texts]

    def flush() -> None:
        data = np.frombuffer(b" ".join(p for _, p, _ in held) + b" ", "u1")
        stop = np.cumsum([len(p) + 1 for _, p, _ in held]) - 1            # the blank after each piece
        held_words = data != BLANK
        keep = held_words.copy()
        keep[1:] |= held_words[:-1]                                       # and one blank after each word
        last = np.flatnonzero(keep & ~held_words)
        counts = np.diff(np.searchsorted(last, stop, "right"), prepend=0)
        compact = data[keep]
        end = np.flatnonzero(compact == BLANK)
        start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
        piece = np.repeat(np.arange(len(held)), counts)
        carried = np.array([c for _, _, c in held])
        inside = np.arange(len(end)) - np.repeat(np.cumsum(counts) - counts, counts)
        owners, numbers = [], []
        for run in range(1, min(n, len(end)) + 1):
            tail = np.arange(run - 1, len(end))
            tail = tail[(inside[tail] >= run - 1) & (inside[tail] >= carried[piece[tail]])]
            head = tail - run + 1
            owners.append(piece[tail])
            numbers.append(crc(compact, start[head], end[tail] - start[head]) % np.uint32(buckets))
        if owners:
            owner, number = np.concatenate(owners), np.concatenate(numbers)
            order = np.argsort(owner, kind="stable")
            parts = np.split(number[order], np.cumsum(np.bincount(owner, minlength=len(held)))[:-1])
            for (text, _, c), part, count in zip(held, parts, counts):
                found[text].append(part)
                words[text] += count - c
        held.clear()

    size = 0
    for i, t in enumerate(texts):
        for p, c in pieces(t, n):
            held.append((i, p, c))
            size += len(p)
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    for count, parts in zip(words.tolist(), found):
        yield count, np.concatenate(parts) if parts else np.zeros(0, "uint32")


def hashed_features(n: int = N, buckets: int = BUCKETS):
    """Pandas UDF: UTF-8 text -> (n_words, n_features, numbers)."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    @F.pandas_udf("struct<n_words:bigint,n_features:bigint,numbers:binary>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        crc = SpanCrc()
        for texts in batches:
            rows = [(w, len(b), b.astype(width).tobytes())
                    for w, b in bucket_numbers([bytes(t) for t in texts], n, buckets, crc)]
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "numbers"])

    return run


def bucket_counts(numbers: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in the one binary column."""
    width = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(buckets)
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=buckets)
        yield total

    return sum_vectors(numbers, count, buckets)


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of smoothed shares) by bucket."""
    size = float(len(own))
    ratio = (target + 1.0) * (own.sum() + size) / ((own + 1.0) * (target.sum() + size))
    return np.floor(1000.0 * np.log(ratio)).astype("int64")


def weigher(gain: np.ndarray):
    """Pandas UDF: bucket numbers -> floored mean of their gains."""
    width = "<u2" if len(gain) <= 1 << 16 else "<u4"

    @F.pandas_udf("long")
    def run(numbers: pd.Series) -> pd.Series:
        out = np.zeros(len(numbers), "int64")
        for i, x in enumerate(numbers):
            if x:
                g = gain[np.frombuffer(x, width)]
                out[i] = int(g.sum()) // len(g)
        return pd.Series(out)

    return run


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor of 1000 times a standard Gumbel number drawn by the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


# -- the operator -------------------------------------------------------------

def score_documents(docs: DataFrame, target: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id",
                    text_col: str = "text", target_text_col: str = "text", n: int = N, buckets: int = BUCKETS,
                    min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
                    into: str = "draw") -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: the id) and a struct ``into``: n_words,
    n_features, weight, score and rank (from 1; NULL for what is not drawn)."""
    bound_batches(docs.sparkSession)
    keep = [id_col] if keep is None else keep
    own = docs.select(*[col(c) for c in keep], *([] if id_col in keep else [col(id_col)]),
                      *([] if text_col in keep else [col(text_col)]))
    x, weight, score, row, position = (fresh(own, s) for s in ("x", "weight", "score", "row", "position"))
    hashed = own.withColumn(x, hashed_features(n, buckets)(utf8(text_col)))
    stored = materialize(hashed.select(*[col(c) for c in dict.fromkeys([*keep, id_col])], x)
                         .withColumn(row, F.monotonically_increasing_id()))                # fixed once stored
    wanted = bucket_counts(target.select(hashed_features(n, buckets)(utf8(target_text_col)).alias("x")).select("x.numbers"), buckets)
    gain = gains(bucket_counts(stored.select(f"{x}.numbers"), buckets), wanted)
    scored = (stored.withColumn(weight, weigher(gain)(F.col(f"{x}.numbers")))
              .withColumn(x, F.struct(f"{x}.n_words", f"{x}.n_features"))
              .withColumn(score, F.col(weight) + gumbel(col(id_col), seed)))
    eligible = F.col(f"{x}.n_words") >= min_words
    order = [F.col(score).desc(), col(id_col).asc_nulls_last(), F.col(row)]
    numbered = global_position(scored.filter(eligible), order, position)
    drawn = stored.filter(eligible).count() * percent // 100
    every = numbered.unionByName(scored.filter(~eligible).withColumn(position, F.lit(None).cast("long")))
    rank = F.when(F.col(position) <= drawn, F.col(position)).cast("long")
    return every.select(*[col(c) for c in keep if c != into], F.struct(
        f"{x}.n_words", f"{x}.n_features", F.col(weight).alias("weight"), F.col(score).cast("long").alias("score"),
        rank.alias("rank")).alias(into))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all their columns."""
    into = fresh(docs, "draw")
    return (score_documents(docs, target, keep=docs.columns, into=into, **options)
            .filter(F.col(f"{into}.rank").isNotNull()).drop(into))
