"""Hidden Markov language model: Baum-Welch counts over all partitions, exact
sequence likelihood by the scaled forward recursion.

Tokens are lower-cased words and one end per text.  The emission of a word is
factored: a state emits a class, the class emits the word.

* The ``OWN`` most frequent training words of at most ``HEAVY_BYTES`` bytes (fewer if
  equally rare words would exceed the bounds) and the end are classes of their own.
* Every other word, known or not, belongs to one of ``SHAPES`` classes by the
  hash of its last bytes, and has probability (c + 1) / (N_k + V_k + 1) inside
  its class (c: its training count; N_k, V_k: training tokens and distinct
  words of the class; one more type for all unknown words).

So the states' tables have a fixed size (states x classes) and are small enough
to be sent to every task, while the word counts, which grow with the corpus,
stay a distributed table: no word is cut off.

Passes: (1) count the training words; (2) turn each text into class numbers,
stored in the shared folder, and add up what its frequent words contribute
(the ``HEAVY`` most frequent words are broadcast with their counts, a fixed
bound); the rarer words leave as (row, word, times) and meet the count table by
a shuffle join, so that no very frequent word ever is a join key; (3) Baum-Welch rounds
over the stored class numbers of all training texts; (4) the forward recursion
over every text.

Training is exact: forward and backward run over whole texts, many at a time,
longest first.  Where a group of texts is longer than ``GROUP`` tokens, the forward
values are kept at a few places only and computed again from there, so memory does
not follow the longest text.  The counts are sums over texts: they do not depend
on how the rows are dealt to tasks.

Defined results: NULL text counts as empty (one end token); rows that repeat an
id are rows of their own; a NULL id is a training row; without training rows
every word is unknown and the states are uniform; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat
from math import log10
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txlens.llm.common import bound_batches, col, sum_vectors, utf8
from txlens.session import materialize

STATES = 6
OWN = 4_096
SHAPES = 4_095
END = OWN                       # class number of the end
CLASSES = OWN + 1 + SHAPES
HEAVY = 65_536
SUFFIX = 4
GROUP = 1 << 20                 # tokens whose forward values are held at a time
TOGETHER = 1 << 23              # tokens of the texts that are run through together
ROUNDS = 6
PRIOR = 200.0                   # pseudo tokens of the overall class shares in each state
FLUSH = 300_000
FLUSH_BYTES = 256 << 20
HEAVY_BYTES = 64                # longer words are never broadcast
SEED = 11


def words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, split at ASCII blanks."""
    return text.lower().split()


def shape_class(word: bytes) -> int:
    return OWN + 1 + crc32(word[-SUFFIX:]) % SHAPES


def shape_class_column(word: Column) -> Column:
    return (F.crc32(F.substring(word, -SUFFIX, SUFFIX)) % SHAPES + OWN + 1).cast("int")


# -- word counts --------------------------------------------------------------

def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) over the one binary column of ``texts``."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held = 0

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
                                             names=["word", "c"])
            seen.clear()
            return got

        for b in batches:
            for text in b.column(0):
                own = text.as_py()
                seen.update(words(own))
                held += len(own)
                if len(seen) > FLUSH or held > FLUSH_BYTES:      # distinct words cannot exceed the texts
                    yield out()
                    held = 0
        yield out()

    return texts.mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What every task needs to know of the word counts; of fixed size."""
    index: dict[bytes, int]      # heavy word -> rank + 1
    log_count: np.ndarray        # log10(c + 1) by rank + 1; 0 for none
    class_of: np.ndarray         # class by rank + 1
    log_class: np.ndarray        # log10 of a class's N_k + V_k + 1; 0 for own classes
    class_share: np.ndarray      # smoothed share of each class in training
    end_log: float               # log10(count of the end + 1)
    tokens: int                  # N
    types: int                   # V

    @property
    def log_total(self) -> float:
        return log10(self.tokens + self.types + 1)


def heavy_words(counts: DataFrame, limit: int = HEAVY) -> list:
    """The words at or above the lowest count level that at most ``limit`` words
    reach, most frequent first.  Levels are 16 steps an octave; their sizes (a
    row each) are counted first, so that no partition sends more than its share.
    Words of more than ``HEAVY_BYTES`` are left out: they meet the count table like
    the rare ones."""
    counts = counts.filter(F.octet_length("word") <= HEAVY_BYTES)
    level = F.floor(F.log2("c") * 16).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()),
                   reverse=True)
    least, total = None, 0
    for at, n in sizes:
        total += n
        if total > limit:
            break
        least = at
    if least is None:
        return []
    return sorted(counts.filter(level >= least).collect(), key=lambda r: (-r.c, bytes(r.word)))   # at most ``limit`` rows


def build_vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    heavy = heavy_words(counts, HEAVY)
    own = [bytes(r.word) for r in heavy[:OWN]]
    whole = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    # at most SHAPES rows; the own words among them are taken off again
    shapes = (counts.groupBy(shape_class_column(F.col("word")).alias("k"))
              .agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect())
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in shapes:
        n[r.k], v[r.k] = r.n, r.v
    for i, r in enumerate(heavy[:OWN]):
        k = shape_class(own[i])
        n[k] -= r.c
        v[k] -= 1
        n[i] = r.c
    n[END] = n_texts
    log_class = np.zeros(CLASSES)
    log_class[OWN + 1:] = np.log10(n[OWN + 1:] + v[OWN + 1:] + 1)
    return Vocabulary(
        index={bytes(r.word): i + 1 for i, r in enumerate(heavy)},
        log_count=np.array([0.0, *(log10(r.c + 1) for r in heavy)]),
        class_of=np.array([0, *(i if i < OWN else shape_class(bytes(r.word)) for i, r in enumerate(heavy))], "int16"),
        log_class=log_class,
        class_share=(n + 1) / (n.sum() + CLASSES),
        end_log=log10(n_texts + 1),
        tokens=int((whole.n or 0) + n_texts),
        types=int((whole.v or 0) + (1 if n_texts else 0)))


ENCODED = ("classes binary, n_tokens long, n_known long, base_log double, inner_log double, "
           "rare_word array<binary>, rare_times array<int>")


def encode(text: bytes, voc: Vocabulary) -> tuple:
    """An ENCODED row; the logs lack what the rare words add."""
    tokens = words(text)
    get = voc.index.get
    at = np.fromiter(map(get, tokens, repeat(0)), "int64", len(tokens))
    kinds = voc.class_of[at]
    rare_at = np.flatnonzero(at == 0).tolist()
    if rare_at:
        kinds[rare_at] = [shape_class(tokens[i]) for i in rare_at]
    rare = Counter(tokens[i] for i in rare_at)
    logs = voc.log_count[at]
    classes = np.append(kinds, END).astype("<i2")
    inner = float(logs[kinds > END].sum() - voc.log_class[classes].sum())
    base = float(logs.sum() + voc.end_log - (len(tokens) + 1) * voc.log_total)
    known = len(tokens) - len(rare_at) + (1 if voc.end_log > 0 else 0)
    return classes.tobytes(), len(tokens) + 1, known, base, inner, list(rare), list(rare.values())


def encode_documents(docs: DataFrame, voc: Vocabulary, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` (with ``text`` binary) and ENCODED."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(vars(voc).values()))     # plain values: no class of ours
    kept = [(c, docs.schema[c].dataType.simpleString()) for c in keep]
    docs = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
        names = [*keep, *(x.split()[0] for x in ENCODED.split(", "))]
        voc = Vocabulary(*shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                rows = [encode(t.as_py(), voc) for t in part.column(len(keep))]
                cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], *cols], names=names)

    return docs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kept) + ", " + ENCODED)


# -- the chain ----------------------------------------------------------------

@dataclass
class Chain:
    start: np.ndarray            # K
    move: np.ndarray             # K x K
    emit: np.ndarray             # CLASSES x K

    @staticmethod
    def initial(share: np.ndarray, states: int = STATES, seed: int = SEED) -> "Chain":
        noise = np.random.default_rng(seed).normal(0, 1.0, (len(share), states))
        emit = share[:, None] * np.exp(noise)
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
        even = np.full(states, 1 / states)
        return Chain(even, move, emit / emit.sum(axis=0))


def expected_counts(texts: list[np.ndarray], chain: Chain, group: int = GROUP) -> np.ndarray:
    """Baum-Welch counts of whole texts: start (K), moves (K x K) and emissions
    (CLASSES x K) in one vector."""
    k = len(chain.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((len(chain.emit), k))
    texts = [x for x in texts if len(x)]
    if not texts:
        return np.concatenate([starts, moves.ravel(), emits.ravel()])
    flat, at, active = ragged(texts)
    upto = np.concatenate([[0], np.cumsum(active)])
    # steps in parts of about ``group`` tokens (one step at least)
    cuts, t = [0], 0
    while t < len(active):
        t = max(t + 1, int(np.searchsorted(upto, upto[t] + group, "right")) - 1)
        cuts.append(min(t, len(active)))
    back, ones, emit = chain.move.T.copy(), np.ones(k), np.ascontiguousarray(chain.emit)

    def forward(first: int, last: int, a: np.ndarray | None, keep: bool):
        """alpha of the steps first .. last - 1 (all, or the last one alone)."""
        held, scales, classes = [], [], []
        for t in range(first, last):
            n = active[t]
            o = flat[at[:n] + t]
            a = np.broadcast_to(chain.start, (n, k)) if a is None else a[:n] @ chain.move
            a = a * emit.take(o, axis=0)
            s = 1 / (a @ ones)
            a *= s[:, None]
            if keep:
                held.append(a)
                scales.append(s)
                classes.append(o)
        return (held, scales, classes) if keep else a

    entry = [None]
    for first, last in zip(cuts[:-2], cuts[1:-1]):
        entry.append(forward(first, last, entry[-1], False))
    later = None                   # of the step after: emission x beta / scale
    for i in range(len(cuts) - 2, -1, -1):
        first, last = cuts[i], cuts[i + 1]
        held, scales, classes = forward(first, last, entry[i], True)
        for t in range(last - 1, first - 1, -1):
            alpha, n = held[t - first], active[t]
            beta = np.ones((n, k))
            if later is not None:
                beta[:len(later)] = later @ back
                moves += alpha[:len(later)].T @ later
            later = emit.take(classes[t - first], axis=0)
            later *= beta
            later *= scales[t - first][:, None]
            alpha *= beta
        if first == 0:
            starts += held[0].sum(axis=0)
        gamma, o = np.ascontiguousarray(np.concatenate(held).T), np.concatenate(classes)
        for j in range(k):
            emits[:, j] += np.bincount(o, gamma[j], len(emits))
    return np.concatenate([starts, (moves * chain.move).ravel(), emits.ravel()])


def reestimate(counts: np.ndarray, chain: Chain, share: np.ndarray) -> Chain:
    k = len(chain.start)
    start, moves = counts[:k] + 1, counts[k:k + k * k].reshape(k, k) + 1
    emit = counts[k + k * k:].reshape(-1, k)
    emit = emit + PRIOR * share[:, None]
    return Chain(start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train_chain(classes: DataFrame, share: np.ndarray, states: int = STATES, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over the one binary column (class numbers of whole texts)."""
    chain = Chain.initial(share, states)
    spark = classes.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(tuple(vars(chain).values()))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
            now = Chain(*shared.value)
            total = np.zeros(len(now.start) * (1 + len(now.start) + len(now.emit)))
            texts, held = [], 0

            def flush() -> None:
                nonlocal held
                total[:] += expected_counts(texts, now)
                texts.clear()
                held = 0

            for b in batches:
                for x in b.column(0):
                    texts.append(np.frombuffer(x.as_buffer(), "<i2"))
                    held += len(texts[-1])
                    if held >= TOGETHER:
                        flush()
            flush()
            yield total

        counts = sum_vectors(classes, count, len(chain.start) * (1 + len(chain.start) + len(chain.emit)))
        chain = reestimate(counts, chain, share)
        shared.unpersist()
    return chain


def ragged(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The texts longest first in one array, where each begins, and how many have a
    token t, for each t."""
    lengths = np.array([len(x) for x in texts])
    order = np.argsort(-lengths, kind="stable")
    at = np.cumsum(lengths[order]) - lengths[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max()), "left")
    return np.concatenate([texts[i] for i in order]), at, active.tolist()


def forward_log10(texts: list[np.ndarray], chain: Chain) -> np.ndarray:
    """Exact log10 probability of each class sequence, by the scaled forward
    recursion over all texts at once (longest first; shorter ones drop out)."""
    out = np.zeros(len(texts))
    if not texts:
        return out
    order = np.argsort([-len(x) for x in texts], kind="stable")
    flat, at, active = ragged(texts)
    total = np.zeros(len(texts))
    a = np.broadcast_to(chain.start, (len(texts), len(chain.start)))
    ones, emit = np.ones(len(chain.start)), np.ascontiguousarray(chain.emit)
    for t, n in enumerate(active):
        if t:
            a = a[:n] @ chain.move
        a = a[:n] * emit.take(flat[at[:n] + t], axis=0)
        s = a @ ones
        a /= s[:, None]
        total[:n] += np.log10(s)
    out[order] = total
    return out


def sequence_scores(rows: DataFrame, chain: Chain, key: str) -> DataFrame:
    """(key, chain_log): the forward recursion over ``classes`` of each row."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(vars(chain).values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain(*shared.value)
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), "<i2") for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(forward_log10(texts, chain))],
                                             names=[key, "chain_log"])

    return rows.select(key, "classes").mapInArrow(run, f"{key} long, chain_log double")


# -- the whole model ----------------------------------------------------------

def score_documents(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text",
                    states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, trained, n_tokens, n_known, train_tokens,
    base_score (log10, add-one unigram) and score (log10, the model).
    ``trainable`` is a condition on ``doc_id``."""
    bound_batches(docs.sparkSession)
    own = docs.select(col(id_col).alias("doc_id"), utf8(text_col).alias("text")).withColumn("trained", trainable)
    training = own.filter("trained")
    counts = materialize(word_counts(training.select("text")))
    voc = build_vocabulary(counts, training.select("doc_id").count())
    rows = materialize(encode_documents(own, voc, ["doc_id", "trained"])
                       .withColumn("row", F.monotonically_increasing_id()))   # fixed once stored
    chain = train_chain(rows.filter("trained").select("classes"), voc.class_share, states, rounds)
    # rare words: the part of the count table beyond the broadcast words
    least = counts.join(F.broadcast(_heavy_words(docs, voc)), "word", "left_anti")
    rare = rows.select("row", F.explode(F.arrays_zip("rare_word", "rare_times")).alias("r"))
    added = (rare.select("row", F.col("r.rare_word").alias("word"), F.col("r.rare_times").alias("times"))
             .join(least, "word").groupBy("row")
             .agg(F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("rare_log"), F.sum("times").alias("rare_known")))
    scored = sequence_scores(rows, chain, "row")
    return (rows.drop("classes", "rare_word", "rare_times").join(scored, "row").join(added, "row", "left")
            .select("doc_id", "trained", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                    F.lit(voc.tokens).cast("long").alias("train_tokens"),
                    (F.col("base_log") + F.coalesce("rare_log", F.lit(0.0))).alias("base_score"),
                    (F.col("chain_log") + F.col("inner_log") + F.coalesce("rare_log", F.lit(0.0))).alias("score")))


def _heavy_words(docs: DataFrame, voc: Vocabulary) -> DataFrame:
    """At most HEAVY rows."""
    return docs.sparkSession.createDataFrame([(bytearray(w),) for w in voc.index], "word binary")
