"""Ranked lexical search: exact top k of every query by the Best Position Algorithm.

Terms are runs of ``0-9``, ``a-z`` (after lower-casing A-Z) and non-ASCII
characters.  A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))); a
document of n terms has m = 75 + (25 n N div L) and scores, per query term
(repeats included), w * (10^9 tf div (1000 tf + 12 m)).  N, L and df are counted
over all documents.

The documents stay where they are read.  One pass turns the texts of a task into
index blocks (postings of the query terms only, stored in the shared folder),
whose counts add up to N, L and df.  A second pass searches each block: every
term has an impact list, its documents by descending score share.

* Sorted access reads all lists of a query in step, ever more positions a round.
* Each document met is looked up in every list (direct access), which gives its
  whole score and its position there; those positions count as seen too.
* A list's best position is the last one before which every position was seen.
  No unseen document can stand before it, so the sum of the impacts at the best
  positions bounds every unseen document -- more tightly than the last positions
  read, as direct accesses push the best positions beyond them.
* The search ends when that bound is strictly below the k-th best score so far
  (equal scores go by document id, so a tie must still be looked at), or zero.

A task keeps its k best per query from block to block, so later blocks stop
early.  Tasks hand over at most k rows per query; these meet in two steps.

The query terms are sent to every task; queries of more than ``max_block_bytes``
of text are served in blocks, one pass each.

Defined results: NULL text has no terms and does not count for N; queries without
terms have no result; equal query rows are one query, rows of one item id with
different texts are ranked each by itself; repeated documents are ranked one by
one; a NULL document id comes last among equal scores; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txlens.llm.common import bound_batches, col, sum_vectors, utf8
from txlens.llm.decontaminate import FOLD, MAX_BLOCK_BYTES, _blocks
from txlens.session import materialize

K = 20
BLOCK_DOCUMENTS = 16_384
BLOCK_POSTINGS = 2_000_000
FIRST_READ = 32
MERGE_PARTS = 64


# -- queries ------------------------------------------------------------------

def query_terms(texts: list[bytes]) -> tuple[dict[bytes, int], list[tuple[list[int], list[int]]]]:
    """Numbers of all terms, and each query's term numbers with their repeats."""
    number: dict[bytes, int] = {}
    queries = []
    for t in texts:
        found = Counter(number.setdefault(w, len(number)) for w in t.translate(FOLD).split())
        queries.append((list(found), list(found.values())))
    return number, queries


# -- index blocks -------------------------------------------------------------

def index_blocks(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """One row per block: ids (ascending, NULLs last), n, and the postings by
    (term, document): term numbers, documents (places in ids), tf."""
    spark = docs.sparkSession
    own = docs.select(col(id_col).alias("id"), utf8(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        size = len(number)
        ids, lengths, postings, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            every = pa.concat_arrays(ids)
            order = pc.sort_indices(every, null_placement="at_end").to_numpy()
            place = np.empty(len(order), "int64")
            place[order] = np.arange(len(order))
            doc, term, tf = (np.concatenate(x) for x in zip(*postings))
            doc = place[doc]
            by = np.lexsort((doc, term))
            parts = [np.concatenate(lengths)[order], term[by], doc[by], tf[by]]
            out = [pa.array([every.take(pa.array(order)).to_pylist()], pa.list_(every.type))]
            out += [pa.array([x.astype("<i4").tobytes()], pa.binary()) for x in parts]
            ids.clear(), lengths.clear(), postings.clear()
            return pa.RecordBatch.from_arrays(out, names=["ids", "n", "term", "doc", "tf"])

        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                words = [t.as_py().translate(FOLD).split() for t in part.column(1)]
                count = np.fromiter(map(len, words), "int64", len(words))
                get = number.get
                at = np.fromiter((get(w, size) for ws in words for w in ws), "int64", int(count.sum()))
                key = np.repeat(np.arange(len(words)), count) * (size + 1) + at
                key, tf = np.unique(key[at < size], return_counts=True)
                before = sum(map(len, ids))
                ids.append(part.column(0))
                lengths.append(count)
                postings.append((key // (size + 1) + before, key % (size + 1), tf))
                held += len(key)
                if held >= BLOCK_POSTINGS or before + len(words) >= BLOCK_DOCUMENTS:
                    yield block()
                    held = 0
        if ids:
            yield block()

    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(run, f"ids array<{kind}>, n binary, term binary, doc binary, tf binary")


def collection_counts(blocks: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        total = np.zeros(2 + terms)
        for b in batches:
            for n, term in zip(b.column(0), b.column(1)):
                n = np.frombuffer(n.as_buffer(), "<i4")
                total[0] += (n > 0).sum()
                total[1] += n.sum(dtype="int64")
                total[2:] += np.bincount(np.frombuffer(term.as_buffer(), "<i4"), minlength=terms)
        yield total

    sums = sum_vectors(blocks.select("n", "term"), count, 2 + terms).astype("int64")
    return int(sums[0]), int(sums[1]), sums[2:]


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], "int64")


class ImpactLists:
    """The impact lists of a block; ``lists[term]`` is the slice of a term."""

    def __init__(self, n: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, weight: np.ndarray,
                 n_docs: int, n_terms: int):
        self.size = len(n)
        scaled = n.astype("int64") if 25 * int(n.max(initial=0)) * n_docs < 1 << 63 else n.astype(object)
        m = (75 + 25 * scaled * n_docs // max(1, n_terms)).astype("int64")
        tf = tf.astype("int64")
        self.doc = doc                                                     # by document
        self.impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -self.impact, term))
        self.ranked_doc, self.ranked_impact = doc[order], self.impact[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))
        last = np.append(first[1:], len(term))
        self.lists = {int(term[a]): slice(int(a), int(b)) for a, b in zip(first, last) if self.impact[a:b].any()}
        # position of each posting in its impact list
        self.position = np.empty(len(order), "int64")
        self.position[order] = np.arange(len(order)) - np.repeat(first, last - first)


def best_positions(block: ImpactLists, terms: list[int], repeats: list[int], k: int, kth: int,
                   first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores) that contain the block's k best with a score above 0
    and of at least ``kth``, the k-th best score known from elsewhere (0: none);
    and how many documents were met."""
    lists = []
    for t, r in zip(terms, repeats):
        s = block.lists.get(t)
        if s is not None:
            lists.append((block.ranked_doc[s], block.ranked_impact[s] * r, block.doc[s], block.impact[s] * r,
                          block.position[s], np.zeros(s.stop - s.start, bool)))
    best = [0] * len(lists)            # positions seen without a gap
    met = np.zeros(block.size, bool)
    docs, scores = np.zeros(0, "int64"), np.zeros(0, "int64")
    read, step = 0, first_read
    while lists:
        new = np.unique(np.concatenate([x[0][read:read + step] for x in lists]))
        new = new[~met[new]]
        met[new] = True
        total = np.zeros(len(new), "int64")
        for _, _, doc, impact, position, seen in lists:
            at = np.minimum(np.searchsorted(doc, new), len(doc) - 1)
            here = np.flatnonzero(doc[at] == new)
            total[here] += impact[at[here]]
            seen[position[at[here]]] = True
        read, step = read + step, 2 * step
        good = (total >= kth) & (total > 0)
        docs, scores = np.concatenate([docs, new[good]]), np.concatenate([scores, total[good]])
        order = np.lexsort((docs, -scores))[:k]
        docs, scores = docs[order], scores[order]
        if len(scores) == k:
            kth = max(kth, int(scores[-1]))
        bound = 0
        for i, (_, impact, _, _, _, seen) in enumerate(lists):
            rest = seen[best[i]:]
            if len(rest):
                gap = int(rest.argmin())
                best[i] += len(rest) if rest[gap] else gap
            if best[i] < len(seen):
                bound += int(impact[best[i] - 1])
        if bound < kth or bound == 0:
            break
    return docs, scores, int(met.sum())


def search_blocks(blocks: DataFrame, queries: list, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): at most k rows per query and task."""
    kind = blocks.schema["ids"].dataType.elementType
    shared = blocks.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        top: list[list[tuple]] = [[] for _ in queries]
        arrow = None
        for b in batches:
            arrow = b.column(0).type.value_type
            for row in range(b.num_rows):
                ids = b.column(0)[row].values
                lists = ImpactLists(*(np.frombuffer(b.column(c)[row].as_buffer(), "<i4") for c in range(1, 5)),
                                    weight, n_docs, n_terms)
                for q, (terms, repeats) in enumerate(queries):
                    kth = top[q][-1][0] if len(top[q]) == k else 0
                    docs, scores, _ = best_positions(lists, terms, repeats, k, kth)
                    if len(docs):
                        found = zip(scores.tolist(), ids.take(pa.array(docs)).to_pylist())
                        top[q] = sorted([*top[q], *found], key=lambda x: (-x[0], x[1] is None, *x[1:2 if x[1] is not None else 1]))[:k]
        rows = [(q, d, s) for q, found in enumerate(top) for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], arrow),
                 pa.array([r[2] for r in rows], pa.int64())], names=["query", "doc_id", "score"])

    return blocks.mapInArrow(run, f"query int, doc_id {kind.simpleString()}, score long")


# -- the operator -------------------------------------------------------------

def search(docs: DataFrame, queries: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", max_block_bytes: int = MAX_BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of each query."""
    spark = docs.sparkSession
    bound_batches(spark)
    wanted = queries.select(col(item_col).alias("item_id"), col(item_text_col).alias("text")).distinct()
    out = None
    for block in _blocks(wanted, "item_id", "text", max_block_bytes):
        items = block.collect()                                      # at most ``max_block_bytes`` of text
        number, terms = query_terms([bytes(r.text) for r in items])
        blocks = materialize(index_blocks(docs, number, id_col, text_col))
        n_docs, n_terms, df = collection_counts(blocks, len(number))
        weight = term_weights(n_docs, df)
        # a list of weight 0 adds to no score
        terms = [([t for t in ts if weight[t]], [r for t, r in zip(ts, rs) if weight[t]]) for ts, rs in terms]
        found = search_blocks(blocks, terms, weight, n_docs, n_terms, k).withColumn(
            "part", F.spark_partition_id() % MERGE_PARTS)
        best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        for keys in (["query", "part"], ["query"]):
            found = (found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))
                     .filter(F.col("rank") <= k))
        names = spark.createDataFrame([(i, r.item) for i, r in enumerate(items)], f"query int, item_id {block.schema['item'].dataType.simpleString()}")
        ranked = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.unionByName(ranked)
    return out
