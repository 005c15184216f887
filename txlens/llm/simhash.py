"""SimHash near-duplicates by a Gray-order hierarchical index.

A text's fingerprint has bit i set if over half of its 4-word shingles have bit
i set in their 64-bit hash.  Two fingerprints link at ``max_distance`` or fewer
differing bits; documents form the connected components of the links.

**Top of the index: routes.**  The 64 bits are cut into m segments; linked
fingerprints agree in at least m - ``max_distance`` of them.  So each distinct
fingerprint goes, once per choice of that many segments, to the bucket of their
bits: an upper node with those bits as its mask.  m grows with the table (5 at
distance 4 up to 8 million fingerprints: 5 routes of 12 bits; then 15 of 20, up to
2 billion; then 35 of 27), so the mean bucket stays below ``MEAN_BUCKET``.  A
bucket of more than ``MIN_CELL`` (near-copies agree almost everywhere) is cut into
p pieces and becomes the p(p+1)/2 cells of piece pairs: no cell is larger than two
pieces, whatever the table.

**Inside a cell** (``gray_links``): fingerprints sorted by Gray rank, in groups
of ``FANOUT`` up to one root.  A node keeps the bits all its members share (mask
and value).  Two nodes are compared by the bits both share that their parents
did not; the differences add up on the way down.  A pair above the distance is
pruned with all below it, a pair that cannot exceed it is linked whole, and a
pair already in one component is skipped.  A task therefore emits at most one
link per member (to its component's smallest fingerprint), never all pairs.

**Components** are joined over all cells by alternating large-star/small-star
rounds on the links; the values of hubs, nodes and classes of very many rows, are
broadcast (at most 65,536 of them).  Only counters reach the driver; the
fingerprints stay distributed.

Defined results: NULL text counts as empty; texts without words have
fingerprint 0 and link like any other; rows that repeat an id are rows of
their own; a component of NULL ids only has a NULL id; an empty table gives an
empty result; other columns pass through ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.llm.common import bound_batches, col, fresh, row_hash, utf8
from txlens.session import materialize

SHINGLE = 4
MAX_DISTANCE = 4
HASH_SEED = 42
BITS = 64
FANOUT = 8
MEAN_BUCKET = 2_048         # of random fingerprints; beyond, the routes' keys get longer
MIN_CELL = 16_384           # a bucket above this is cut
MAX_LISTED = 1 << 20        # large buckets in a broadcast (24 bytes each)
SALTS = 256
HUB = 1 << 16               # rows of a node or class above which its value is broadcast
EXPAND = 1 << 21            # node pairs expanded at once
CHUNK = 1 << 19             # rows of whole cells indexed at once

#: Bits of each byte value.
BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype("int64")


# -- fingerprints -------------------------------------------------------------

def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    words = text.lower().split()          # bytes: A-Z and ASCII blanks only
    if not words:
        return []
    h, seed = xxhash.xxh64_intdigest, HASH_SEED
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    if len(words) <= shingle:
        return [h(joined, seed)]
    return [h(joined[a:b - 1], seed) for a, b in zip(starts, starts[shingle:])]


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """uint64 fingerprint of each text.  Set bits are counted for groups of
    texts at once, from histograms of the hashes' bytes."""
    out = np.zeros(len(texts), "uint64")
    group: list[list[int]] = []

    def close(end: int) -> None:
        n = np.array([len(g) for g in group])
        flat = np.fromiter((x for g in group for x in g), "uint64", int(n.sum()))
        octets = flat.astype("<u8").view("uint8").reshape(-1, 8)
        doc = np.repeat(np.arange(len(group)) * 256, n)
        for k in range(8):
            seen = np.bincount(doc + octets[:, k], minlength=len(group) * 256).reshape(-1, 256)
            bits = (2 * (seen @ BYTE_BITS) > n[:, None]) @ (1 << np.arange(8))
            out[end - len(group):end] |= bits.astype("uint64") << np.uint64(8 * k)
        group.clear()

    size = 0
    for i, t in enumerate(texts):
        group.append(shingle_hashes(t, shingle))
        size += len(group[-1])
        if len(group) == 256 or size > 200_000:
            close(i + 1)
            size = 0
    if group:
        close(len(texts))
    return out


def fingerprint_udf(shingle: int = SHINGLE):
    """The fingerprint as a (signed) long."""
    @F.pandas_udf(T.LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(fingerprints([bytes(t) for t in texts], shingle).view("int64"))
    return of


# -- the index inside a cell --------------------------------------------------

def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype("int16")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order: the prefix XOR of its bits."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class Forest:
    """Component labels (the smallest position of each component)."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.version = 0

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[u], label[v]
            apart = a != b
            if not apart.any():
                break
            u, v, a, b = u[apart], v[apart], a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = label[label]
                if np.array_equal(up, label):
                    break
                label = up
            self.version += 1
        self.label = label


class GrayIndex:
    """Levels of nodes over fingerprints sorted by (cell, Gray rank)."""

    def __init__(self, sizes: np.ndarray, codes: np.ndarray):
        self.common = [np.full(len(codes), ~np.uint64(0))]     # mask of shared bits
        self.value = [codes]
        self.first: list[np.ndarray] = [np.arange(len(codes))]  # first child
        self.count: list[np.ndarray] = [np.zeros(len(codes), "int64")]
        self.item: list[np.ndarray] = [np.arange(len(codes))]   # first member
        self.items: list[np.ndarray] = [np.ones(len(codes), "int64")]
        ors = codes
        while True:
            above = -(-sizes // FANOUT)
            nth = np.arange(above.sum()) - np.repeat(np.cumsum(above) - above, above)
            start = np.repeat(np.cumsum(sizes) - sizes, above) + nth * FANOUT
            self.first.append(start)
            self.count.append(np.minimum(FANOUT, np.repeat(sizes, above) - nth * FANOUT))
            ands = np.bitwise_and.reduceat(self.value[-1], start)
            ors = np.bitwise_or.reduceat(ors, start)
            self.common.append(~(ands ^ ors))
            self.value.append(ands)
            self.item.append(self.item[-1][start])
            self.items.append(np.add.reduceat(self.items[-1], start))
            sizes = above
            if sizes.max() <= 1:
                return


def gray_links(cells: np.ndarray, codes: np.ndarray, max_distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Positions (member, smallest member of its component) that connect the
    codes of each cell; codes of one cell are distinct."""
    if len(codes) < 2:
        return np.zeros(0, "int64"), np.zeros(0, "int64")
    order = np.lexsort((gray_rank(codes), cells))
    cells, codes = cells[order], codes[order]
    edge = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
    index = GrayIndex(np.diff(np.r_[edge, len(codes)]), codes)
    forest = Forest(len(codes))
    top = len(index.first) - 1
    roots = np.flatnonzero(index.items[top] > 1)
    shared = index.common[top][roots]
    stack = [(top, roots, roots, np.zeros(len(roots), "int16"), shared)]
    spread: dict[int, tuple[int, np.ndarray]] = {}

    def whole(level: int) -> np.ndarray:
        """The label of nodes that lie in one component, else -1."""
        at = spread.get(level)
        if at is None or at[0] != forest.version:
            lo = np.minimum.reduceat(forest.label, index.item[level])
            hi = np.maximum.reduceat(forest.label, index.item[level])
            at = spread[level] = (forest.version, np.where(lo == hi, lo, -1))
        return at[1]

    while stack:
        level, a, b, acc, known = stack.pop()
        n = index.count[level][a] * index.count[level][b]
        if len(a) > 1 and n.sum() > EXPAND:
            half = len(a) // 2
            stack += [(level, a[s], b[s], acc[s], known[s]) for s in (slice(half, None), slice(0, half))]
            continue
        pair = np.repeat(np.arange(len(a)), n)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        width = index.count[level][b][pair]
        x, y = index.first[level][a][pair] + k // width, index.first[level][b][pair] + k % width
        below = level - 1
        keep = x < y if below == 0 else x <= y
        x, y, pair = x[keep], y[keep], pair[keep]
        both = index.common[below][x] & index.common[below][y]
        acc = acc[pair] + popcount((index.value[below][x] ^ index.value[below][y]) & both & ~known[pair])
        near = acc <= max_distance
        if below == 0:
            forest.link(x[near], y[near])
            continue
        one = whole(below)
        near &= ~((one[x] >= 0) & (one[x] == one[y]))
        sure = near & (acc + popcount(~both) <= max_distance)
        if sure.any():
            for side in (x[sure], y[sure]):
                n = index.items[below][side]
                member = np.repeat(index.item[below][side], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                forest.link(np.repeat(index.item[below][x[sure]], n), member)
        near &= ~sure
        if near.any():
            stack.append((below, x[near], y[near], acc[near], both[near]))
    by_label = np.lexsort((codes, forest.label))
    head = np.flatnonzero(np.r_[True, np.diff(forest.label[by_label]) != 0])
    least = np.empty(len(codes), "int64")
    least[by_label] = np.repeat(by_label[head], np.diff(np.r_[head, len(codes)]))
    far = np.flatnonzero(least != np.arange(len(codes)))
    return order[far], order[least[far]]


# -- links of all fingerprints ------------------------------------------------

def routes(max_distance: int, total: int) -> list[int]:
    """Masks of bits, such that fingerprints within the distance agree in all bits
    of at least one mask.  Of m segments they differ in at most ``max_distance``, so
    they agree in some m - ``max_distance`` of them: m is the smallest number for
    which ``total`` random fingerprints make buckets of at most ``MEAN_BUCKET``."""
    m = max_distance + 1
    while True:
        cut = [BITS * i // m for i in range(m + 1)]
        masks = [sum((1 << cut[i + 1]) - (1 << cut[i]) for i in chosen)
                 for chosen in combinations(range(m), m - max_distance)]
        if m == BITS or total >> min(x.bit_count() for x in masks) <= MEAN_BUCKET:
            return masks
        m += 1


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def _pieces(routed: DataFrame, rows: int) -> DataFrame:
    """``routed`` with ``p``, the number of pieces of its bucket.  The list of large
    buckets is broadcast up to ``MAX_LISTED`` of them; beyond, it is joined by
    shuffle, the buckets' rows spread by a salt."""
    bucket = ["route", "key"]
    large = (routed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MIN_CELL)
             .select(*bucket, F.ceil(F.col("n") / MIN_CELL).cast("long").alias("p")))
    if rows // MIN_CELL > MAX_LISTED:          # there may be so many
        large = materialize(large)
    if rows // MIN_CELL > MAX_LISTED and large.count() > MAX_LISTED:
        salts = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = (routed.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)).cast("int"))
                  .join(salts, [*bucket, "salt"], "left").drop("salt"))
    else:
        joined = routed.join(F.broadcast(large), bucket, "left")
    return joined.withColumn("p", F.coalesce("p", F.lit(1).cast("long")))


def links(fps: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) links that connect every component of the distinct ``fp``."""
    total = fps.count()
    masks = routes(max_distance, total)
    routed = fps.select(F.col("fp").alias("code"), F.inline(F.array(*[
        F.struct(F.lit(r).alias("route"), F.col("fp").bitwiseAND(F.lit(_signed(x)).cast("long")).alias("key"))
        for r, x in enumerate(masks)])))
    celled = (_pieces(routed, total * len(masks)).withColumn("i", F.pmod(F.xxhash64("code"), F.col("p")))
              .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
              .select("route", "key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "code"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def solve(table: list[np.ndarray]) -> pa.RecordBatch:
            cell, code = table
            ends = gray_links(cell, code.view("uint64"), max_distance)
            return pa.RecordBatch.from_arrays([pa.array(code[e]) for e in ends], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            rows += batch.num_rows
            if rows < CHUNK:
                continue
            table = [np.concatenate(x) for x in zip(*held)]
            last = int(np.searchsorted(table[0], table[0][-1], "left"))
            if last:
                yield solve([x[:last] for x in table])
            held, rows = [[x[last:] for x in table]], len(table[0]) - last
        if held:
            yield solve([np.concatenate(x) for x in zip(*held)])

    # cells that share a number by chance are searched as one: every link is checked
    return (celled.select(F.xxhash64("route", "key", "i", "j").alias("cell"), "code")
            .repartition("cell").sortWithinPartitions("cell")
            .mapInArrow(search, "a long, b long"))


# -- components ---------------------------------------------------------------

def _with_value(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) left joined with ``values``, one row a key.  Keys
    of more than max(``HUB``, total / 65,536) rows are few and go by broadcast, so no
    task of the shuffle gets all rows of a hub."""
    hubs = F.broadcast(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(HUB, total >> 16))
                       .drop("n").join(values, key, "left"))
    return (rows.join(hubs, key)
            .unionByName(rows.join(hubs.select(key), key, "left_anti").join(values, key, "left")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): alternating large-star and
    small-star rounds until nothing changes.  Every step is a join or an aggregate
    by node; a hub's neighbours are only ever reduced to a minimum."""
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialize(edges.filter("a != b").select(a, b).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        # large star: larger neighbours of a node move to its smallest neighbour
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
        large = materialize(_with_value(edges, least, "b", before[0])
                            .select("a", F.coalesce("m", "b").alias("b")).distinct())
        # small star: smaller neighbours of a node and the node move to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = materialize(small)
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node")).distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(roots.select("node", F.col("node").alias("root"))))


def near_classes(rows: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(fp, root, component_id) for every distinct fingerprint of ``rows``
    (doc_id, fp): component_id is the smallest id of its component."""
    known = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    linked = components(links(known.select("fp"), max_distance))
    rooted = (known.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
              .withColumn("root", F.coalesce("root", "fp")))
    rooted = materialize(rooted)
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return _with_value(rooted, least, "root", rooted.count()).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (the fingerprint as a long), root (a
    fingerprint that names the class) and component_id."""
    bound_batches(docs.sparkSession)
    rows = materialize(docs.select(col(id_col).alias("doc_id"), fingerprint_udf(shingle)(utf8(text_col)).alias("fp")))
    return rows.join(near_classes(rows, max_distance), "fp")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row with the
    smallest id (then the smallest row hash); of equal rows one."""
    bound_batches(docs.sparkSession)
    h1, h2, n = fresh(docs, "hash_a"), fresh(docs, "hash_b"), fresh(docs, "copies")
    hashed = docs.select("*", row_hash(docs).alias(h1), F.xxhash64(F.lit(1), row_hash(docs), utf8(text_col)).alias(h2))
    rows = materialize(hashed.select(col(id_col).alias("doc_id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"),
                                     fingerprint_udf(shingle)(utf8(text_col)).alias("fp")))
    classes = near_classes(rows, max_distance)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2")
    # per fingerprint first, so that a hot fingerprint or class meets partial minima only
    by_fp = rows.groupBy("fp").agg(F.min(order).alias("best"))
    best = by_fp.join(classes.select("fp", "root"), "fp").groupBy("root").agg(F.min("best").alias("best"))
    copies = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    keep = materialize(best.select("best.h1", "best.h2").join(copies, ["h1", "h2"])
                       .select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col("n").alias(n)))
    alone = hashed.join(keep.filter(F.col(n) == 1).drop(n), [h1, h2], "left_semi")
    repeated = hashed.join(keep.filter(F.col(n) > 1).drop(n), [h1, h2], "left_semi").dropDuplicates([h1, h2])
    return alone.unionByName(repeated).drop(h1, h2)
