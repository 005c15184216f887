"""Benchmark decontamination: a broadcast hash set of normalised n-grams.

Words are runs of ``0-9``, ``a-z`` (after lower-casing A-Z) and non-ASCII
characters.  A window is ``n`` consecutive words of an item; an item of fewer
words, but not none, is one window of its own length.

The index holds one 64-bit hash per distinct window.  A task turns each text
into word numbers (0: a word no item has), hashes every window of the indexed
lengths at once with numpy, looks the hashes up in the sorted set and verifies
every hit word by word.  No shuffle: the texts stay where they were read.

The broadcast is bounded: an index takes at most some 40 times its items' UTF-8
bytes (mostly far less), and these must not exceed ``max_block_bytes``.  A larger
benchmark is cut into blocks of that size and
the documents pass one block after the other, each pass appending its hits to
the rows of the last one (stored in the shared folder); the result is the same.

Defined results: NULL text has no words and no hits; an empty benchmark hits
nothing; an item without words is in no document; repeated items and equal
texts under several ids each count; items without an id can hit but are not
listed; columns of the output's names in the input are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.llm.common import bound_batches, col, fresh, utf8
from txlens.session import materialize

N = 10
MAX_BLOCK_BYTES = 2 << 20
#: Byte table: A-Z to a-z, separators to blanks, the rest kept.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
             for b in range(256))
WORD = re.compile(rb"[^ ]+")


def hit_type(item: T.DataType) -> T.StructType:
    return (T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(item))
            .add("span_start", T.ArrayType(T.IntegerType())).add("span_end", T.ArrayType(T.IntegerType())))


def window_hash(words: list[np.ndarray], mult: int) -> np.ndarray:
    """Polynomial hash of windows given word by word."""
    out = np.zeros(len(words[0]), "uint64")
    for w in words:
        out = (out ^ w) * np.uint64(mult)
        out ^= out >> np.uint64(29)
    return out


class WindowIndex:
    """The windows of one block of benchmark items, in plain arrays.

    ``state`` is what is broadcast: the words' numbers, the items' ids, the hash
    multiplier and, per window length, the sorted hashes, the windows (word
    numbers) and the items of each as one array with offsets.
    """

    def __init__(self, state: tuple):
        self.word, self.ids, self.mult, self.by_size = state

    @staticmethod
    def build(items: list[tuple], n: int) -> tuple:
        """The state for (id, text) items.  Arrays take at most about 70 bytes a
        word of the block; a word has at least two bytes with its separator."""
        word: dict[bytes, int] = {}
        numbers = [np.array([word.setdefault(w, len(word) + 1) for w in text.translate(FOLD).split()], "uint32")
                   for _, text in items]
        lengths = np.array([len(x) for x in numbers], "int64")
        flat = np.concatenate([*numbers, np.zeros(0, "uint32")])
        first = np.cumsum(lengths) - lengths
        mult = 0x9E3779B97F4A7C15
        while True:  # a multiplier under which no two windows share a hash
            by_size = {}
            for size in sorted({min(n, k) for k in lengths.tolist() if k}):
                own = np.flatnonzero(lengths >= n if size == n else lengths == size)
                count = lengths[own] - size + 1
                owner = np.repeat(own, count)
                at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[owner]
                hashes = window_hash([flat[at + k].astype("uint64") for k in range(size)], mult)
                order = np.lexsort((owner, hashes))
                hashes, owner, at = hashes[order], owner[order], at[order]
                same = np.flatnonzero(hashes[1:] == hashes[:-1])
                if any((flat[at[same + 1] + k] != flat[at[same] + k]).any() for k in range(size)):
                    break
                new = np.append(True, hashes[1:] != hashes[:-1])
                listed = new | np.append(True, owner[1:] != owner[:-1])      # an item once per window
                heads = np.flatnonzero(new)
                by_size[size] = (hashes[heads], flat[at[heads][:, None] + np.arange(size)],
                                 np.append(np.cumsum(listed)[heads] - 1, listed.sum()).astype("int32"),
                                 owner[listed].astype("int32"))
            else:
                return word, [i for i, _ in items], mult, by_size
            mult = (mult * 6364136223846793005 + 1442695040888963407) % (1 << 64) | 1

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, size, item numbers) of each window that occurs in ``ids``."""
        known = ids != 0
        for size, (hashes, grams, offsets, items) in self.by_size.items():
            if len(ids) < size:
                continue
            run = np.concatenate([[0], np.cumsum(known)])
            at = np.flatnonzero(run[size:] - run[:-size] == size)
            if not len(at):
                continue
            h = window_hash([ids[at + k] for k in range(size)], self.mult)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in np.flatnonzero(hashes[place] == h):
                if np.array_equal(ids[at[i]:at[i] + size], grams[place[i]]):
                    yield int(at[i]), size, items[offsets[place[i]]:offsets[place[i] + 1]]

    def scan(self, texts: list[bytes]) -> list[tuple]:
        """Rows of ``hit_type``.  The texts' word numbers form one array, with an unknown
        word between texts so that no window crosses them."""
        ids, starts, get = [], [], self.word.get
        counts = []
        for t in texts:
            words = t.translate(FOLD).split()
            starts.append(len(ids))
            counts.append(len(words))
            ids += [get(w, 0) for w in words]
            ids.append(0)
        hits: dict[int, list] = {}
        if any(counts):
            for at, size, items in self.find(np.array(ids, "uint64")):
                doc = int(np.searchsorted(starts, at, "right")) - 1
                hits.setdefault(doc, []).append((at - starts[doc], size, items))
        out = []
        for d, t in enumerate(texts):
            if d not in hits:
                out.append((counts[d], 0, [], [], []))
                continue
            hit = np.zeros(counts[d] + 2, "int8")
            found: set = set()
            for at, size, items in hits[d]:
                hit[at + 1:at + size + 1] = 1
                found.update(items.tolist())
            edge = np.diff(hit)
            spans = [m.span() for m in WORD.finditer(t.translate(FOLD))]
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            out.append((counts[d], int(hit.sum()), sorted({self.ids[x] for x in found} - {None}),
                        [spans[i][0] for i in first], [spans[i][1] for i in last]))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, max_bytes: int) -> list[DataFrame]:
    """The items in blocks of at most ``max_bytes`` (or one item) each."""
    items = benchmark.select(col(item_col).alias("item"), utf8(text_col).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total <= max_bytes:
        return [items]
    # Equal (item, text) rows are one window set; ids are hashed too, so copies of a text spread over the parts.
    half, size = max(1, max_bytes // 2), F.octet_length("text")
    place = F.xxhash64("text", "item", F.col("item").isNull())
    parted = (items.distinct().withColumn("part", F.pmod(place, F.lit(-(-4 * total // max_bytes))))
              .withColumn("large", size > half))
    order = Window.partitionBy("part", "large").orderBy(place, "item", "text")
    running = F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # a unit is one item above half a block, or a run of smaller ones: at most max_bytes
    unit = F.when(F.col("large"), -F.row_number().over(order)).otherwise(F.floor((running - 1) / half))
    stored = materialize(parted.withColumn("unit", F.concat_ws(":", "part", unit.cast("string"))))
    units = stored.groupBy("unit").agg(F.sum(size).alias("bytes")).orderBy("unit").collect()  # about four a block
    blocks, filled = [], 0
    for r in units:
        if not blocks or filled + r.bytes > max_bytes:
            blocks.append([])
            filled = 0
        blocks[-1].append(r.unit)
        filled += r.bytes
    return [stored.filter(F.col("unit").isin(b)).select("item", "text") for b in blocks]


def _scanner(block: DataFrame, n: int):
    """Pandas UDF that scans texts for the windows of a block (collected: it is
    bounded).  Only plain arrays are broadcast: the class travels with the UDF."""
    state = WindowIndex.build([(r.item, bytes(r.text)) for r in block.collect()], n)
    shared = block.sparkSession.sparkContext.broadcast(state)

    @F.pandas_udf(hit_type(block.schema["item"].dataType))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["n_words", "n_hit", "items", "span_start", "span_end"]
        index = WindowIndex(shared.value)
        for texts in batches:
            yield pd.DataFrame(index.scan([bytes(t) for t in texts]), columns=names)
    return scan


def _merger(item: T.DataType):
    """Pandas UDF: hits of two blocks on the same text, the union of their spans and items."""
    @F.pandas_udf(hit_type(item))
    def merge(text: pd.Series, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, x, y in zip(text, a.itertuples(index=False), b.itertuples(index=False)):
            spans = [m.span() for m in WORD.finditer(bytes(t).translate(FOLD))]
            cover = sorted([*zip(x.span_start, x.span_end), *zip(y.span_start, y.span_end)])
            hit = np.zeros(len(spans) + 2, "int8")
            for i, (s, e) in enumerate(spans):
                hit[i + 1] = any(p <= s and e <= q for p, q in cover)
            edge = np.diff(hit)
            first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
            out.append((x.n_words, int(hit.sum()), sorted({*x.items, *y.items}),
                        [spans[i][0] for i in first], [spans[i][1] for i in last]))
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "span_start", "span_end"])
    return merge


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", n: int = N, max_block_bytes: int = MAX_BLOCK_BYTES,
               into: str = "leak") -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items (ascending
    ids) and the hit spans as byte offsets into the UTF-8 text."""
    bound_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_col, item_text_col, max_block_bytes)
    out = docs.withColumn(into, _scanner(blocks[0], n)(utf8(text_col)))
    for block in blocks[1:]:
        more = fresh(out, "leak")
        out = materialize(out).withColumn(more, _scanner(block, n)(utf8(text_col)))
        merge = _merger(block.schema["item"].dataType)
        out = materialize(out).withColumn(into, merge(utf8(text_col), col(into), F.col(more))).drop(more)
    return out


def remove_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit."""
    leak = fresh(docs, "leak")
    return find_leaks(docs, benchmark, into=leak, **options).filter(F.col(f"{leak}.n_hit") == 0).drop(leak)


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    out = []
    for t, a, b in zip(text, start, end):
        t, edges = bytes(t), [0, *(x for p in zip(a, b) for x in p)]
        out.append(b"".join(t[i:j] for i, j in zip(edges[::2], [*edges[1::2], len(t)])).decode("utf-8", "replace"))
    return pd.Series(out)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents with every hit span cut out of the text; texts without a
    hit are unchanged."""
    leak = fresh(docs, "leak")
    found = find_leaks(docs, benchmark, text_col=text_col, into=leak, **options)
    text = F.when(F.col(f"{leak}.n_hit") > 0,
                  _cut(utf8(text_col), F.col(f"{leak}.span_start"), F.col(f"{leak}.span_end"))
                  ).otherwise(col(text_col))
    return found.withColumn(text_col, text).drop(leak)
