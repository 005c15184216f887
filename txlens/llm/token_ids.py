"""Token ids as binary files with Elias-Fano document boundaries.

``write_ids`` encodes whole texts with a public tokenizer, appends the end id to
each and writes one long id array, in ascending document order, as segment
files; ``read_ids`` reads such files back.

Every segment is a file of its own (little-endian, one closing byte ``\\n``)::

    magic      8 bytes
    header     8 longs: id bytes (2 or 4), segment, ids, documents, documents
               without an id, smallest document id, 0, 0
    ends       Elias-Fano: where each document ends in the segment's ids
    documents  Elias-Fano: ids of the documents less the smallest one
    ids        unsigned ids, documents one after the other

and has a small file beside it with its number and the number of its ids, from
which a reader knows how many ids lie before each segment.

Elias-Fano of n ascending numbers below u: the lowest l = log2(u / n) bits of
each are packed, the higher parts stand in a bit vector as a one at place
``high + i``: about 2 + l bits a number.  ``select`` finds the i-th one from a
32-bit sample of every 64th one, so a document's place is found without a table
of 64-bit offsets, straight from the mapped file.

How it runs: (1) order only (id, hash of the text, bytes): ranges of documents,
their running sizes, and a cut wherever a segment is full; (2) tokenise where the
texts are read, send each document's ids to its segment, sort there, write.  Equal
rows may change places, so a segment border may lie among them: they are dealt
over the segments that hold them.  A segment is the most a task holds.  The cuts
(17 bytes a segment, at most ``MAX_SEGMENTS`` of them: beyond that segments become
larger) are broadcast.

Tokenising: the vocabularies used here normalise, drop white space and merge only
inside a pre-token.  A pre-token that the worker process met before (bounded) is
looked up, others go to the library's merges.  Where a run between ASCII blanks
holds characters from U+0250 on or what looks like an added token, the library
gets the whole run.  ``pre_token_wise`` checks a tokenizer for all that; others get
whole texts.

Defined results: NULL text counts as empty (the end id alone); rows that repeat
an id are documents of their own, one after the other; rows without an id come
first; an empty table writes no segment.  ``doc_id`` must be a whole number.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txlens.llm.common import bound_batches, col, text_or_empty
from txlens.session import materialize

MAGIC, COUNT = b"TXIDS1\x00\n", b"TXIDN1\x00\n"
SEGMENT_BYTES = 16 << 20        # of text
MAX_SEGMENTS = 1 << 19
SAMPLE = 64
KNOWN = 400_000         # beyond that a worker forgets what it met


# -- Elias-Fano ---------------------------------------------------------------

class EliasFano:
    """Ascending numbers from 0 in a buffer; nothing is unpacked until asked for."""

    def __init__(self, data, at: int = 0):
        self.n, self.low_bits, low, high, samples = struct.unpack_from("<5q", data, at)
        at += 40
        self.low = np.frombuffer(data, "u1", low, at)
        self.high = np.frombuffer(data, "u1", high, at + low)
        self.samples = np.frombuffer(data, "<u4", samples, at + low + high)
        self.end = at + low + high + (4 * samples + 7) // 8 * 8

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        values = np.asarray(values, "uint64")
        n = len(values)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        upper = (values >> np.uint64(bits)).astype("int64")
        place = upper + np.arange(n)
        ones = np.zeros(int(place[-1]) + 1 if n else 0, "u1")
        ones[place] = 1
        low = np.zeros(0, "u1")
        if bits:
            digits = np.empty((n, bits), "u1")
            for k in range(bits):
                digits[:, k] = (values >> np.uint64(k)) & np.uint64(1)
            low = np.packbits(digits, bitorder="little")
        high = np.packbits(ones, bitorder="little")
        parts = [np.pad(x, (0, -len(x) % 8)).tobytes() for x in (low, high)]
        samples = place[::SAMPLE].astype("<u4").tobytes()
        return (struct.pack("<5q", n, bits, len(parts[0]), len(parts[1]), len(samples) // 4) + parts[0] + parts[1]
                + samples + b"\0" * (-len(samples) % 8))

    def select(self, i: int) -> int:
        """Place of the i-th one in the upper bits."""
        first = int(self.samples[i // SAMPLE])
        need, byte = i % SAMPLE, first // 8
        seen = -int(np.unpackbits(self.high[byte:byte + 1], bitorder="little")[:first % 8].sum())
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte:byte + 64], bitorder="little"))
            if seen + len(ones) > need:
                return byte * 8 + int(ones[need - seen])
            seen += len(ones)
            byte += 64

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        bit = i * self.low_bits
        word = int.from_bytes(self.low[bit // 8:bit // 8 + 9].tobytes(), "little") >> bit % 8
        return (self.select(i) - i << self.low_bits) | word & ((1 << self.low_bits) - 1)

    def before(self, value: int) -> int:
        """How many of the numbers are at most ``value``."""
        a, b = 0, self.n
        while a < b:
            m = (a + b) // 2
            if self[m] <= value:
                a = m + 1
            else:
                b = m
        return a

    def all(self) -> np.ndarray:
        upper = np.flatnonzero(np.unpackbits(self.high, bitorder="little")) - np.arange(self.n)
        out = upper.astype("uint64") << np.uint64(self.low_bits)
        if self.low_bits:
            digits = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, -1)
            for k in range(self.low_bits):
                out |= digits[:, k].astype("uint64") << np.uint64(k)
        return out


class Segment:
    """One segment in a buffer (the content of a file, or a memory map)."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a segment of token ids")
        width, self.number, self.n_ids, self.n_docs, self.n_null, self.first, *_ = struct.unpack_from("<8q", data, 8)
        self.ends = EliasFano(data, 72)
        self.docs = EliasFano(data, self.ends.end)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, self.docs.end)

    @staticmethod
    def pack(number: int, docs: list[int | None], lengths: list[int], ids: bytes, width: int) -> tuple[bytes, bytes]:
        """The segment and its count file.  Documents in ascending order, those
        without an id first."""
        known = [d for d in docs if d is not None]
        first, n = known[0] if known else 0, len(ids) // width
        head = struct.pack("<8q", width, number, n, len(docs), len(docs) - len(known), first, 0, 0)
        return (MAGIC + head + EliasFano.pack(np.cumsum(lengths, dtype="int64"))
                + EliasFano.pack(np.array([d - first for d in known], "uint64")) + ids, COUNT + struct.pack("<2q", number, n))

    def span(self, i: int) -> tuple[int, int]:
        """Where the i-th document's ids begin and end in this segment."""
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.first + self.docs[i - self.n_null]

    def document_at(self, position: int) -> int:
        """Number of the document that holds the id at ``position``."""
        return self.ends.before(position)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[slice(*self.span(i))]


# -- tokenising ---------------------------------------------------------------

#: Fixed value: the pre-token pattern of the lower-casing vocabulary.
LETTERS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for lower-cased text below U+0250, where letters and numbers are few
#: ranges; normal form C changes nothing there, and lower-casing takes single
#: characters (but for U+0130).
_L, _N, _S = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LOW_PIECES = f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+"
BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]|<\\|").search


def byte_alphabet() -> list[str]:
    """The character of each byte in byte-level vocabularies: visible Latin-1 bytes
    stand for themselves, the others follow from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def pre_token_wise(tokenizer: str) -> bool:
    """Whether the tokenizer (its JSON) lower-cases, removes white space, splits by
    ``LETTERS_PATTERN`` and merges bytes, so that encoding by pre-tokens is exact."""
    spec = json.loads(tokenizer)
    kinds = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, *after = (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) or [{}]
    return (kinds == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split"
            and split.get("pattern") == {"Regex": LETTERS_PATTERN} and split.get("behavior") == "Removed"
            and bool(split.get("invert")) and [x.get("type") for x in after] == ["ByteLevel"]
            and not after[0].get("add_prefix_space") and spec["model"].get("type") == "BPE"
            and all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"])
                    for t in spec.get("added_tokens", [])))


def process_encoder(tokenizer: str) -> Callable[[list[str]], list[np.ndarray]]:
    """The encoder of this Python process, kept beside the library it wraps: a
    worker's later tasks find the runs that its earlier ones learned."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_txlens_encoders", {})
    if tokenizer not in kept:
        kept.clear()
        kept[tokenizer] = make_encoder(tokenizer)
    return kept[tokenizer]


def make_encoder(tokenizer: str) -> Callable[[list[str]], list[np.ndarray]]:
    """Ids of whole texts.  ``tokenizer`` is the JSON of a ``tokenizers`` file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(tokenizer)

    def plain(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]

    if not pre_token_wise(tokenizer):
        return lambda texts: [np.array(x, "uint32") for x in plain(texts)]
    pieces_of, merge, alphabet = re.compile(LOW_PIECES).findall, model.model.tokenize, byte_alphabet()
    number: dict[str, int] = {}          # pre-token, or blank and run -> row of ``flat``
    state = {"flat": np.zeros(0, "uint32"), "at": np.zeros(1, "int64")}

    def keys_of(text: str) -> list[str]:
        if ("<|" not in text) if text.isascii() else not BEYOND(text):
            return pieces_of(text.lower())
        out = []
        for run in re.split("[\t-\r ]+", text):
            out += [" " + run] if BEYOND(run) else pieces_of(run.lower())
        return out

    def learn(new: list[str]) -> None:
        runs = [k[1:] for k in new if k[0] == " "]
        whole = iter(plain(runs) if runs else [])
        got = [next(whole) if k[0] == " " else
               [t.id for t in merge(k if k.isascii() and k.isprintable() else
                                    "".join([alphabet[b] for b in k.encode()]))] for k in new]
        state["flat"] = np.concatenate([state["flat"], np.array([i for g in got for i in g], "uint32")])
        state["at"] = np.concatenate([state["at"], state["at"][-1] + np.cumsum([len(g) for g in got], dtype="int64")])
        number.update(zip(new, range(len(number), len(number) + len(new))))

    def encode(texts: list[str]) -> list[np.ndarray]:
        keys = [keys_of(t) for t in texts]
        flat_keys = [k for own in keys for k in own]
        if len(number) > KNOWN:
            number.clear()
            state.update(flat=np.zeros(0, "uint32"), at=np.zeros(1, "int64"))
        rows = np.fromiter(map(number.get, flat_keys, repeat(-1)), "int64", len(flat_keys))
        unknown = np.flatnonzero(rows < 0).tolist()
        if unknown:
            learn(list(dict.fromkeys([flat_keys[i] for i in unknown])))
            rows[unknown] = [number[flat_keys[i]] for i in unknown]
        first, size = state["at"][rows], np.diff(state["at"])[rows]
        total = np.cumsum(size)
        flat = state["flat"][np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + size, size)]
        ends = np.concatenate([[0], total])[np.cumsum([len(own) for own in keys])] if keys else []
        return np.split(flat, ends[:-1]) if len(keys) else []

    return encode


def id_bytes(tokenizer: str, end_id: int) -> int:
    spec = json.loads(tokenizer)
    most = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return 2 if most < 1 << 16 else 4


# -- segments -----------------------------------------------------------------

def place_key(doc_id: np.ndarray, known: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Byte strings that sort as (doc_id, tie) do, rows without an id first."""
    out = np.zeros((len(tie), 17), "u1")
    out[:, 0] = known
    for at, part in ((1, np.where(known, doc_id, 0)), (9, tie)):
        out[:, at:at + 8] = (part.astype("int64") ^ np.int64(-1 << 63)).astype(">i8").view("u1").reshape(-1, 8)
    return out.view("S17").ravel()


def segment_cuts(docs: DataFrame, segment_bytes: int) -> np.ndarray:
    """First place key of each segment of ``docs`` (doc_id, tie, bytes)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum("bytes")).first()[0] or 0
    segment_bytes = max(segment_bytes, -(-total // MAX_SEGMENTS))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // segment_bytes))
    # stored: range bounds are sampled, and must not be drawn twice
    ranged = materialize(docs.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()))
    before = F.sum("bytes").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    cuts = (ranged.withColumn("sub", F.floor(F.coalesce(before, F.lit(0)) / segment_bytes)).groupBy("part", "sub")
            .agg(F.min(F.struct("doc_id", "tie")).alias("first")).orderBy("part", "sub").collect())   # a row per segment
    known = np.array([r.first.doc_id is not None for r in cuts], bool)
    return place_key(np.array([r.first.doc_id or 0 for r in cuts], "int64"), known,
                     np.array([r.first.tie for r in cuts], "int64"))


def segment_numbers(cuts: np.ndarray, keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The segment of each key; keys at which several segments begin are dealt over
    these by their row number."""
    last = np.searchsorted(cuts, keys, "right") - 1
    first = np.minimum(np.searchsorted(cuts, keys, "left"), last)
    return first + row % (last - first + 1)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
              segment_bytes: int = SEGMENT_BYTES) -> int:
    """Write the segments of ``docs`` into the folder ``path`` (replaced); returns
    their number."""
    spark = docs.sparkSession
    bound_batches(spark)
    width = id_bytes(tokenizer, end_id)
    own = docs.select(col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    tie = F.xxhash64("text")
    cuts = segment_cuts(own.select("doc_id", tie.alias("tie"), (F.octet_length("text") + 1).cast("long").alias("bytes")),
                        segment_bytes)
    shared = spark.sparkContext.broadcast((tokenizer, cuts.tobytes()))     # the tokenizer: a file of a few MB

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, row = np.frombuffer(shared.value[1], "S17"), 0
        encoder = process_encoder(shared.value[0])
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                doc_id, known = part.column(0).fill_null(0).to_numpy(), part.column(0).is_valid().to_numpy(False)
                keys = place_key(doc_id, known, part.column(1).to_numpy())
                segment = segment_numbers(cuts, keys, np.arange(row, row + len(keys)))
                row += len(keys)
                rows = encoder(part.column(2).to_pylist())
                packed = [np.append(x, end_id).astype(f"<u{width}").tobytes() for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment, pa.int32()), part.column(0), part.column(1), pa.array(packed, pa.binary())],
                    names=["segment", "doc_id", "tie", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ids = None, [], []

        def files() -> pa.RecordBatch:
            pair = Segment.pack(now, held, [len(x) // width for x in ids], b"".join(ids), width)
            held.clear(), ids.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair, pa.binary())], names=["data"])

        for b in batches:
            for number, doc, part in zip(*(c.to_pylist() for c in b.columns)):
                if number != now and held:
                    yield files()
                now = number
                held.append(doc)
                ids.append(part)
        if held:
            yield files()

    encoded = own.select("doc_id", tie.alias("tie"), "text").mapInArrow(
        encode, "segment int, doc_id long, tie long, ids binary")
    segments = (encoded.repartition(max(1, len(cuts)), "segment")
                .sortWithinPartitions("segment", F.col("doc_id").asc_nulls_first(), "tie")
                .select("segment", "doc_id", "ids").mapInArrow(build, "data binary"))
    # the text writer puts the bytes of its one column and a line end: one row a file
    (segments.select(F.col("data").cast("string").alias("value")).write.mode("overwrite")
     .option("maxRecordsPerFile", 1).text(path))
    return len(cuts)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files at ``path``: doc_id, start (ids of all
    documents before it), n_tokens, ids (unsigned 32-bit, packed)."""
    bound_batches(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    small = 8 + 16 + 1           # the length of a count file; a segment is longer
    counts = sorted(struct.unpack_from("<2q", bytes(r.content), 8)
                    for r in files.filter(F.col("length") == small).select("content").collect())     # a row per segment
    n = np.array([c for _, c in counts], "int64")
    shared = spark.sparkContext.broadcast(dict(zip((k for k, _ in counts), (np.cumsum(n) - n).tolist())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                s = Segment(memoryview(content.as_buffer()))
                base, ends = shared.value[s.number], s.ends.all().astype("int64")
                starts = np.concatenate([[0], ends[:-1]])
                doc_ids = [None] * s.n_null + [s.first + d for d in s.docs.all().tolist()]
                for i in range(0, s.n_docs, 4096):
                    cut = range(i, min(i + 4096, s.n_docs))
                    ids = [s.ids[starts[k]:ends[k]].astype("<u4").tobytes() for k in cut]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[i:i + 4096], pa.int64()), pa.array(base + starts[i:i + 4096]),
                         pa.array((ends - starts)[i:i + 4096]), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    return (files.filter(F.col("length") > small).select("content")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary"))
