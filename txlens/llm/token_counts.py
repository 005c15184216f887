"""Token counts that survive edits: a segment tree over runs of pre-tokens.

The tokenizer (byte-level BPE, its ranks and pattern given by parameters) first
splits a text into pre-tokens and never merges across them.  A text is cut into
leaves, runs of whole pre-tokens of about ``LEAF`` characters.  A cut lies before
a blank that has a non-blank on either side: every pre-token ends there, and
what follows is split the same way whatever precedes.  So the count of a text is
the sum over its leaves, and a leaf's count depends on its characters alone.

A segment tree holds the characters and tokens of the leaves.  An edit descends
by characters to the first and last leaf it touches, with the boundary context
(one character before and two after, which decide whether the cuts still
hold), re-encodes only those leaves and updates the sums on their paths.

Edits ride in an array column beside the text, in order, each against the text
as the earlier ones left it: no shuffle, and the memory of a task is one text
with its tree.  ``attach_edits`` brings a separate edit table into that form.

Defined results: NULL text counts as empty; NULL edits are none; a start beyond
the text appends, a negative one counts from the beginning; deletions stop at
the end; NULL insertions are empty; columns of the output's names are replaced;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txlens.llm.common import bound_batches, col, text_or_empty

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 512
EDIT = "struct<start:bigint,n_delete:bigint,insert:string>"
LEAVES = T.ArrayType(T.IntegerType())
STATE = T.StructType().add("chars", LEAVES).add("tokens", LEAVES)
EDITED = (T.StructType().add("text", "string").add("chars", LEAVES).add("tokens", LEAVES)
          .add("n_tokens", "long").add("chars_encoded", "long").add("nodes_updated", "long"))


def counter(ranks: str = RANKS, pattern: str = PATTERN) -> Callable[[str], int]:
    """Tokens of a text.  The encoder is built once per Python process and kept
    where the tokenizer library keeps its own."""
    import tiktoken
    from tiktoken import registry

    name = f"{ranks}\n{pattern}"
    if name not in registry.ENCODINGS:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        registry.ENCODINGS[name] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=table, special_tokens={})
    encode = registry.ENCODINGS[name].encode_ordinary
    return lambda text: len(encode(text))


def split_leaves(text: str, leaf: int = LEAF) -> list[str]:
    """Cut a text before blanks between two non-blanks, at every ``leaf``
    characters or later."""
    out, start, at = [], 0, leaf
    while 0 < at < len(text) - 1:
        at = text.find(" ", at, len(text) - 1)
        if at < 0:
            break
        if not text[at - 1].isspace() and not text[at + 1].isspace():
            out.append(text[start:at])
            start, at = at, at + leaf
        else:
            at += 1
    out.append(text[start:])
    return out


class SegmentTree:
    """Characters and tokens of a row of leaves; node i has children 2i, 2i + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars = [0] * self.size + chars + pad
        self.tokens = [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of the leaf that holds character ``at``."""
        i, first = 1, 0
        while i < self.size:
            i *= 2
            if at >= first + self.chars[i] and self.chars[i + 1]:
                first += self.chars[i]
                i += 1
        return i - self.size, first

    def update(self, leaf: int, chars: int, tokens: int) -> int:
        """Set a leaf; the number of nodes updated."""
        i = leaf + self.size
        more, extra, n = chars - self.chars[i], tokens - self.tokens[i], 0
        while i:
            self.chars[i] += more
            self.tokens[i] += extra
            i, n = i // 2, n + 1
        return n


class Counted:
    """A text under edits: its leaves and their tree."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], count: Callable[[str], int]):
        ends = np.cumsum(chars).tolist()
        self.leaves = [text[e - n:e] for n, e in zip(chars, ends)]
        self.tree = SegmentTree(list(chars), list(tokens))
        self.count = count
        self.encoded = self.updated = 0

    def edit(self, start: int, n_delete: int, insert: str) -> None:
        total = self.tree.chars[1]
        start = min(max(start, 0), total)
        end = min(start + max(n_delete, 0), total)
        lo, first = self.tree.find(max(start - 2, 0))
        hi, last = self.tree.find(min(end + 1, max(total - 1, 0)))
        text = "".join(self.leaves[lo:hi + 1])
        text = text[:start - first] + insert + text[end - first:]
        parts = split_leaves(text)
        self.encoded += len(text)
        counts = [self.count(p) for p in parts]
        if len(parts) <= hi + 1 - lo:
            for i in range(hi + 1 - lo):
                self.leaves[lo + i] = parts[i] if i < len(parts) else ""
                self.updated += self.tree.update(lo + i, len(self.leaves[lo + i]), counts[i] if i < len(parts) else 0)
            return
        # more leaves than there were: the tree gets a new shape, no other leaf is encoded again
        old = self.tree.tokens[self.tree.size:self.tree.size + len(self.leaves)]
        self.leaves[lo:hi + 1] = parts
        self.tree = SegmentTree([len(x) for x in self.leaves], [*old[:lo], *counts, *old[hi + 1:]])
        self.updated += 2 * self.tree.size

    def state(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold any text."""
        tokens = self.tree.tokens[self.tree.size:]
        kept = [(len(x), t) for x, t in zip(self.leaves, tokens) if x] or [(0, 0)]
        return [c for c, _ in kept], [t for _, t in kept]


def build_state(docs: DataFrame, text_col: str = "text", into: str = "state", ranks: str = RANKS,
                pattern: str = PATTERN) -> DataFrame:
    """``docs`` with a struct ``into`` of the leaves' characters and tokens."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(STATE)
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = counter(ranks, pattern)
        for texts in batches:
            leaves = [split_leaves(t) for t in texts]
            yield pd.DataFrame({"chars": [[len(x) for x in d] for d in leaves],
                                "tokens": [[count(x) for x in d] for d in leaves]})

    return docs.withColumn(into, build(text_or_empty(text_col)))


def attach_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", into: str = "edits") -> DataFrame:
    """``docs`` with the edits of a table (id, seq, start, n_delete, insert) as an
    ordered array; equal seq are ordered by the other columns.  A document's
    edits are sequential, so they meet in its row."""
    one = F.struct("seq", "start", "n_delete", "insert")
    by_doc = (edits.filter(col(id_col).isNotNull()).groupBy(col(id_col).alias(id_col))
              .agg(F.array_sort(F.collect_list(one)).alias(into)))
    arrays = by_doc.withColumn(into, F.transform(into, lambda e: F.struct(e["start"], e["n_delete"], e["insert"])).cast(f"array<{EDIT}>"))
    return docs.drop(into).join(arrays, id_col, "left")


def apply_edits(docs: DataFrame, text_col: str = "text", state_col: str = "state", edits_col: str = "edits",
                into: str = "edited", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """``docs`` with a struct ``into``: the edited text, its leaves, n_tokens, the
    characters encoded again and the tree nodes updated."""
    bound_batches(docs.sparkSession)

    @F.pandas_udf(EDITED)
    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame, pd.Series]]) -> Iterator[pd.DataFrame]:
        count = counter(ranks, pattern)
        names = [f.name for f in EDITED.fields]
        for texts, states, edits in batches:
            out = []
            for text, chars, tokens, todo in zip(texts, states["chars"], states["tokens"], edits):
                now = Counted(text, list(chars), list(tokens), count)
                for e in todo if todo is not None else ():
                    now.edit(int(e["start"] or 0), int(e["n_delete"] or 0), e["insert"] or "")
                out.append(("".join(now.leaves), *now.state(), now.tree.tokens[1], now.encoded, now.updated))
            yield pd.DataFrame(out, columns=names)

    return docs.withColumn(into, run(text_or_empty(text_col), col(state_col), col(edits_col)))
