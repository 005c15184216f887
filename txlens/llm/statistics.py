"""Document statistics for the quality and toxicity models.

``describe`` maps one whole text (UTF-8) to ``len(NAMES)`` transformed numbers:
counts become log ratios, so that their class-wise distributions come closer to
Gaussian ones.  The empty text has defined values like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from operator import eq

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMES = ["words", "word_length", "upper", "digits", "symbols", "bars", "bangs", "stops",
         "distinct_words", "distinct_pairs", "repeats", "distinct_lines", "line_length"]

UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
STOPS = b".,;:'\"-?"
BLANKS = b" \t\n\r\x0b\x0c"
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in STOPS + b"|!")


def describe(text: bytes) -> list[float]:
    size = len(text)

    def count(of: bytes) -> int:
        return size - len(text.translate(None, of))

    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    n, m = len(words), len(lines)
    return [
        log(1 + n),
        log(1 + (size - count(BLANKS)) / (n + 1)),
        log((count(UPPER) + 1) / (size + 2)),
        log((count(DIGITS) + 1) / (size + 2)),
        log((count(SYMBOLS) + 1) / (n + 2)),
        log((text.count(b"|") + 1) / (n + 2)),
        log((text.count(b"!") + 1) / (n + 2)),
        log((count(STOPS) + 1) / (n + 2)),
        log((len(set(words)) + 1) / (n + 1)),
        log((len(set(zip(words, words[1:]))) + 1) / (n + 1)),
        log((sum(map(eq, words, words[1:])) + 1) / (n + 2)),
        log((len(set(lines)) + 1) / (m + 1)),
        log((n + 1) / (m + 1)),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def document_statistics(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([describe(bytes(t)) for t in texts])
