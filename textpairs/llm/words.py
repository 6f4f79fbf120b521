"""The word rule shared by these operators: words are maximal runs of
``[^\\x20\\x09-\\x0D]``.  On UTF-8 bytes that is exactly what ``bytes.split()``
does, so Python workers receive the text as binary and split it there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

#: The six ASCII white-space characters that part words.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"

def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word."""
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words_of(text: Column) -> Column:
    """Array of words; no word gives an empty array."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS + "+")).cast("long")


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
