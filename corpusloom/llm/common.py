"""Shared helpers of the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.session import bounded_batches  # noqa: F401  the operators take it from here
from corpusloom.tables import dropped, shared_dir, stored  # noqa: F401  the operators take them from here

#: Separators of words: space and \x09-\x0D.
BLANKS = "[\\x20\\x09-\\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def whole(text: Column) -> Column:
    """The whole text; a null is an empty text."""
    return F.coalesce(text, F.lit(""))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def text_slices(texts: list, most: int = 4 << 20):
    """(from, to) runs of a list of texts, each at most `most` characters long unless a single text is longer."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def arrow_slices(texts, most: int = 4 << 20):
    """(from, to) runs of an Arrow column of texts, each at most `most` bytes long unless a single text is longer."""
    import numpy as np
    import pyarrow.compute as pc

    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, done = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, stop
        start, done = stop, int(ends[stop - 1])
