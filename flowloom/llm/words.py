"""Words of many texts at once, as flat arrays without an object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = 32


def byte_table(separators: bytes, fold: bool = False) -> np.ndarray:
    """A table of 256 bytes that turns separators into spaces and, with ``fold``, A-Z into a-z.
    All separators are ASCII, so bytes of longer UTF-8 characters always belong to words."""
    table = np.arange(256, dtype=np.uint8)
    if fold:
        table[65:91] += 32
    table[np.frombuffer(separators, np.uint8)] = SPACE
    return table


@dataclass
class FlatWords:
    """``code`` numbers the words of all rows in order; ``row`` is each word's row,
    ``count`` the words per row, ``names`` the different words by code."""

    code: np.ndarray
    row: np.ndarray
    count: np.ndarray
    names: pa.Array


def flat_words(texts: pa.Array, table: np.ndarray, apart: bytes = b"") -> FlatWords:
    """Cut a binary column (NULL counts as empty) at the separators of ``table``. A byte of
    ``apart`` that ends a word after one of A-Z or a-z is a word of its own."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    rows = len(texts)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + rows + 1] if rows else np.zeros(1, np.int64)
    body = texts.buffers()[2] if rows else None
    raw = np.frombuffer(body, np.uint8)[edges[0]:edges[-1]] if body is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    folded = table[raw]
    letter = folded != SPACE
    opens, closes = np.ones(len(raw), bool), np.ones(len(raw), bool)
    opens[1:], closes[:-1] = ~letter[:-1], ~letter[1:]
    filled = edges[1:] > edges[:-1]
    opens[edges[:-1][filled]] = True
    closes[edges[1:][filled] - 1] = True
    if apart:
        marks = np.zeros(256, bool)
        marks[np.frombuffer(apart, np.uint8)] = True
        at = np.flatnonzero(marks[folded] & closes & ~opens)
        at = at[(folded[at - 1] | 32) - 97 < 26]  # unsigned: smaller ones wrap around
        opens[at], closes[at - 1] = True, True
    starts, ends = np.flatnonzero(letter & opens), np.flatnonzero(letter & closes) + 1
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    letters = folded[letter]
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    coded = words.dictionary_encode()
    count = np.diff(np.searchsorted(starts, edges))
    return FlatWords(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(rows), count), count, coded.dictionary)
