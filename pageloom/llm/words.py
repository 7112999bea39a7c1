"""Words of whole texts, cut and numbered a slice of texts at a time.

A word is a longest run of digits, letters and characters beyond ASCII; only A-Z
are lower-cased. Words are cut on the bytes of all texts of a slice at once and
numbered by Arrow's dictionary, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text cut at once; a longer text is one slice.
SLICE_BYTES = 4 << 20

#: What each byte of a word becomes; 0 for bytes between words.
LETTERS = np.arange(256, dtype=np.uint8)
LETTERS[:0x80] = 0
LETTERS[0x30:0x3A] = np.arange(0x30, 0x3A)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text, or of one row."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


def cut_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """``(distinct words, number of each word, first word of each text)``.

    The words of all texts follow each other; the last array ends with their
    count. Null is a text without words.
    """
    binary = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)
    offsets = offsets[binary.offset : binary.offset + len(binary) + 1]
    buffer = binary.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, dtype=np.uint8)
    low = LETTERS[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(low)]
    begins[heads] = inside[heads]
    at = np.flatnonzero(begins)
    first = np.searchsorted(at, offsets)
    # Only letters stay, so a word starts where as many letters lie before it.
    before = np.cumsum(inside, dtype=np.int64)
    kept = low[inside]
    starts = np.append(before[at] - 1, len(kept)).astype(np.int32)
    words = pa.Array.from_buffers(
        pa.binary(), len(at), [None, pa.py_buffer(starts), pa.py_buffer(kept)]
    ).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(), first


def numbered(texts: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(number in the vocabulary of each word, or -1; first word of each text)``."""
    distinct, numbers, first = cut_words(texts)
    if not len(distinct):
        return numbers.astype(np.int64), first
    known = pc.fill_null(pc.index_in(distinct, value_set=vocabulary), -1).to_numpy()
    return known[numbers].astype(np.int64), first


def word_lists(texts: list[str | None]) -> list[list[bytes]]:
    """Words of a few texts."""
    distinct, numbers, first = cut_words(pa.array(texts, pa.string()))
    words = distinct.to_pylist()
    return [[words[n] for n in numbers[a:b]] for a, b in zip(first[:-1], first[1:])]
