"""Texts of an Arrow batch as one buffer of bytes, and the words in it as slices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts that are looked at together, unless a single text is longer.
TOGETHER = 1 << 23


def table(kept: Iterable[int]) -> np.ndarray:
    """A lookup table of bytes: those `kept` stand for themselves, A-Z among them for a-z, and all others for 0."""
    out = np.zeros(256, np.uint8)
    for b in kept:
        out[b] = b + 32 if 65 <= b <= 90 else b
    return out


class Words(NamedTuple):
    """Words in the texts of a batch: `low` are the texts' bytes as the table has them; word k is low[starts[k] : ends[k]],
    and the words of text t are first[t] to first[t + 1]."""

    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array, of: np.ndarray) -> Words:
    """The runs of bytes of each text that the table `of` doesn't map to 0; null is empty. No run goes on in the next text."""
    whole = pc.fill_null(column, "").cast(pa.large_string())
    _, ends, data = whole.buffers()
    cuts = np.frombuffer(ends, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    low = of[np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]]] if data is not None and len(cuts) else np.zeros(0, np.uint8)
    cuts = cuts - cuts[0] if len(cuts) else np.zeros(1, np.int64)
    inside = low != 0
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    inner = cuts[(cuts > 0) & (cuts < len(low))]
    begins[inner] = inside[inner]
    stops[inner - 1] = inside[inner - 1]
    starts = np.flatnonzero(begins)
    return Words(low, starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, cuts))


#: Slices that are compared or hashed at a time.
SLICES = 1 << 17


def equal(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether slice k of `a` and of `b`, both of sizes[k] bytes and not empty, are the same byte for byte."""
    out = np.zeros(len(sizes), np.bool_)
    for k in range(0, len(sizes), SLICES):
        size = sizes[k : k + SLICES]
        ends = np.cumsum(size)
        within = np.arange(ends[-1]) - np.repeat(ends - size, size)
        same = a[np.repeat(a_starts[k : k + SLICES], size) + within] == b[np.repeat(b_starts[k : k + SLICES], size) + within]
        out[k : k + SLICES] = np.logical_and.reduceat(same, ends - size)
    return out


def together(batches: Iterable[pa.RecordBatch], text: str, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches of a task in pieces of at most `most` bytes of the column `text`; a longer text is a piece by itself."""
    for b in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0), np.int64)
        upto, begin = np.cumsum(sizes), 0
        while begin < b.num_rows:
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + most, "right")))
            yield b.slice(begin, end - begin)
            begin = end
