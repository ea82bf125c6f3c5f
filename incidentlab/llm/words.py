"""Words of many texts at once, as arrays: where they stand, what they are, and how to join them.

Words are the stretches without one of the six ASCII white-space characters. All of it works on the
bytes of a slice of a column, so that no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if len(sizes):
        yield start, len(sizes)


@dataclass
class Words:
    """The words of a slice: ``raw`` bytes, first and last place of every word, and how many words
    each text has."""

    raw: np.ndarray
    inside: np.ndarray  # whether a byte belongs to a word
    starts: np.ndarray
    lengths: np.ndarray
    counts: np.ndarray

    def encoded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for every word, equal where the words are equal, and the distinct words."""
        data = self.raw[self.inside]
        offsets = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.lengths, out=offsets[1:])
        values = pa.Array.from_buffers(
            pa.binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        found = values.dictionary_encode()
        return found.indices.to_numpy(), found.dictionary

    def joined(self, order: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The words in ``order`` with one space after each, and where each of them starts."""
        lengths = self.lengths[order] + 1
        at = np.zeros(len(order) + 1, np.int64)
        np.cumsum(lengths, out=at[1:])
        take = np.repeat(self.starts[order] - at[:-1], lengths)
        take += np.arange(len(take))
        last = at[1:] - 1
        take[last] = 0
        out = self.raw[take] if len(take) else np.zeros(0, np.uint8)
        out[last] = 32
        return out.tobytes(), at


def split(texts: pa.Array, lower: bool = False) -> Words:
    """The words of the texts (null: none); ``lower`` turns A-Z into a-z first."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[
        texts.offset:texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0]:offsets[-1]] if body and len(texts) else (
        np.zeros(0, np.uint8))
    edges = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    if lower:
        raw = _LOWER[raw]
    word = ~_SPACE[raw]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = edges[(edges > 0) & (edges < len(raw))]
    first[cut] |= word[cut]
    last[cut - 1] |= word[cut - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    counts = np.diff(np.searchsorted(starts, edges))
    return Words(raw, word, starts, lengths, counts if len(texts) else np.zeros(0, np.int64))
