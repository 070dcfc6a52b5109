"""Flat numpy views of many texts at once: word bounds, word hashes, per-document sums.

A word is a maximal run of bytes other than space and 0x09 to 0x0D; these bytes never occur
inside a longer UTF-8 sequence, so byte positions are enough. A NULL text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer single text is taken alone.
CHUNK_BYTES = 1 << 20

SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def text_chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK_BYTES of text each, or one row; an empty batch has none."""
    sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and the offsets of each text in them."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    bounds = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    if data is None or not len(whole):
        return np.zeros(0, np.uint8), np.zeros(len(whole) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]], bounds - bounds[0]


@dataclass
class Words:
    """The words of several texts: ``data`` has all bytes, word i is data[starts[i]:ends[i]]."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray  # words of each text

    @property
    def bounds(self) -> np.ndarray:
        """Text d has the words bounds[d] up to bounds[d + 1]."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a text's border."""
    before = np.concatenate((np.zeros(1, bool), member[:-1]))[:len(member)]
    inner = offsets[:-1][offsets[:-1] < len(member)]
    before[inner] = False
    after = np.concatenate((member[1:], np.zeros(1, bool)))[:len(member)]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    return np.flatnonzero(member & ~before), np.flatnonzero(member & ~after) + 1


def split_words(texts: pa.Array, lower: bool = True, separators: np.ndarray = SPACES) -> Words:
    data, offsets = flat_bytes(texts)
    if lower:
        data = LOWER[data]
    starts, ends = runs(~separators[data], offsets)
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(data, offsets, starts, ends, counts)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit values, so that all result bits depend on all input bits."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit polynomial hashes of disjoint, ascending byte spans; equal bytes get equal hashes."""
    lengths = ends - starts
    total = int(lengths.sum())
    if not total:
        return mixed(np.full(len(starts), salt, np.uint64))
    first = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(first, lengths)
    powers = np.full(int(lengths.max()), 0x9FB21C651E98DF25, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    terms = (data[within + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)) * powers[within]
    sums = np.add.reduceat(np.append(terms, np.uint64(0)), first)
    sums[lengths == 0] = 0
    return mixed(sums ^ (lengths.astype(np.uint64) << np.uint64(40)) ^ np.uint64(salt))


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between each pair of neighbouring bounds; empty ranges give 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[bounds[1:]] - total[bounds[:-1]]
