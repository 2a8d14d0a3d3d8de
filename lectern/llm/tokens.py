"""Words of Arrow text batches as byte ranges and 64-bit hashes, all of a batch at once.

Works on the UTF-8 bytes: both word patterns in use separate at ASCII bytes only, so
every byte of a longer character belongs to a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
#: A-Z lower-cased, all other bytes as they are.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
#: Words of [^\x20\x09-\x0D]+
SPACED = ~((_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13)))
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after lower-casing
ALNUM = (_BYTES >= 128) | ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))

_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values with good avalanche (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


class Words:
    """starts, ends: byte ranges of all words; bounds[i]:bounds[i+1] are the words of text i; hashes: of the lower-cased words."""

    def __init__(self, texts: pa.Array, word: np.ndarray):
        self.data, self.offsets = text_bytes(texts)
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = word[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        edge = inside[1:] & (~inside[:-1] | first)
        self.starts = np.flatnonzero(edge[:-1])
        edge = inside[:-1] & (~inside[1:] | first)
        self.ends = np.flatnonzero(edge)
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self._low = np.zeros(n + 16, np.uint8)
        self._low[8 : n + 8] = LOWER[self.data]
        self.hashes = self.range_hashes(self.starts, self.ends)

    def range_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the lower-cased bytes of each range."""
        return hash_ranges(self._low, starts, ends)


def hash_ranges(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges of data that has 8 bytes of padding before and after it."""
    view = np.ndarray((len(padded) - 7,), np.uint64, padded, 0, (1,))
    size = ends - starts
    h = mix((size.astype(np.uint64) + np.uint64(seed)) * _C1 ^ (view[starts + 8] & _MASK[np.minimum(size, 8)]))
    k, more = 8, np.flatnonzero(size > 8)
    while len(more):
        h[more] = mix(h[more] * _C1 + (view[starts[more] + 8 + k] & _MASK[np.minimum(size[more] - k, 8)]))
        k += 8
        more = more[size[more] > k]
    return h


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (no nulls) and their n + 1 offsets."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], size: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Each batch cut between rows into pieces of about ``size`` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows:
            _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
                yield batch.slice(at, to - at)
                at = to


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list array of values[bounds[i]:bounds[i+1]]."""
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))
