"""Vectorised words and hashes over Arrow string arrays, shared by the Arrow kernels."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(values, np.uint8)] = True
    return out


#: ASCII white space: space and the five controls from tab to carriage return.
WHITE = _table(b" \t\n\v\f\r")
#: Everything in ASCII that is neither letter nor digit.
NOT_ALNUM = _table(bytes(c for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTES = np.random.default_rng(20240229).integers(0, 2**64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts: word w has bytes `letters[at[w]:at[w] + size[w]]`, hash `hash[w]`;
    text d has the words `first[d]` to `first[d + 1]`."""

    letters: np.ndarray
    at: np.ndarray
    size: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def picked(self, which: np.ndarray) -> pa.Array:
        """The chosen words as an Arrow binary array."""
        size = self.size[which]
        ends = np.cumsum(size)
        where = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at[which] - (ends - size), size)
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(self.letters[where].tobytes())])


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), np.int64)
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def give_back() -> None:
    """Hand memory that is free in this process back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """`kernel` for mapInArrow, giving back what it freed when its task ends: idle workers live on beside the next stage's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()
    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def split_words(texts: pa.Array, separators: np.ndarray = WHITE) -> Words:
    """Words between separator bytes, ASCII letters lower-cased, with 64-bit hashes. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = ~separators[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - starts
    letters = LOWER[data[inside]]
    at = np.cumsum(size) - size
    longest = int(size.max()) if len(size) else 0
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    if len(size):
        values = _BYTES[letters] * powers[np.arange(len(letters)) - np.repeat(at, size)]
        hashes = mix(np.add.reduceat(values, at) + size.astype(np.uint64) * _BASE)
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(letters, at, size, hashes, np.searchsorted(starts, offsets))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive hashes (across text borders too)."""
    total = max(0, len(hashes) - n + 1)
    out = np.full(total, n, np.uint64) * _BASE
    for k in range(n):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k: k + total])
    return out


def shingle_sets(words: Words, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of n-word shingles; a shorter text is one shingle, none without words."""
    runs = chained(words.hash, n)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a: b - n + 1]))
        else:
            out.append(chained(words.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def list_array(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    """Arrow list array of numeric arrays."""
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if flat.dtype == np.uint64:
        flat = flat.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, kind))


def list_parts(array: pa.Array, kind: type = np.int64) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and offsets of an Arrow list array."""
    offsets = np.asarray(array.offsets)
    flat = np.asarray(array.values.to_numpy(zero_copy_only=False), kind)
    return flat[offsets[0]: offsets[-1]], offsets - offsets[0]
