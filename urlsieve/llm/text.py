"""Words of whole texts, found and hashed on Arrow's UTF-8 buffers with numpy.

A word is a maximal run of bytes other than space and 0x09-0x0D. No byte of a longer
UTF-8 sequence lies in that range, so bytes and code points give the same words.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
BLOCK = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (one more than texts).

    ``between`` marks the bytes that part words.
    """
    n = data.size
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    gap = between[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before, after = edge[:-1].copy(), edge[1:].copy()
    before[1:] |= gap[:-1]
    after[:-1] |= gap[1:]
    starts = np.flatnonzero(before & ~gap)
    ends = np.flatnonzero(after & ~gap) + 1
    return starts, ends, np.searchsorted(starts, offs)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(8)
def _powers(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    base = (0x9E3779B97F4A7C15 + 2 * seed * 0x632BE59BD9B4E019) & (2**64 - 1) | 1
    inverse = pow(base, -1, 2**64)
    out = []
    for b in (base, inverse):
        steps = np.full(size, b, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def powers(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(12, int(size - 1).bit_length()), seed)


@lru_cache(8)
def _byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each word, the same wherever the word stands."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    codes = _byte_codes(seed)
    cuts = np.unique(np.searchsorted(starts, np.arange(0, int(starts[-1]) + BLOCK, BLOCK)))
    cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = int(starts[a]), int(ends[b - 1])
        power, inverse = powers(hi - lo + 1, seed)
        acc = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(codes[data[lo:hi]] * power[: hi - lo], out=acc[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        out[a:b] = (acc[e] - acc[s]) * inverse[s] + (e - s).astype(np.uint64)
    return mix(out)


def window_hashes(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``width`` words; entry i starts at word i of the whole batch."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, inverse = powers(len(hashes) + 1, seed)
    acc = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * power[: len(hashes)], out=acc[1:])
    return mix((acc[width:] - acc[:n]) * inverse[:n])


def owners(first: np.ndarray) -> np.ndarray:
    """The text's index for every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def cut_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves as one Arrow string array."""
    sizes = ends - starts
    offs = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=offs[1:])
    take = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], sizes)
    raw = pa.py_buffer(np.ascontiguousarray(data[take]))
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offs), raw])


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and the index of each entry's value, by hashing instead of sorting."""
    seen = pa.array(codes).dictionary_encode()
    return seen.dictionary.to_numpy(zero_copy_only=False), seen.indices.to_numpy(zero_copy_only=False)
