"""Whole columns of text as flat numpy arrays: bytes, words, shingles and their hashes.

Everything works on the UTF-8 buffer of an Arrow column, so no Python object is
made per word. Hashes are 64 bits, modulo 2**64, the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken from an Arrow batch in slices of about this size; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DRAW = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _DRAW.integers(0, 2**64, 256, dtype=np.uint64)
_MULTIPLIERS = _DRAW.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, kept between calls."""
    if len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of bounded text, in order."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(n) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def release() -> None:
    """Give a finished task's Arrow memory back: workers live on for the tasks of other stages."""
    pa.default_memory_pool().release_unused()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of byte value times power of the base, of every prefix."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:], dtype=np.uint64)
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings ``[start, end)``."""
    _, down = _powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space, A-Z lowered): hashes, starts, ends, and the first word of each row."""
    n = len(data)
    if not n:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1] | breaks[1:-1]
    closes[:-1] &= ~inside[1:] | breaks[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return range_hashes(prefix_sums(low), starts, ends), starts, ends, np.searchsorted(starts, offsets)


def combine(word_hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, one for each place at which a run fits (rows not yet kept apart)."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total += word_hashes[k : k + n] * _MULTIPLIERS[k % 64]
        if k % 64 == 63:
            total = mix(total)
    return mix(total + np.uint64(size))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Of each row, the sorted distinct shingles of ``size`` words; fewer words are one shingle, none give none."""
    hashes, _, _, first = words(data, offsets)
    full = combine(hashes, size)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            found = np.sort(full[a : b - size + 1])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        else:
            sets.append(combine(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return sets
