"""Vectorised text helpers for Arrow batches inside tasks: slices of bounded size, words, hashes, minimizer segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
POS_BITS = 24


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd-free 64-bit values of a seed, the same on every machine."""
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % (1 << 64))
    return mix(start + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def table_of(*ranges: tuple[int, int]) -> np.ndarray:
    """Boolean table over byte values from inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


NOT_SPACE = ~table_of((0x20, 0x20), (0x09, 0x0D))
ALNUM = table_of((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def raw_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and 64-bit offsets of a string or binary column without copying the text; null reads as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n, skip = len(column), column.offset
    if offsets is None or n == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[skip : skip + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return buf, offs


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, end row, bytes, offsets from 0): neighbouring rows up to about `limit` bytes, a longer row alone."""
    buf, offs = raw_text(column)
    n, lo = len(column), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every maximal run of table bytes, and per row the index of its first word (rows + 1 values)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = table[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offs] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offs)


_BYTE = stream(256, 1) | np.uint64(1)
_PLACE = stream(4096, 2) | np.uint64(1)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span (spans in order, not overlapping, not empty)."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lens = ends - starts
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    longest = int(lens.max())
    places = _PLACE if longest <= len(_PLACE) else stream(longest, 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        parts = _BYTE[buf[place + np.repeat(starts, lens)]] * places[place]
        return mix(np.add.reduceat(parts, first) ^ lens.astype(np.uint64))


_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 1 << 64)


class Rolling:
    """Hashes of arbitrary token ranges from one prefix sum over 64-bit token values."""

    powers: dict = {}

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        size = 1 << max(16, int(n).bit_length())
        if size not in Rolling.powers:
            Rolling.powers.clear()
            up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BACK, dtype=np.uint64)
            up[0] = down[0] = 1
            Rolling.powers[size] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        up, self.down = Rolling.powers[size]
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(tokens * up[:n], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])

    def ranges(self, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(_BASE) + np.uint64(seed))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of `width` values."""
    have, m = 1, x
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == width else np.minimum(m[: len(x) - width + 1], m[width - have : width - have + len(x) - width + 1])


def segments(tokens: np.ndarray, row_ends: np.ndarray, window: int, k: int, hot: np.ndarray):
    """Cut every row into runs of windows that share one anchor.

    The anchor of a window is its k-gram of least hash, so equal windows have equal anchors wherever they stand; k-grams in `hot`
    (sorted) are taken only if a window has no other. Returns (anchor, first window, number of windows, digest of the covered tokens)
    per run, in token positions. `row_ends`: row boundaries, first 0. Rows shorter than a window give nothing.
    """
    n = len(tokens)
    if n < window:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(np.uint64)
    assert n < 1 << POS_BITS
    roll = Rolling(tokens)
    grams = roll.grams(k)
    low = np.uint64((1 << POS_BITS) - 1)
    order = grams | low
    if len(hot):
        seen = np.zeros(1 << 16, dtype=bool)
        seen[hot >> np.uint64(48)] = True
        maybe = np.flatnonzero(seen[grams >> np.uint64(48)])
        at = np.searchsorted(hot, grams[maybe])
        order[maybe[hot[np.minimum(at, len(hot) - 1)] == grams[maybe]]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    order ^= low - np.arange(len(grams), dtype=np.uint64)
    anchor = (sliding_min(order, window - k + 1) & low).astype(np.int64)
    count = n - window + 1
    row = np.searchsorted(row_ends, np.arange(count), side="right")
    good = np.arange(count) + window <= row_ends[row]
    fresh = np.empty(count, dtype=bool)
    fresh[0] = True
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (good[1:] & ~good[:-1])
    first = np.flatnonzero(fresh & good)
    if not len(first):
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, e.astype(np.uint64)
    stop = np.flatnonzero(np.concatenate((good & np.concatenate((fresh[1:] | ~good[1:], [True])),)))
    return grams[anchor[first]], first, stop - first + 1, roll.ranges(first, stop + window, 7)


def ids_of(column: pa.Array) -> np.ndarray:
    """int64 values of an id column, null as 0 (callers drop such rows before)."""
    return np.asarray(column.fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))
