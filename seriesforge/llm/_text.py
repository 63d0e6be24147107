"""Vectorised work on a batch of texts: bytes, words, and polynomial hashes of windows of either.

All arithmetic is modulo 2^64. A window of units u[i..i+k) has the hash sum(u[i+j] * R^j), taken from one running
sum over the batch, so every window costs a few array operations whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Two odd multipliers with known inverses give two independent hashes.
ROOTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """root^0 .. root^(n-1)."""
    have = _POWERS.get(root)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        p = np.full(size, U(root))
        p[0] = 1
        have = np.cumprod(p, dtype=U)
        if size <= 1 << 21 | 1 << 10:  # what the groups need; a rare huge text doesn't stay in memory
            _POWERS[root] = have
    return have[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Final mixing, so that order and low bits are as good as random."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class Sums:
    """Running sums over units, from which any span's hash follows."""

    def __init__(self, units: np.ndarray, root: int):
        n = len(units)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(units.astype(U) * powers(pow(root, -1, 1 << 64), n), out=self.sums[1:])
        self.powers = powers(root, n + 1)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of units[starts:ends] for each span: depends on the units and the length alone."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.powers[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hash of every window of ``width`` units (at least one window must fit)."""
        n = len(self.sums) - 1 - width + 1
        return mixed((self.sums[width:] - self.sums[:n]) * self.powers[:n] + U(width * 0xD6E8FEB86659FD93 % (1 << 64)))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column end to end, and the offsets of its texts (null: empty)."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges of texts of up to ``most`` bytes together; a longer text is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def visible(raw: np.ndarray) -> np.ndarray:
    """The bytes that aren't white space."""
    return raw[~_SPACE[raw]]


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in the bytes, and the first word of each text (with the end)."""
    inside = ~_SPACE[raw]
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    start[cut] |= inside[cut]
    end[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets, side="left")


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, root: int, block: int = 1 << 21) -> np.ndarray:
    """Hash of each word, worked out over about ``block`` bytes at a time."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, side="right")))
        at = starts[i]
        out[i:j] = Sums(raw[at:ends[j - 1]], root).spans(starts[i:j] - at, ends[i:j] - at)
        i = j
    return out


def window_min(values: np.ndarray, width: int, block: int = 1 << 23) -> np.ndarray:
    """For each i the position of a least one of values[i:i+width], by its upper 40 bits, the first if several are.

    Position and value share one number, so that one minimum a step finds both; equal windows choose alike."""
    n = len(values) - width + 1
    out = np.empty(max(0, n), np.int64)
    for at in range(0, max(0, n), block):
        part = values[at:at + block + width - 1]
        best, have = part & ~U((1 << 24) - 1) | np.arange(len(part), dtype=U), 1
        while have * 2 <= width:
            best, have = np.minimum(best[:-have], best[have:]), have * 2
        if have < width:
            best = np.minimum(best[:have - width], best[width - have:])
        out[at:at + block] = (best & U((1 << 24) - 1)).astype(np.int64) + at
    return out
