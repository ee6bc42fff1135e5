"""Content-defined runs of byte windows.

Every window of `size` bytes has a minimizer: the least hash of the ANCHOR-byte strings inside it. Neighbouring windows with
one minimizer make a run, and equal windows always lie in runs with the same minimizer, so windows can be compared minimizer
by minimizer. A run of n windows is held as n + size - 1 bytes, and its content has a 64-bit hash of its own (XXH64 of the bytes;
the polynomial sums only order the anchors). Each level orders the anchors anew, so windows that meet on one level by a frequent
anchor part on the next.
"""

from __future__ import annotations

import numpy as np
from xxhash import xxh64_intdigest

ANCHOR = 24
#: Windows that a run has at most, and bytes of a text that are hashed at a time.
RUN_WINDOWS = 512
CHUNK = 4 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A 64-bit value for each byte.
BYTE_VALUES = _mix((np.arange(256, dtype=np.uint64) + _U(1)) * _BASE)
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                full = np.full(max(n, 1 << 16), base, dtype=np.uint64)
                full[0] = 1
                _POWERS[name] = np.multiply.accumulate(full)
    return _POWERS["up"][:n], _POWERS["down"][:n]


class Hashes:
    """Polynomial prefix sums of a byte string, for the hashes of all its slices of one size."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.empty(len(data) + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(BYTE_VALUES[data] * up[:-1], out=self.sums[1:])

    def all(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return _mix((self.sums[size:] - self.sums[:n]) * self.down[:n] + _U(size))

    def slices(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The hash of the slice [first, last) for each pair."""
        return _mix((self.sums[last] - self.sums[first]) * self.down[first] + (last - first).astype(np.uint64))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    full = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[: len(x)] = x
    grid = full.reshape(blocks, width)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], front[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, level: int) -> np.ndarray:
    """The hash of every ANCHOR-byte string, in the order of a level."""
    grams = Hashes(data).all(ANCHOR)
    return _mix(grams ^ (_U(level) * _BASE)) if level else grams


def runs(data: bytes, size: int, level: int = 0) -> tuple[np.ndarray, ...]:
    """(minimizer, content hash, first window, windows, times it holds its minimizer, where first) of every run of a byte
    string; the last counts bytes from the run's start."""
    out: list[tuple] = []
    view = memoryview(data)
    whole = np.frombuffer(data, dtype=np.uint8)
    width = size - ANCHOR + 1
    for begin in range(0, len(whole) - size + 1, CHUNK):
        part = whole[begin : begin + CHUNK + size - 1]
        grams = anchors(part, level)
        least = sliding_least(grams, width)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        length = np.diff(np.r_[first, len(least)])
        if (length > RUN_WINDOWS).any():  # a long run is cut, as often as it must be
            pieces = -(-length // RUN_WINDOWS)
            inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            stop = np.repeat(first + length, pieces)
            first = np.repeat(first, pieces) + inner * RUN_WINDOWS
            length = np.minimum(stop - first, RUN_WINDOWS)
        m = least[first]
        at = [np.flatnonzero(grams[a : a + n + width - 1] == v) for a, n, v in zip(first.tolist(), length.tolist(), m)]
        first += begin
        content = np.array([xxh64_intdigest(view[a : a + n + size - 1]) for a, n in zip(first.tolist(), length.tolist())], dtype=np.uint64)
        out.append((m, content, first, length, np.array([len(x) for x in at]), np.array([x[0] for x in at])))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))
