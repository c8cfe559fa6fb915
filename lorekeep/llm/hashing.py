"""64-bit hashes of words and byte windows for whole texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as a text has needed them."""

    def __init__(self) -> None:
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", _BASE), ("down", self.inverse)):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs between ASCII white space."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    steps = np.diff(inside)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span, from one pass over ``data``."""
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mix64(hashes + (ends - starts).astype(np.uint64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """``span_hashes`` of all runs of ``width`` bytes, in order."""
    n = max(0, len(data) - width + 1)
    up, down = _POWERS.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix64((sums[width:] - sums[:n]) * down[:n] + np.uint64(width))


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words with A-Z in lower case, in order; fewer words make one run."""
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    starts, ends = word_bounds(data)
    words = span_hashes(data, starts, ends)
    n = min(n, len(words))
    if not n:
        return np.empty(0, np.uint64)
    joined = np.full(len(words) - n + 1, n, np.uint64)
    for at in range(n):
        joined = joined * np.uint64(0xD6E8FEB86659FD93) + words[at : at + len(joined)]
    return mix64(joined)
