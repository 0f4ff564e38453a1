"""Hashes of byte spans, computed for a whole batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 19  # bytes of text handled at once
P = np.uint64(0x9E3779B97F4A7C15)
Q = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def scaled(n: int, by: int = 0x9E3779B97F4A7C15) -> np.uint64:
    return np.uint64(n * by & 0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of P and of its inverse, modulo 2^64; those of a usual chunk are kept."""
    if n > 2 * CHUNK:
        return tuple(_powers(n, base) for base in (P, Q))
    if not _POWERS:
        _POWERS.update(p=_powers(2 * CHUNK, P), q=_powers(2 * CHUNK, Q))
    return _POWERS["p"][:n], _POWERS["q"][:n]


def _powers(n: int, base: np.uint64) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), from one running sum."""
    p, q = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=total[1:])
    return mixed((total[ends] - total[starts]) * q[starts])


def chunks(norms: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes; a longer text stands alone."""
    first, size = 0, 0
    for k, t in enumerate(norms):
        if size and size + len(t) > CHUNK:
            yield first, k
            first, size = k, 0
        size += len(t)
    if norms:
        yield first, len(norms)
