"""Rolling fingerprints of texts: content-defined positions, so that equal spans carry equal fingerprints."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOW = np.uint64(0xFFFFFF)
#: Positions worked on at once; a long text is taken in overlapping segments, which changes nothing in the result.
SEGMENT = 1 << 16


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, np.uint64)]), dtype=np.uint64)
        down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE, np.uint64)]), dtype=np.uint64)
    return up, down


def window_hashes(points: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` code points; ``points`` is at most about SEGMENT long."""
    n = len(points) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(17, len(points).bit_length()))
    with np.errstate(over="ignore"):
        c = _mixed((points.astype(np.uint64) + np.uint64(1 + 0x10000000 * salt)) * np.uint64(0xD6E8FEB86659FD93))
        sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(c * up[: len(points)], out=sums[1:])
        return _mixed((sums[width:] - sums[:-width]) * down[:n])


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """For each window of hashes the place of the least one, of equal ones the last; by blocks, in three passes."""
    m = len(h)
    key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
    padded = np.full(-(-m // window) * window, np.iinfo(np.uint64).max, np.uint64)
    padded[:m] = key
    grid = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (_LOW - (np.minimum(behind[: m - window + 1], ahead[window - 1 : m]) & _LOW)).astype(np.int64)


def chosen(points: np.ndarray, gram: int, window: int, wanted: np.ndarray) -> np.ndarray:
    """The starts of the windows of gram + window - 1 code points whose fingerprint is one of the sorted hashes wanted."""
    n, out = len(points) - gram + 1, []
    for start in range(0, n - window + 1, SEGMENT):
        h = window_hashes(points[start : min(start + SEGMENT + window - 1, n) + gram - 1], gram)
        at = _least(h, window)
        keep = np.unique(at)
        keep = keep[np.isin(h[keep], wanted)]
        out.append(np.flatnonzero(np.isin(at, keep)) + start)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def fingerprints(points: np.ndarray, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are the least of some ``window`` consecutive grams (of equal ones the last).

    Any span of gram + window - 1 code points holds a fingerprint, and the choice depends on nothing outside the span, so two
    texts that share the span share the fingerprint. Texts shorter than that have none."""
    n = len(points) - gram + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    where, what = [], []
    for start in range(0, n - window + 1, SEGMENT):
        h = window_hashes(points[start : min(start + SEGMENT + window - 1, n) + gram - 1], gram)
        least = _least(h, window)
        at = np.unique(least[np.concatenate([[True], least[1:] != least[:-1]])])
        where.append(at + start)
        what.append(h[at])
    where, what = np.concatenate(where), np.concatenate(what)
    first = np.concatenate([[True], where[1:] > np.maximum.accumulate(where)[:-1]]) if len(where) else np.empty(0, bool)
    return where[first], what[first]
