"""Hashes of runs of words at every place of a text, and the least of neighbours, for numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _raised(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(2 * n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


class Runs:
    """Hashes of the runs of any length of a text's words, from running sums."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        up, self.down = _raised(self.n + 1)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words.view(np.uint64) * up[: self.n])))

    def at(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return self._mixed((self.sums[start + length] - self.sums[start]) * self.down[start], length)

    def all(self, length: int) -> np.ndarray:
        n = max(0, self.n - length + 1)
        return self._mixed((self.sums[length : length + n] - self.sums[:n]) * self.down[:n], length)

    @staticmethod
    def _mixed(runs: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        runs = (runs ^ np.asarray(length).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (runs ^ (runs >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def least_at(values: np.ndarray, window: int) -> np.ndarray:
    """For each `window` neighbours, the place of their least value, the first of equals."""
    at, width = np.arange(len(values)), 1
    n = len(values) - window + 1

    def of_two(left: slice, right: slice) -> None:
        nonlocal values, at
        first = values[left] <= values[right]
        values, at = np.where(first, values[left], values[right]), np.where(first, at[left], at[right])

    while 2 * width <= window:
        of_two(slice(None, -width), slice(width, None))
        width *= 2
    if width < window:
        of_two(slice(0, n), slice(window - width, window - width + n))
    return at
