"""Content-defined sampling of byte strings: which positions stand for which 100-byte windows."""

from __future__ import annotations

import numpy as np

U = np.uint64
_rng = np.random.default_rng(20240607)
#: One random number for each byte, and two random odd bases.
TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
TABLE2 = _rng.integers(0, 2**64, 256, dtype=np.uint64)
BASE = int(_rng.integers(0, 2**63)) * 2 + 1
BASE2 = int(_rng.integers(0, 2**63)) * 2 + 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-byte string of `data`; k a power of two."""
    h, step, power = TABLE[data], 1, BASE
    while step < k:
        h = h[:-step] * U(power) + h[step:]
        step, power = step * 2, power * power % 2**64
    return mix(h)


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w values the index of its smallest, the leftmost of equals."""
    at = np.arange(len(h), dtype=np.int32)
    value, span = h, 1
    while span < w:
        step = min(span, w - span)
        right = value[step:] < value[: len(value) - step]
        at = np.where(right, at[step:], at[: len(at) - step])
        value = h[at]
        span += step
    return at


class Powers:
    """Powers of a base and of its inverse modulo 2^64, as far as asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


P1, P2 = Powers(BASE), Powers(BASE2)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """Hash of data[start:end] for each pair, by prefix sums; `second` gives one that is independent of the first."""
    table, powers = (TABLE2, P2) if second else (TABLE, P1)
    powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers.up[: len(data)], out=sums[1:], dtype=np.uint64)
    return mix((sums[ends] - sums[starts]) * powers.down[starts] + U(0x9E3779B97F4A7C15) * (ends - starts).astype(np.uint64))
