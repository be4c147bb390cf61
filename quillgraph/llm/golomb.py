"""Golomb-Rice coding of sorted distinct integers, vectorized with numpy."""

from __future__ import annotations

import math

import numpy as np


def encode(values: np.ndarray, limit: int) -> tuple[int, bytes, bytes]:
    """(remainder bits, quotients in unary, remainders) of the gaps of sorted values below limit."""
    n = len(values)
    if not n:
        return 0, b"", b""
    gaps = np.diff(values, prepend=0)
    bits = max(0, int(math.log2(max(1.0, 0.69 * limit / n))))
    quotients = gaps >> bits
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(bits - 1, -1, -1)) & 1).astype(np.uint8).ravel()
    return bits, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def decode(n: int, bits: int, unary: bytes, rest: bytes) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int64)
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)))[:n]
    quotients = np.diff(ends, prepend=-1) - 1
    low = np.unpackbits(np.frombuffer(rest, np.uint8))[: n * bits].reshape(n, bits).astype(np.int64)
    return np.cumsum((quotients << bits) + low @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64)))
