"""Hashed n-grams of character codes, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Characters handled at a time, which bounds the memory that a long text takes.
PIECE = 1_000_000

_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def uppers() -> np.ndarray:
    return np.fromiter((chr(c).isupper() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def digits() -> np.ndarray:
    return np.fromiter((chr(c).isdigit() for c in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def spaces() -> np.ndarray:
    return np.fromiter((chr(c).isspace() for c in range(0x110000)), dtype=bool, count=0x110000)


def hashed(values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """A ``bits``-bit hash of the n values from each position; the last n - 1 positions have none."""
    if len(values) < n:
        return np.empty(0, dtype=np.int64)
    h = np.full(len(values) - n + 1, n, dtype=np.uint32)
    for i in range(n):
        h = (h ^ values[i : len(values) - n + 1 + i]) * _ODD[i % 4]
        h ^= h >> np.uint32(15)
    return (h * _ODD[0] >> np.uint32(32 - bits)).astype(np.int64)
