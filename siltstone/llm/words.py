"""Words and word hashes shared by the operators on word runs."""

from __future__ import annotations

import re

import numpy as np

#: A word is a maximal run of letters and digits of the lower-cased text.
WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of that many codes in a row, by start."""
    if len(codes) < length:
        return np.empty(0, np.uint64)
    n = len(codes) - length + 1
    h = np.zeros(n, np.uint64)
    for k in range(length):
        h = mix(h + _MIX + codes[k : k + n])
    return h
