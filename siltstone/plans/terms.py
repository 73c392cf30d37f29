"""Asked terms in texts, as index_tokens() would cut them: the JVM makes letters small, all else is done on arrays of code points, without a string for each term."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
from pyspark.sql import SparkSession

from siltstone.functions.text import CJK, INDEX_TOKEN, MARKED, PLAIN

#: Code points of the marks that are taken out of texts before these are cut.
MARKS = (0x300, 0x370)
#: Characters of texts that are cut into terms at once (but for a text of more).
SLICE = 500_000


@cache
def letters(spark: SparkSession) -> list[tuple[int, int]]:
    """First and last code points of the runs of characters of which terms are made, as the JVM's pattern has them."""
    every = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
    others = spark.sparkContext._jvm.java.util.regex.Pattern.compile(INDEX_TOKEN).matcher(every.tobytes().decode("utf-32-le")).replaceAll("")
    own = np.setdiff1d(every, np.frombuffer(others.encode("utf-32-le"), np.uint32)).astype(np.int64)
    ends = np.flatnonzero(np.diff(own) > 1)
    return list(zip(own[np.append(0, ends + 1)].tolist(), own[np.append(ends, len(own) - 1)].tolist()))


def pairs(*texts: list[str]) -> list[str]:
    """The pairs of CJK characters of each row's texts, as chunk_ngrams() gives them; small letters have the same pairs."""
    runs = [tuple(int(x, 16) for x in m) for m in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", CJK)]
    # a line end before and after each text
    points = np.frombuffer("".join(f"\n{t}\n" for row in zip(*texts) for t in row).encode("utf-32-le"), np.uint32)
    own = reduce(np.logical_or, [(points >= begin) & (points <= end) for begin, end in runs])
    at = np.flatnonzero(own[1:] & own[:-1])
    listed = np.stack([points[at], points[at + 1], np.full(len(at), ord(" "), np.uint32)], axis=1).tobytes().decode("utf-32-le")
    ends = np.cumsum([0, *(sum(len(t) + 2 for t in row) for row in zip(*texts))])
    bounds = (3 * np.searchsorted(at, ends)).tolist()
    return [listed[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]


class Terms:
    """Finds terms by a hash of each run of letters; what has the hash of a term is compared with it in full."""

    def __init__(self, terms: list[str], runs: list[tuple[int, int]]):
        # the letter of each code point, without its mark; 0 where it is none
        self.letter = np.zeros(0x110000, np.uint64)
        for begin, end in runs:
            self.letter[begin : end + 1] = np.arange(begin, end + 1)
        self.letter[[ord(c) for c in MARKED]] = [ord(c) for c in PLAIN]
        codes = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64) for t in terms]
        self.base = 0x9E3779B97F4A7C15
        while True:
            self._powers(max(map(len, codes), default=0))
            hashes = np.array([(c * self.power[: len(c)]).sum(dtype=np.uint64) for c in codes], np.uint64)
            if len(np.unique(hashes)) == len(codes):
                break
            self.base += 2
        self.code = np.argsort(hashes)
        self.hashes = hashes[self.code]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> np.uint64(48)).astype(np.int64)] = True
        # the terms one after another, with 0 behind each
        self.begin = np.cumsum([0, *(len(c) + 1 for c in codes)])[:-1]
        self.text = np.concatenate([np.append(c, np.uint64(0)) for c in codes]) if codes else np.zeros(0, np.uint64)

    def _powers(self, n: int) -> None:
        """The first n powers of the base, and of its inverse, of 64 bits."""
        powers = lambda b: np.cumprod(np.append(np.uint64(1), np.full(max(n, 2 * SLICE), b % (1 << 64), np.uint64)), dtype=np.uint64)
        self.power, self.inverse = powers(self.base), powers(pow(self.base, -1, 1 << 64))

    def standing(self, texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, how many terms the texts of a slice have; text, place among its terms and code of each asked one, in order)."""
        begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
        bounds = np.unique(np.append(np.searchsorted(begin[:-1], np.arange(0, begin[-1], SLICE)), len(texts)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            # a line end before, between and after the texts
            points = np.frombuffer("\n".join(["", *texts[a:b], ""]).encode("utf-32-le"), np.uint32)
            begins = begin[a : b + 1] - begin[a] + 1
            marks = (points - np.uint32(MARKS[0])) < MARKS[1] - MARKS[0]
            if marks.any():
                begins = (np.arange(len(points) + 1) - np.append(0, np.cumsum(marks)))[begins]
                points = points[~marks]
            yield a, *self._standing(self.letter[points], begins)

    def _standing(self, letter: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        if len(letter) > len(self.power):
            self._powers(len(letter))
        inside = letter != 0
        at = np.flatnonzero(inside[1:] > inside[:-1]) + 1
        first = np.searchsorted(at, begins)
        if not len(at) or not len(self.hashes):
            return np.diff(first), *[np.zeros(0, np.int64)] * 3
        hashes = np.add.reduceat(letter * self.power[: len(letter)], at) * self.inverse[at]
        place = np.flatnonzero(self.maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.hashes, hashes[place]), len(self.hashes) - 1)
        met = self.hashes[k] == hashes[place]
        place, code = place[met], self.code[k[met]]
        live, depth = np.arange(len(place)), 0
        equal = np.full(len(place), True)
        while len(live):
            want = self.text[self.begin[code[live]] + depth]
            same = letter[at[place[live]] + depth] == want
            equal[live[~same]] = False
            live, depth = live[same & (want != 0)], depth + 1
        place, code = place[equal], code[equal]
        text = np.searchsorted(first, place, "right") - 1
        return np.diff(first), text, place - first[text], code
