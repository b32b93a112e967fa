"""Texts as arrays of units: code points of a batch in one look and letter case, cut into words or characters at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from sheaf.llm.lookalike import SCANNED, TOP, fold_codes, to_codes

OTHER, LETTER, DIGIT, HAN, END = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def kinds() -> np.ndarray:
    """By code point: part of no word, a letter or its mark, a digit, a Chinese character, or the end of a sentence."""
    kind = np.zeros(TOP, dtype=np.uint8)
    for low, high in SCANNED:
        for code in range(low, high):
            category = unicodedata.category(chr(code))
            kind[code] = DIGIT if category[0] == "N" else LETTER if category[0] in "LM" else OTHER
    kind[0xAC00:0xD7A4] = LETTER
    kind[0x3007] = HAN
    for low, high in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x323B0)):
        kind[low:high] = HAN
    kind[[ord(x) for x in ".!?;\n。！？；"]] = END
    return kind


@lru_cache(maxsize=1)
def inside() -> np.ndarray:
    """By code point: whether it is part of a word."""
    return (kinds() != OTHER) & (kinds() != END)


def scatter(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that sums of them collide only by chance."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: A factor of odd 64-bit numbers that repeats late, and its inverse: words are hashed by their places in the batch, then moved to 0.
FACTOR = 0x5851F42D4C957F2D
UNDO = pow(FACTOR, -1, 1 << 64)


@lru_cache(maxsize=1)
def values() -> np.ndarray:
    """By code point a 64-bit value."""
    return scatter(np.arange(TOP, dtype=np.uint64) + np.uint64(1))


_powers: dict[int, np.ndarray] = {}


def powers(factor: int, n: int) -> np.ndarray:
    """The first n powers of a factor, kept for the next batch."""
    have = _powers.get(factor, np.ones(1, dtype=np.uint64))
    while len(have) < n:  # doubled: the known ones times the next one
        have = np.concatenate([have, have * np.uint64(pow(factor, len(have), 1 << 64))])
    if len(have) <= 1 << 23:  # longer ones serve one long text
        _powers[factor] = have
    return have[:n]


class Units(NamedTuple):
    row: np.ndarray  # the text each unit belongs to
    hash: np.ndarray
    digits: np.ndarray  # whether it is a number
    start: np.ndarray  # its place in codes
    end: np.ndarray
    codes: np.ndarray


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points in one look and case, gaps as wide as they were, and the bounds of rows."""
    return fold_codes(*to_codes(texts), caseless=True, gaps=False)


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of true places within a row."""
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(start, bounds)))


def over(operation: np.ufunc, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """An operation over each stretch; none of them is empty."""
    if not len(start):
        return np.zeros(0, dtype=data.dtype)
    at = np.stack([start, end], 1).ravel()
    return operation.reduceat(data, at[:-1] if at[-1] == len(data) else at)[::2]


def hashed(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch of code points, wherever it stands."""
    return scatter(over(np.add, values()[codes] * powers(FACTOR, len(codes)), start, end) * powers(UNDO, len(codes))[start])


def words_of(codes: np.ndarray, bounds: np.ndarray) -> Units:
    """Runs of letters and digits."""
    start, end, row = runs(inside()[codes], bounds)
    return Units(row, hashed(codes, start, end), over(np.logical_and, kinds()[codes] == DIGIT, start, end), start, end, codes)


def characters_of(codes: np.ndarray, bounds: np.ndarray) -> Units:
    """Single letters, digits and Chinese characters, of texts that have any of the last."""
    kind = kinds()[codes]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    chinese = np.zeros(len(bounds) - 1, dtype=bool)
    chinese[row[kind == HAN]] = True
    at = np.flatnonzero(inside()[codes] & chinese[row])
    return Units(row[at], scatter(codes[at]), kind[at] == DIGIT, at, at + 1, codes)


def reading_units(codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and hash of what a reader knows or not, words of letters and pairs of neighbouring Chinese characters; and how
    many sentences each row has: stretches with a letter or digit between full stops, marks and line ends."""
    kind = kinds()[codes]
    start, end, row = runs(kind == LETTER, bounds)
    made = hashed(codes, start, end)
    chinese = kind == HAN
    if chinese.any():
        both = chinese[:-1] & chinese[1:]
        between = bounds[(bounds > 0) & (bounds < len(codes))]
        both[between - 1] = False
        pair = np.flatnonzero(both)
        row = np.concatenate([row, np.searchsorted(bounds, pair, side="right") - 1])
        made = np.concatenate([made, scatter((codes[pair].astype(np.uint64) << np.uint64(32)) + codes[pair + 1])])
    first, _, of = runs((kind != OTHER) & (kind != END), bounds)
    stretch = np.searchsorted(np.flatnonzero(kind == END), first)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (stretch[1:] != stretch[:-1]) | (of[1:] != of[:-1])
    return row, made, np.bincount(of[new], minlength=len(bounds) - 1)
