"""Words of whole texts as 64-bit hashes, many texts at once, in numpy."""

from __future__ import annotations

import re

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the first 0 to 8 bytes of a lane.
_FILLED = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a very long text that are taken at once.
PIECE = 1_000_000
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, _STEP, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts, each word's first byte and length, and the number of words of each text."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = _LOWER[joined]
    in_word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(in_word, prepend=False, append=False))
    first, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    per = np.diff(np.searchsorted(first, ends), prepend=0)
    return data, first, end - first, per


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of all texts in turn, and the number of words of each text.

    Words are runs of anything but ASCII white space; A-Z count as a-z.
    """
    if len(texts) == 1 and len(texts[0]) > 2 * PIECE:  # a very long text is taken piece by piece
        found = [hash_spans(*word_spans([x])[:3]) for x in _pieces(texts[0])]
        return np.concatenate(found), np.array([sum(map(len, found))], np.int64)
    data, first, size, per = word_spans(texts)
    return hash_spans(data, first, size), per


def _pieces(text: bytes):
    a = 0
    while a < len(text):
        gap = _GAP.search(text, min(a + PIECE, len(text)))
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def word_lanes(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of every word as 64-bit lanes (the last one filled up with zeros), each word's first lane and number of lanes."""
    many = (size + 7) >> 3
    start = np.cumsum(many) - many
    if not len(first):
        return np.zeros(0, np.uint64), start, many
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at_byte = np.ndarray(len(data), "<u8", padded.data, strides=(1,))
    place = 8 * (np.arange(int(many.sum())) - np.repeat(start, many))
    return at_byte[np.repeat(first, many) + place] & _FILLED[np.minimum(np.repeat(size, many) - place, 8)], start, many


def hash_lanes(lanes: np.ndarray, start: np.ndarray, many: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of every word. Each lane is mixed with its place on its own before lanes are added, so no arrangement of bytes cancels out."""
    if not len(start):
        return np.zeros(0, np.uint64)
    salt = mix64(np.arange(1, int(many.max()) + 1).astype(np.uint64) * _STEP)
    terms = mix64(lanes ^ salt[np.arange(len(lanes)) - np.repeat(start, many)])
    return mix64(np.add.reduceat(terms, start) + size.astype(np.uint64) * _STEP)


def hash_spans(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return hash_lanes(*word_lanes(data, first, size), size)


def shingle_hashes(words: np.ndarray, per: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words, and their number in each text; a shorter text's words are one run."""
    total = len(words)
    h = np.zeros(total, np.uint64)
    p = _powers(n + 1)
    starts = np.cumsum(per) - per
    for k in range(n):
        if total > k:
            h[: total - k] += words[k:] * p[k]
    short = (per > 0) & (per < n)
    many = np.where(per >= n, per - n + 1, short.astype(np.int64))
    at = np.repeat(starts, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    out = mix64(h[at] + np.uint64(n))
    where = np.cumsum(many) - many
    for k in np.flatnonzero(short):
        w = words[starts[k] : starts[k] + per[k]]
        out[where[k]] = mix64(((w * p[: len(w)]).sum(dtype=np.uint64) + np.uint64(len(w))).reshape(1))[0]
    return out, many
