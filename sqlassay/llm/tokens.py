"""Token ids of whole texts, exactly as the public tokenizer gives them, from a cache of words."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np

from .words import hash_lanes, word_lanes, word_spans

#: Words kept from one batch to the next, at about 45 bytes each; beyond that all are forgotten.
CACHE_WORDS = 1_500_000
#: Bytes of text taken at once.
BLOCK_BYTES = 1_000_000
#: White space between words, for cutting a very long text.
_GAP = re.compile(r"[\x20\x09-\x0D]")

_PLAIN = re.compile(rb"[\x21-\x7e]+")
#: Fixed value: how this tokenizer splits a lower-cased ASCII word.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_encoders: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class WordEncoder:
    """Encodes texts by a word-level tokenizer whose ids do not depend on white space or on the case of A-Z.

    Such a tokenizer gives a text the ids of its words in turn, so each distinct word is
    encoded once. Words are looked up by 64-bit hashes, for a whole batch in numpy, and what is
    found is compared with the word, byte for byte; should two words share a hash, their texts
    go to the tokenizer as they are. Unknown words are encoded many at a time as one text and
    told apart by the tokens that end a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocab = self.tokenizer.get_vocab()
        self.vocab_size = max(vocab.values()) + 1
        self.unit = np.uint16 if self.vocab_size <= 65536 else np.uint32
        self.ends = np.zeros(self.vocab_size, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        # sorted runs of (hashes, first id, number of ids, first lane, bytes); ids and lanes (see words) lie in one array each
        self.runs: list[tuple[np.ndarray, ...]] = []
        self.ids = np.zeros(1 << 16, self.unit)
        self.lanes = np.zeros(1 << 16, np.uint64)
        self.used = self.used_lanes = 0

    def _one_by_one(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), self.unit), np.array([len(x) for x in found], np.int64)

    def _together(self, words: list[bytes], pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = np.array(self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, self.unit)
        ends, want = np.flatnonzero(self.ends[flat]), np.cumsum(pieces)
        if len(ends) != want[-1] or ends[-1] != len(flat) - 1:
            return self._one_by_one(words)
        return flat, np.diff(ends[want - 1], prepend=-1)

    def _learn(self, hashes: np.ndarray, words: list[bytes], lanes: np.ndarray, size: np.ndarray) -> None:
        """Add words (each once) under their hashes; ``lanes`` are those of all words in turn."""
        plain, pieces, odd = [], [], []
        for k, w in enumerate(words):
            if _PLAIN.fullmatch(w):
                low = w.lower()
                plain.append(k)
                pieces.append(1 if low.isalpha() else len(_PIECES.findall(low.decode())))
            elif w.decode().isalpha():
                plain.append(k)
                pieces.append(1)
            else:
                odd.append(k)
        many, order, parts = np.array(pieces, np.int64), [], []
        for k in range(0, len(plain), 2000):
            order += plain[k : k + 2000]
            parts.append(self._together([words[i] for i in plain[k : k + 2000]], many[k : k + 2000]))
        if odd:
            order += odd
            parts.append(self._one_by_one([words[i] for i in odd]))
        flat, counts = (np.concatenate(x) for x in zip(*parts))
        self.ids = _with_room(self.ids, self.used, len(flat))
        self.lanes = _with_room(self.lanes, self.used_lanes, len(lanes))
        self.ids[self.used : self.used + len(flat)] = flat
        self.lanes[self.used_lanes : self.used_lanes + len(lanes)] = lanes
        many = (size + 7) >> 3
        rest = self.used + np.cumsum(counts) - counts, counts, (self.used_lanes + np.cumsum(many) - many)[order], size[order]
        run = hashes[order], *(x.astype(np.uint32) for x in rest)
        self.used += len(flat)
        self.used_lanes += len(lanes)
        by = np.argsort(run[0])
        self.runs.append(tuple(x[by] for x in run))
        if len(self.runs) > 6:
            by = np.argsort(np.concatenate([r[0] for r in self.runs]))
            # column by column: no second copy of all of them
            self.runs = [tuple(np.concatenate([r[k] for r in self.runs])[by] for k in range(len(run)))]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """First id, number of ids, first lane and bytes of each hash; first id -1 where it is unknown."""
        found = np.full(len(h), -1, np.int64), *(np.zeros(len(h), np.int64) for _ in range(3))
        for names, *values in self.runs:
            k = np.minimum(np.searchsorted(names, h), len(names) - 1)
            hit = names[k] == h
            for column, value in zip(found, values):
                column[hit] = value[k[hit]]
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and how many belong to each text; a very long one is taken piece by piece."""
        if len(texts) != 1 or len(texts[0]) <= 2 * BLOCK_BYTES:
            return self._encode(texts)
        found = [self._encode([x])[0] for x in pieces(texts[0], BLOCK_BYTES)]
        return np.concatenate(found), np.array([sum(map(len, found))], np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if sum(len(r[0]) for r in self.runs) > CACHE_WORDS:
            self._clear()
        data, first, size, per = word_spans([t.encode() for t in texts])
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        lanes, begin, many = word_lanes(data, first, size)
        h, at, index = np.unique(hash_lanes(lanes, begin, many, size), return_index=True, return_inverse=True)
        if not _same(lanes, begin, size, lanes, begin[at[index]], size[at[index]]):
            return self._whole(texts)
        start, count, lane, length = self._find(h)
        known, new = np.flatnonzero(start >= 0), np.flatnonzero(start < 0)
        if not _same(lanes, begin[at[known]], size[at[known]], self.lanes, lane[known], length[known]):
            return self._whole(texts)
        if len(new):
            a, n, raw = first[at[new]], size[at[new]], data.tobytes()
            self._learn(h[new], [raw[x : x + y] for x, y in zip(a.tolist(), n.tolist())], lanes[_runs(begin[at[new]], many[at[new]])], n)
            start[new], count[new], _, _ = self._find(h[new])
        lens = count[index]
        flat = self.ids[_runs(start[index], lens)].astype(np.uint32)
        return flat, np.diff(np.concatenate([[0], np.cumsum(lens)])[np.cumsum(per)], prepend=0)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.uint32), np.array([len(x) for x in found], np.int64)


def _with_room(x: np.ndarray, used: int, more: int) -> np.ndarray:
    """``x``, or a larger array that begins with its ``used`` values; pages of it that nothing was written to take no memory."""
    if used + more <= len(x):
        return x
    larger = np.zeros(max(2 * len(x), used + more), x.dtype)
    larger[:used] = x[:used]
    return larger


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each, ``many`` of them."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))


def _same(x: np.ndarray, at: np.ndarray, size: np.ndarray, y: np.ndarray, where: np.ndarray, length: np.ndarray) -> bool:
    """Whether all words, ``size`` bytes from lane ``at`` of x, are those of ``length`` bytes from lane ``where`` of y."""
    if not np.array_equal(size, length):
        return False
    many = (size + 7) >> 3
    return np.array_equal(x[_runs(at, many)], y[_runs(where, many)])


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def release(words: bool = True) -> None:
    """Give memory of earlier work back to the system: Python workers outlive stages, and so would their caches.

    What Arrow and the C library keep of freed batches goes back as well; encoders stay, if not ``words``.
    """
    import pyarrow as pa

    if words:
        _encoders.clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def pieces(text: str, limit: int) -> Iterator[str]:
    """A text cut at white space into pieces of at least ``limit`` characters, the last one aside; words stay whole."""
    a = 0
    while a < len(text):
        gap = _GAP.search(text, min(a + limit, len(text)))
        b = gap.start() if gap else len(text)
        yield text[a:b]
        a = b


def text_blocks(batch, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, list[str]]]:
    """Runs [a, b) of an Arrow batch's rows with about ``limit`` bytes of text, and these texts; null is empty."""
    import pyarrow.compute as pc

    column = batch.column("text")
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).tolist()
    a = held = 0
    for b, n in enumerate(size):
        if held and held + n > limit:
            yield a, b, [t or "" for t in column.slice(a, b - a).to_pylist()]
            a, held = b, 0
        held += n
    if a < len(size):
        yield a, len(size), [t or "" for t in column.slice(a).to_pylist()]


def blocks(texts: list, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with about ``limit`` characters; a longer text is a run of its own."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t)
    if a < len(texts):
        yield a, len(texts)
