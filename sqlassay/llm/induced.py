"""External induced suffix sorting of byte strings, with common-prefix values.

The order of all suffixes is induced from that of the suffixes at local minima (LMS), in two
sweeps over a priority queue: smallest first for suffixes greater than their successor, then
largest first for the others. What is popped pushes the suffix one place to the left. Since
pushes arrive in order, the queue is a first-in-first-out list for each first byte; entries
(position, common prefix with the entry before) beyond a memory limit are kept on disk. A
pushed suffix shares with the one pushed before it, under the same byte, one byte more than
the least common prefix seen between the two pops. LMS suffixes are ordered by inducing the
order of the strings between them, naming these, and sorting the string of names, by names
doubled until they span ``depth`` bytes. The text may be a memory-mapped file.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: No UTF-8 text has this byte; it ends every string of a shard.
SEPARATOR = 0xFF
#: Queue entries held in memory before they go to disk.
MEMORY_ENTRIES = 16_000_000
#: Entries popped at once.
BATCH = 1_000_000


class Queue:
    """First-in-first-out lists of (position, common prefix), one for each byte, on disk beyond a limit."""

    def __init__(self, limit: int):
        self.limit, self.held, self.file = limit, 0, None
        self.lists: list[list] = [[] for _ in range(256)]

    def push(self, byte: int, at: np.ndarray, lcp: np.ndarray) -> None:
        self.held += len(at)
        self.lists[byte].append((at, lcp))
        if self.held > self.limit:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for parts in self.lists:
            for k, part in enumerate(parts):
                if isinstance(part[0], np.ndarray):
                    where = self.file.seek(0, 2)
                    self.file.write(part[0].tobytes())
                    self.file.write(part[1].tobytes())
                    parts[k] = (where, len(part[0]), part[0].dtype)
        self.held = 0

    def _load(self, part) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(part[0], np.ndarray):
            return part
        where, n, kind = part
        self.file.seek(where)
        at = np.frombuffer(self.file.read(n * kind.itemsize), kind)
        return at, np.frombuffer(self.file.read(n), np.uint8)

    def pop(self, byte: int, backwards: bool = False):
        """Takes a byte's entries out, in batches, in the order of pushes or against it."""
        parts, self.lists[byte] = self.lists[byte], []
        together, n = [], 0

        def batch():
            some = [self._load(p) for p in (reversed(together) if backwards else together)]
            return some[0] if len(some) == 1 else (np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some]))

        for part in reversed(parts) if backwards else parts:
            size = len(part[0]) if isinstance(part[0], np.ndarray) else part[1]
            if isinstance(part[0], np.ndarray):
                self.held -= size
            if n and n + size > BATCH:
                yield batch()
                together, n = [], 0
            together.append(part)
            n += size
        if together:
            yield batch()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, for comparing (text is padded)."""
    return np.ndarray((len(text) - 7,), np.uint64, text, 0, (1,))[at]


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Length of the common prefix of each pair of suffixes of text[:n], up to ``depth``; text has 8 bytes more."""
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    while len(live):
        x = _words(text, np.minimum(a[live] + out[live], n)) ^ _words(text, np.minimum(b[live] + out[live], n))
        low = x & (~x + np.uint64(1))
        same = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        out[live] += same
        live = live[(same == 8) & (out[live] < depth) & (np.maximum(a[live], b[live]) + out[live] < n)]
    return np.minimum(out, np.minimum(depth, n - np.maximum(a, b)))


def _types(text: np.ndarray, n: int) -> np.ndarray:
    """True where a suffix is smaller than the one after it (S); the last is not."""
    t = text[:n]
    ends = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    rises = np.append(t[ends[:-1] + 1] > t[ends[:-1]], False)
    return np.repeat(rises, np.diff(ends, prepend=-1))


def _pushed(low: np.ndarray, lcp: np.ndarray, to: np.ndarray, seen: np.ndarray, depth: int):
    """For popped entries with common prefixes ``lcp`` that push to bytes ``to`` (-1: none): (byte, which, common prefix).

    low[x]: the least common prefix since the last push to x.
    """
    if not len(lcp):
        return
    least = lcp.min()
    present = np.flatnonzero(np.bincount(to + 1, minlength=257)[1:])
    keep = low.copy()
    np.minimum(low, least, out=low)
    for x in present.tolist():
        which = np.flatnonzero(to == x)
        mins = np.minimum.reduceat(lcp, np.append(0, which[:-1] + 1)) if len(which) > 1 else np.array([lcp[: which[0] + 1].min()], np.uint8)
        if len(which) > 1:  # the last span reaches to the end in reduceat
            mins[-1] = lcp[which[-2] + 1 : which[-1] + 1].min()
        mins = mins.astype(np.int64)
        mins[0] = min(mins[0], int(keep[x])) + 1 if seen[x] else 0
        mins[1:] += 1
        seen[x] = True
        rest = lcp[which[-1] + 1 :]
        low[x] = rest.min() if len(rest) else 255
        yield x, which, np.minimum(mins, depth).astype(np.uint8)


def _induce(text: np.ndarray, n: int, kind: np.ndarray, seeds: list, depth: int, limit: int, visit) -> None:
    """Induce the order of all suffixes from ``seeds`` (per byte: positions and common prefixes, in order).

    visit(positions, common prefixes with the suffix visited before, is S) is called for all
    suffixes, largest first.
    """
    unit = np.uint32 if n < 2**32 else np.int64
    rising, falling = Queue(limit), Queue(limit)
    done = Queue(limit)
    low, seen = np.full(256, 255, np.uint8), np.zeros(256, bool)

    def left(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        before = at.astype(np.int64) - 1
        return before, np.where(before >= 0, text[np.maximum(before, 0)], 0).astype(np.int64)

    def border(a: int, b: int) -> int:
        return int(common_prefix(text, np.array([a]), np.array([b]), n, depth)[0])

    def grow(at: np.ndarray, lcp: np.ndarray, byte: int, own: bool) -> None:
        before, to = left(at)
        ok = (before >= 0) & ((to >= byte) if own else (to > byte))
        for x, which, l in _pushed(low, lcp, np.where(ok, to, -1), seen, depth):
            rising.push(x, before[which].astype(unit), l)

    # the end of the text is smaller than all: it pushes the last suffix first
    rising.push(int(text[n - 1]), np.array([n - 1], unit), np.zeros(1, np.uint8))
    seen[text[n - 1]] = True
    for byte in range(256):
        last = -1
        while rising.lists[byte]:
            for at, lcp in rising.pop(byte):
                for k in range(0, len(at), BATCH):
                    done.push(byte, at[k : k + BATCH], lcp[k : k + BATCH])
                    grow(at[k : k + BATCH], lcp[k : k + BATCH], byte, True)
                last = int(at[-1])
        at, lcp = seeds[byte]
        if len(at):
            lcp = lcp.copy()
            lcp[0] = border(last, int(at[0])) if last >= 0 else 0
            for k in range(0, len(at), BATCH):
                grow(at[k : k + BATCH], lcp[k : k + BATCH], byte, False)
    low[:], seen[:] = 255, False

    def shrink(at: np.ndarray, lcp: np.ndarray, byte: int, own: bool) -> None:
        before, to = left(at)
        ok = (before >= 0) & ((to <= byte) if own else (to < byte))
        for x, which, l in _pushed(low, lcp, np.where(ok, to, -1), seen, depth):
            falling.push(x, before[which].astype(unit), l)

    for byte in range(255, -1, -1):
        last = -1
        while falling.lists[byte]:
            for at, lcp in falling.pop(byte):
                for k in range(0, len(at), BATCH):
                    visit(at[k : k + BATCH], lcp[k : k + BATCH], True)
                    shrink(at[k : k + BATCH], lcp[k : k + BATCH], byte, True)
                last = int(at[-1])
        after = 0
        for at, lcp in done.pop(byte, backwards=True):
            at = at[::-1]
            # a value there is shared with the smaller neighbour; here with the larger one
            link = np.empty(len(at), np.uint8)
            link[1:] = lcp[::-1][:-1]
            link[0] = after if after >= 0 and last < 0 else (border(last, int(at[0])) if last >= 0 else 0)
            last, after = -1, int(lcp[0])
            visit(at, link, False)
            shrink(at, link, byte, False)
    for q in (rising, falling, done):
        q.close()


def _per_byte(text: np.ndarray, at: np.ndarray, lcp: np.ndarray) -> list:
    """Sorted or unsorted suffixes as seeds for each first byte, order kept."""
    first = text[at]
    order = np.argsort(first, kind="stable")
    cuts = np.searchsorted(first[order], np.arange(257))
    return [(at[order[cuts[b] : cuts[b + 1]]], lcp[order[cuts[b] : cuts[b + 1]]]) for b in range(256)]


def _lms_order(text: np.ndarray, n: int, kind: np.ndarray, depth: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS positions in the order of their suffixes' first ``depth`` bytes, and common prefixes with the one before."""
    lms = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    none = np.zeros(len(lms), np.uint8)
    if len(lms) < 2:
        return lms, none
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    found: list[np.ndarray] = []

    def visit(at, lcp, small):
        if small:
            found.append(at[is_lms[at]].astype(np.int64))

    _induce(text, n, kind, _per_byte(text, lms, none), 1, limit, visit)
    order = np.concatenate(found)[::-1]
    # name the strings from one LMS position to the next, both included
    place = np.searchsorted(lms, order)
    span = np.diff(np.append(lms, n)) + 1
    size = span[place]
    shared = common_prefix(text, order[1:], order[:-1], n, depth)
    cap = np.minimum(size[1:], depth)
    same = (np.minimum(size[1:], depth) == np.minimum(size[:-1], depth)) & (shared >= cap)
    rank = np.empty(len(lms), np.int64)
    rank[place] = np.concatenate([[0], np.cumsum(~same)])
    # the string of names: double them until they tell all apart or span the depth
    step, m = 1, len(lms)
    while rank.max() + 1 < m and step < depth:
        nxt = np.zeros(m, np.int64)
        nxt[: max(0, m - step)] = rank[step:] + 1
        key = rank * (m + 1) + nxt
        order = np.argsort(key, kind="stable")
        rank = np.empty(m, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        step *= 2
    at = lms[np.argsort(rank, kind="stable")]
    lcp = np.zeros(m, np.uint8)
    lcp[1:] = common_prefix(text, at[1:], at[:-1], n, depth)
    return at, lcp


def repeated(text: np.ndarray, n: int, depth: int, limit: int = MEMORY_ENTRIES) -> np.ndarray:
    """True for each position of text[:n] whose ``depth`` bytes (at most 254, none cut off) start elsewhere too.

    ``text`` must have 8 bytes more than n.
    """
    out = np.zeros(n, bool)
    if n < depth:
        return out
    kind = _types(text, n)
    at, lcp = _lms_order(text, n, kind, depth, limit)
    before = [-1]

    def visit(at, lcp, small):
        near = np.flatnonzero(lcp >= depth)
        out[at[near]] = True
        out[at[near[near > 0] - 1]] = True
        if len(near) and near[0] == 0 and before[0] >= 0:
            out[before[0]] = True
        before[0] = int(at[-1])

    _induce(text, n, kind, _per_byte(text, at, lcp), depth, limit, visit)
    return out
