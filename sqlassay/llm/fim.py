"""Fill-in-the-middle: texts cut at two unit boundaries and put in another order between sentinels.

A unit is white space, if any, with the word after it; white space at the end of a text is a
unit too. One Aho-Corasick automaton finds all ASCII white space and all sentinels in a pass.
Between two neighbouring white-space events lies one unit or none, whatever their distance, so
units are counted, and the k-th is found, from the events alone.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .tokens import release, text_blocks

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The white space that ends a word.
SPACE = " \t\n\x0b\x0c\r"
#: Events that are looked at together.
EVENTS = 1 << 16
#: Bytes of text in one batch of results.
BLOCK = 4_000_000
COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


def automaton(sentinels: tuple[str, ...] = (PREFIX, SUFFIX, MIDDLE)) -> ahocorasick.Automaton:
    """Finds white space (value 0) and sentinels (value 1)."""
    found = ahocorasick.Automaton()
    for c in SPACE:
        found.add_word(c, 0)
    for s in sentinels:
        found.add_word(s, 1)
    found.make_automaton()
    return found


class Units:
    """The unit boundaries of one text: ``n`` units, and whether it holds a sentinel.

    Kept are the ends of all units but the last, in arrays of at most EVENTS.
    """

    def __init__(self, text: str, events: ahocorasick.Automaton):
        self.length, self.sentinel, self.ends = len(text), False, []
        kind = np.int32 if 2 * self.length < 2**31 else np.int64
        last, found = -1, (2 * end + value for end, value in events.iter(text))
        while len(some := np.fromiter(islice(found, EVENTS), kind)):
            space = some[some & 1 == 0] >> 1
            self.sentinel |= len(space) < len(some)
            if len(space):
                # a word lies before each white space that does not follow another one directly
                self.ends.append(space[np.diff(space, prepend=kind(last)) > 1])
                last = int(space[-1])
        self.before = [0, *accumulate(map(len, self.ends))]
        self.n = self.before[-1] + (self.length > 0)

    def end(self, k: int) -> int:
        """The number of code points in the first k units."""
        if k in (0, self.n):
            return self.length if k else 0
        block = bisect_right(self.before, k - 1) - 1
        return int(self.ends[block][k - 1 - self.before[block]])


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that the seed and the id (null: nothing) decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))  # type: ignore[return-value]


def rearranged(text: str, doc_id: object, events: ahocorasick.Automaton, seed: int, rate: int, spm: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of one text."""
    units, (h1, h2, h3, h4) = Units(text, events), draws(doc_id, seed)
    if not text or units.sentinel or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    a, b = (units.end(k) for k in sorted((h1 % (units.n + 1), h2 % (units.n + 1))))
    head, middle, tail = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        return units.n, "spm", a, b - a, "".join((SUFFIX, tail, PREFIX, head, MIDDLE, middle))
    return units.n, "psm", a, b - a, "".join((PREFIX, head, SUFFIX, tail, MIDDLE, middle))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output.

    ``rate`` hundredths of the texts are rearranged, ``spm`` hundredths of these with the suffix
    first; seed and doc_id decide which, and where the two cuts lie, so repeated rows and reruns
    agree. A text that is empty or null, or has a sentinel in it, stays plain, and its counts of
    characters are null. A null doc_id counts as an empty string. A very long text takes, beside itself and its
    output, four bytes for each word. An empty table gives no rows; other columns are ignored.
    """

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        events = automaton()
        for batch in batches:
            for a, b, texts in text_blocks(batch, BLOCK):
                ids = batch.column("doc_id").slice(a, b - a)
                rows = zip(*(rearranged(t, i, events, seed, rate, spm) for t, i in zip(texts, ids.to_pylist())))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, rows, kinds)], COLUMNS)

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(change, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from, from output and form alone.

    A rearranged text holds no sentinel of its own, and none arises where parts meet: '<' and
    '>' occur at a sentinel's ends only. So each sentinel is found once.
    """
    middle = F.substring_index(output, MIDDLE, -1)
    front = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(front, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(front, SUFFIX, -1))
    spm = F.concat(F.substring_index(front, PREFIX, -1), middle, F.substring_index(F.substring_index(front, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
