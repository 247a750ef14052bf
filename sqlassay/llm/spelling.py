"""Spelling variants: words that differ by one inserted, deleted or replaced code point, and what they are variants of.

An edit leaves the part before it and the part behind it intact. Each word is entered by its
first half, in a dictionary sorted forward, and by its last half, in one sorted from the word's
end: one edit apart, two words share one of these. Entries that share the intact part are
neighbours in the sorted dictionary and are compared. Where too many share it, the span in
which the edit must lie is halved again, which adds to the intact part, until few are left or the
span is one place: then as many words as there are letters, at most, share all the rest.

A pair belongs to the one span that holds its first differing place, so it is found once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import staged
from .tokens import release

#: Letters of a word: ASCII and Latin-1, one byte each in Latin-1. Upper-case ASCII is lowered before.
LETTER = r"a-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries that share an intact part and are compared without halving further.
TOGETHER = 64
#: Cells of the arrays in which words are compared.
CELLS = 2_000_000
SPAN = ["size", "lo", "hi", "head", "tail"]
FOUND = "word string, n_near long, best_n long, best string"


def dictionary(docs: DataFrame, least: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n): lower-cased runs of letters, of ``least`` code points and ``often`` occurrences or more.

    Where ``every`` divides the crc32 of doc_id, ':' and the run, one code point of the run is
    deleted first, that at crc32 modulo length. Runs too short to matter are never made rows.
    """
    run = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTER}]{{{least},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("name"), F.explode(run).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("name", F.lit(":"), "run")).alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= often)


def _entries(rows: DataFrame) -> DataFrame:
    """Rows word, n, size, lo, hi, twice: for the edit in the first and in the second half of [lo, hi), with the intact head and tail.

    ``size`` is the length of the longer word of a pair; a word of that length less one is entered too.
    """
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    spans = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi"))))
    rows = rows.select("word", "n", "size", spans.alias("span")).select("word", "n", "size", "span.lo", "span.hi")
    behind = F.col("size") - F.col("hi")
    head, tail = F.left("word", F.col("lo")), F.reverse(F.right("word", behind))
    inner = F.col("word").substr(F.col("lo") + 1, F.length("word") - F.col("lo") - behind)
    return rows.select("*", head.alias("head"), tail.alias("tail"), inner.alias("inner"))


def _pairs(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of each block [start, start + size), CELLS at most at once."""
    for m in np.unique(sizes).tolist():
        i, j = np.triu_indices(m, 1)
        if not len(i):
            continue
        first = starts[sizes == m]
        step = max(CELLS // len(i), 1)
        for k in range(0, len(first), step):
            at = first[k : k + step, None]
            yield (at + i).ravel(), (at + j).ravel()


def _near(a: np.ndarray, b: np.ndarray, width: int, data: np.ndarray, first: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of the pairs of entries differ by one edit whose first differing place is in their span.

    ``first`` and ``size`` tell where an entry's inner letters are in ``data``, ``last`` is the
    first letter of the tail (0: none). ``a`` has the full width, ``b`` that or one less.
    """
    place = np.arange(width)
    x = data[first[a][:, None] + place]
    out = np.zeros(len(a), bool)
    same = size[b] == width
    out[same] = (x[same] != data[first[b[same]][:, None] + place]).sum(1) == 1
    x, c = x[~same], b[~same]
    if width == 1:
        begin, fits = np.zeros(len(c), np.int64), np.ones(len(c), bool)
    else:
        y = data[first[c][:, None] + place[:-1]]
        begin = np.where((differ := x[:, :-1] != y).any(1), differ.argmax(1), width - 1)
        shifted = x[:, 1:] != y
        fits = ~(shifted & (place[:-1] >= begin[:, None])).any(1)
    # the shorter word goes on with its tail: if that agrees as well, the pair belongs to a later span
    out[~same] = fits & ~((begin == width - 1) & (x[:, -1] == last[c]))
    return out


def _scan(rows: pa.Table) -> pa.RecordBatch:
    """Of whole blocks (sorted entries): each word's number of near words in them, and the most frequent of these."""
    n_rows = rows.num_rows
    change = np.zeros(n_rows - 1, bool)
    for name in SPAN:
        column = rows.column(name)
        change |= pc.not_equal(column.slice(1), column.slice(0, n_rows - 1)).to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(change) + 1])
    sizes = np.diff(starts, append=n_rows)
    inner, last = (rows.column(k).combine_chunks() for k in ("inner", "last"))
    offsets = np.frombuffer(inner.buffers()[1], np.int32)[inner.offset : inner.offset + n_rows + 1].astype(np.int64)
    data = np.frombuffer(inner.buffers()[2], np.uint8) if inner.buffers()[2] else np.zeros(0, np.uint8)
    first, size = offsets[:-1], np.diff(offsets)
    width, short = rows.column("width").to_numpy().astype(np.int64), rows.column("short").to_numpy()
    last, n = last.to_numpy(), rows.column("n").to_numpy()
    found: list[np.ndarray] = []
    for w in np.unique(width[starts[sizes > 1]]).tolist():
        some = (sizes > 1) & (width[starts] == w)
        for i, j in _pairs(starts[some], sizes[some]):
            a, b = np.where(short[i], j, i), np.where(short[i], i, j)
            long = ~short[a]
            a, b = a[long], b[long]
            step = max(CELLS // w, 1)
            for k in range(0, len(a), step):
                x, y = a[k : k + step], b[k : k + step]
                near = _near(x, y, w, data, first, size, last)
                found.append(np.stack([x[near], y[near]]))
    x, y = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    # rows of a block are sorted by word: of equally frequent words the first is the smallest
    order = np.lexsort((y, -n[y], x))
    x, y = x[order], y[order]
    who, at, many = np.unique(x, return_index=True, return_counts=True)
    word = rows.column("word")
    best = y[at]
    return pa.RecordBatch.from_arrays([word.take(pa.array(who)).combine_chunks(), pa.array(many, pa.int64()), pa.array(n[best], pa.int64()), word.take(pa.array(best)).combine_chunks()], ["word", "n_near", "best_n", "best"])


def _compare(entries: DataFrame) -> DataFrame:
    """FOUND of entries whose blocks are small: they are sorted and scanned block by block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            end = rows.slice(rows.num_rows - 1)
            tied = np.ones(rows.num_rows, bool)
            for name in SPAN:
                tied &= pc.equal(rows.column(name), end.column(name)[0]).to_numpy()
            cut = rows.num_rows - int(tied.sum())  # the last block may go on
            held = rows.slice(cut)
            if cut:
                yield _scan(rows.slice(0, cut))
        if held is not None:
            yield _scan(held)

    ship(entries.sparkSession)
    letters = lambda c: F.encode(c, "ISO-8859-1")
    # the letter behind the span (tails stand reversed); with an empty tail there is none: 0
    last = F.ascii(F.right("tail", F.lit(1))).alias("last")
    rows = entries.select(*SPAN, "word", "n", letters(F.col("inner")).alias("inner"), last, (F.col("hi") - F.col("lo")).alias("width"), (F.length("word") < F.col("size")).alias("short"))
    return rows.repartitionByRange(*SPAN).sortWithinPartitions(*SPAN, "word").mapInArrow(scan, FOUND)


def near_words(words: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(word, n_near, best_n, best) of each word of (word, n) that has a near one: their number, and the most frequent (ties: the smallest) with its n."""
    size = F.explode(F.array(F.length("word"), F.length("word") + 1))
    level = words.select("word", "n", size.alias("size")).select("*", F.lit(0).alias("lo"), F.col("size").alias("hi"))
    found: list[DataFrame] = []
    while True:
        entries = staged(_entries(level), "spans")
        crowded = entries.filter("hi - lo > 1").groupBy(*SPAN).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > together)
        crowded = staged(crowded.select(*SPAN), "crowded-spans")
        if crowded.isEmpty():
            found.append(_compare(entries))
            break
        found.append(_compare(entries.join(crowded, SPAN, "left_anti")))
        level = entries.join(crowded, SPAN, "left_semi").select("word", "n", "size", "lo", "hi")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    every = every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top"))
    return every.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last, twice as far in each round. A form's n is ten times its word's, so rounds are few."""
    to = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = staged(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        to = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return to


def spelling_variants(docs: DataFrame, least: int = 7, often: int = 2, ratio: int = 10, together: int = TOGETHER) -> DataFrame:
    """Per word (see dictionary): word, form, root, n, n_near, form_n.

    ``form`` is the near word of largest n (ties: the smallest in code-point order) if it is
    ``ratio`` times as frequent or more, else null, and ``root`` where forms lead. All pairs
    count, however many words share a part. Null and empty texts have no words; a null doc_id
    counts as an empty string; repeated rows count each; an empty table gives no rows; other
    columns are ignored. Of a very long text the long words stand in one array; a very long
    word is compared as a whole.
    """
    words = staged(dictionary(docs, least, often), "dictionary")
    near = near_words(words, together)
    form = F.when(F.col("best_n") >= ratio * F.col("n"), F.col("best"))
    rows = words.join(near, "word", "left").select("word", form.alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    rows = staged(rows, "variants")
    ends = roots(rows.filter(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
