"""Best-fit packing of token pieces into sequences, with large items matched first.

What matters about a piece is its length, at most the capacity. So the plan is made on the
driver from the number of pieces of each length, however many there are: pieces longer than a
third of the capacity are matched, longest first, each with the longest that still fits (two
of them fill a sequence at most); shorter ones go, longest first, where the least room that
suffices is left. The plan gives ranges of sequences to ranges of pieces of a length, and
every piece finds its place by its number among the pieces of that length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import buckets_for, running_total, staged, whole
from .tokens import encoder, release, text_blocks, tokenizer_path

CAPACITY = 4096
END = 1


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places for counts[n] pieces of each length n: rows (length, first piece, each, first sequence, offset), and the number of sequences.

    Pieces from ``first piece`` on go ``each`` to a sequence, in turn, from ``offset`` on.
    """
    left = np.array(counts, np.int64)
    used = np.zeros(capacity + 1, np.int64)
    rows: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}
    gaps: list[int] = []
    n_seq = 0

    def free(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not room.get(gap):
                room[gap] = []
                insort(gaps, gap)
            room[gap].append((first, many))

    def put(length: int, each: int, many: int, first: int, offset: int) -> None:
        rows.append((length, int(used[length]), each, first, offset))
        used[length] += each * many
        left[length] -= each * many

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            fits = np.flatnonzero(left[third + 1 : min(a, capacity - a) + 1]) + third + 1
            if len(fits) and fits[-1] == a and left[a] == 1:
                fits = fits[:-1]
            b = int(fits[-1]) if len(fits) else 0
            many = int(left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b]))
            put(a, 1, many, n_seq, 0)
            if b:
                put(b, 1, many, n_seq, a)
            free(capacity - a - b, n_seq, many)
            n_seq += many
    for a in range(third, 0, -1):
        while left[a]:
            k = bisect_left(gaps, a)
            if k == len(gaps):
                many = -(-int(left[a]) // (capacity // a))
                free(capacity, n_seq, many)
                n_seq += many
                k = bisect_left(gaps, a)
            gap = gaps[k]
            first, many = room[gap].pop()
            if not room[gap]:
                gaps.pop(k)
            each = min(gap // a, int(left[a]))
            fill = min(many, int(left[a]) // each)
            put(a, each, fill, first, capacity - gap)
            free(gap, first + fill, many - fill)
            free(gap - each * a, first, fill)
    return np.array(sorted(rows), np.int64).reshape(-1, 5), n_seq


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (length from 1 to capacity, other columns kept, whatever their names).

    Nulls elsewhere and repeated rows are kept; an empty table gives no rows.
    """
    base = staged(pieces.select("length", whole(pieces).alias("piece"), F.monotonically_increasing_id().alias("row")), "pieces")
    per = base.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    rows, _ = plan(counts, capacity)
    start = (rows[:, 0] << 48) + rows[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def put(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        length, number = length.to_numpy(np.int64), number.to_numpy(np.int64)
        at = rows[np.searchsorted(start, (length << 48) + number, side="right") - 1] if len(length) else rows[:0]
        turn = number - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + turn // np.maximum(at[:, 2], 1), "offset": at[:, 4] + turn % np.maximum(at[:, 2], 1) * length})

    ship(pieces.sparkSession)
    sized = base.join(F.broadcast(per.select("length", buckets_for(F.col("n")).alias("buckets"))), "length")
    # dealt by the row's own number: equal pieces do not share a bucket
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets").cast("long")).cast("int"))
    numbered = running_total(sized, ["length"], "bucket", ["row"], None, "number")
    return numbered.select("piece", put("length", "number").alias("at")).select("piece.*", "at.*")


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32.

    A document is its text's ids and then one end id; null text is empty. Only a longer one is
    cut, into pieces of ``capacity`` ids and a last shorter one. Other columns are ignored.
    """
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            release(words=False)  # what the last batch took
            for a, b, texts in text_blocks(batch):
                flat, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                flat = np.insert(flat, ends, END).astype("<u4", copy=False)
                counts, ends = counts + 1, ends + np.arange(1, b - a + 1)
                parts = -(-counts // capacity)
                who = np.repeat(np.arange(b - a), parts)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(counts[who] - start, capacity)
                at = (ends - counts)[who] + start
                crc = [zlib.crc32(flat[x : x + n]) for x, n in zip(at.tolist(), length.tolist())]
                ids = batch.column("doc_id").take(pa.array(a + who))
                yield pa.RecordBatch.from_arrays([ids, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names)
        release(words=False)

    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    # the id stays an Arrow column: pandas would make doubles of longs beside a null
    return docs.select("doc_id", "text").mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: cut() and place().

    Repeated rows are packed as often as they occur; an empty table gives no rows; other
    columns are ignored; null text is the end id alone.
    """
    return place(cut(docs, path, capacity), capacity)
