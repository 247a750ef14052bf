"""Token ids in binary shards, in training order.

Documents, ordered by doc_id, each its ids and an end id, form one stream, whatever files or
splits they are read from. Range partitions of the documents write their parts of it; prefix
sums give every part its place, and every ``SEQUENCE`` ids are a sequence. A keyed Feistel
permutation with cycle-walking sends each sequence's number to its global slot: a bijection of
0..N-1 that needs no sort and no memory. Since slots are known to be evenly spread, their
ranges are known too: sequences are dealt by ranges of slots, and each range becomes shards of
records of fixed length, so that a reader seeks to any slot and resumes there.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, forget_shuffles, scratch, staged
from .media import filesystem
from .tokens import encoder, release, text_blocks, tokenizer_path

SEQUENCE = 2048
SHARD_RECORDS = 4096
#: Tasks that write shards, at most; with more shards than these a task writes several.
MOST_TASKS = 20_000
#: Ids in one row of the staged stream, and in what a task sorts by shard at once.
CHUNK, BUFFER = 1 << 17, 1 << 22
KEY = 0x5EED
END = 1
PAD = 0
ROUNDS = 4


def feistel(numbers: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of 0..n-1, by key: balanced Feistel rounds over the next power of four, walked until the value is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    shift = np.uint64(half)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for r in range(ROUNDS):
            z = right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((z ^ (z >> np.uint64(31))) & mask)
        return (left << shift) | right

    x = once(numbers.astype(np.uint64))
    out = x >= n
    while out.any():
        x[out] = once(x[out])
        out = x >= n
    return x.astype(np.int64)


def token_stream(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The stream of all documents' ids on disk, in rows of about ``chunk`` ids, compressed.

    Columns task, at (the row's first id's place in the task's part of the stream), n, ids;
    and of the documents that begin there doc_ids, doc_at, doc_lengths. Tasks follow one
    another in the order of doc_id; documents that agree in it, by a hash of their text.
    """
    path = path or tokenizer_path()
    kind = dict(docs.dtypes)["doc_id"]
    names = ["task", "at", "n", "ids", "doc_ids", "doc_at", "doc_lengths"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, press = encoder(path), zstandard.ZstdCompressor(level=3)
        unit = "<u2" if enc.vocab_size <= 65536 else "<u4"
        task, done, held = TaskContext.get().partitionId(), 0, 0
        ids, owners, places, lengths = [], [], [], []

        def row() -> pa.RecordBatch:
            lists = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            data = press.compress(np.concatenate(ids).tobytes())
            docs = [lists(pa.concat_arrays(owners)), lists(pa.array(np.concatenate(places))), lists(pa.array(np.concatenate(lengths)))]
            return pa.RecordBatch.from_arrays([pa.array([task], pa.int32()), pa.array([done], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary()), *docs], names)

        for batch in batches:
            release(words=False)  # what the last batch took
            for a, b, texts in text_blocks(batch):
                flat, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                ids.append(np.insert(flat, ends, END).astype(unit))
                owners.append(batch.column("doc_id")[a:b])
                places.append(done + held + ends - counts + np.arange(b - a))
                lengths.append(counts + 1)
                held += len(ids[-1])
                if held >= chunk:
                    yield row()
                    done, held = done + held, 0
                    ids, owners, places, lengths = [], [], [], []
        if held:
            yield row()

    ship(docs.sparkSession)
    keys = ["doc_id", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row")]
    # the last key only splits rows that agree in the others, whose order does not matter
    dealt = docs.select(*keys, "text").repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "row")
    shape = f"task int, at long, n long, ids binary, doc_ids array<{kind}>, doc_at array<long>, doc_lengths array<long>"
    out = staged(dealt.select("doc_id", "text").mapInArrow(encode, shape), "token-stream")
    del dealt
    forget_shuffles(docs.sparkSession)  # that of the texts is of no more use
    return out


def slots_of(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    return feistel(numbers, n, key) if len(numbers) else np.zeros(0, np.int64)


def write_token_shards(docs: DataFrame, folder: str | None = None, path: str | None = None, length: int = SEQUENCE, records: int = SHARD_RECORDS, key: int = KEY, chunk: int = CHUNK) -> DataFrame:
    """Write all documents' sequences as shards in ``folder``; the manifest, one row per sequence.

    Returns slot, shard, record, n_tokens, ids_crc32 (over the ids as written), doc_ids,
    doc_starts, doc_lengths (which ids of which documents the sequence has, in turn). Shard s
    has slots from s * records on, each ``length`` ids of two bytes (four if the vocabulary
    needs them); only the stream's last sequence is padded, with id 0. A shard appears under its
    name when it is complete, and a task that is run again writes the same bytes. What a
    sequence holds and its slot depend on the documents and the key alone, not on files or
    partitions. Null text is the end id alone, null ids come first; repeated rows are written
    as often as they occur; an empty table gives no rows and no shards; other columns are
    ignored.
    """
    spark = ship(docs.sparkSession)
    folder = folder or scratch(spark, "token-shards")
    path = path or tokenizer_path()
    stream = token_stream(docs, path, chunk)
    # one row for each task, so this window sees as many rows as there are tasks
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = staged(stream.groupBy("task").agg(F.sum("n").alias("n")).select("task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")), "token-tasks")
    total = first.agg(F.sum("n")).first()[0] or 0
    n = -(-total // length)
    shards = -(-n // records)
    each = max(1, -(-shards // MOST_TASKS))
    placed = stream.join(first.select("task", "first"), "task")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        unit = np.dtype("<u2" if encoder(path).vocab_size <= 65536 else "<u4")
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            number, offset, size = (np.concatenate([k[i] for k in kept]) for i in range(3))
            ids = np.concatenate([k[3] for k in kept])
            begin = np.cumsum(size) - size
            shard = slots_of(number, n, key) // records
            order = np.argsort(shard, kind="stable")
            names, cuts = np.unique(shard[order], return_index=True)
            out = []
            for some in np.split(order, cuts[1:]):
                parts = [x[some].astype("<i8").tobytes() for x in (number, offset, size)]
                out.append(press.compress(len(some).to_bytes(8, "little") + b"".join(parts) + b"".join(ids[x : x + y].tobytes() for x, y in zip(begin[some].tolist(), size[some].tolist()))))
            return pa.RecordBatch.from_arrays([pa.array((names // each).astype(np.int32)), pa.array(names.astype(np.int32)), pa.array(out, pa.binary())], ["part", "shard", "data"])

        held = 0
        for batch in batches:
            for start, data in zip((batch.column("first").to_numpy() + batch.column("at").to_numpy()).tolist(), batch.column("ids")):
                ids = np.frombuffer(unpress.decompress(data.as_py()), unit)
                number = np.arange(start // length, (start + len(ids) - 1) // length + 1)
                edge = np.clip(np.append(number, number[-1] + 1) * length, start, start + len(ids))
                kept.append((number, edge[:-1] - number * length, np.diff(edge), ids))
                held += len(ids)
                if held >= BUFFER:
                    yield rows()
                    kept, held = [], 0
        if kept:
            yield rows()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        unit = np.dtype("<u2" if encoder(path).vocab_size <= 65536 else "<u4")
        unpress = zstandard.ZstdDecompressor()
        now, whole, numbers, filled = -1, None, None, None

        def close() -> pa.RecordBatch:
            name = f"_{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(whole)
            files.move(f"{root}/{name}", f"{root}/shard-{now:06d}.bin")
            crc = [zlib.crc32(line[:k]) for line, k in zip(whole, filled.tolist())]
            slots = now * records + np.arange(len(whole))
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(slots), pa.array(filled.astype(np.int32)), pa.array(crc, pa.int64())], ["number", "slot", "n_tokens", "ids_crc32"])

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                if shard != now:
                    if whole is not None:
                        yield close()
                    many = min(records, n - shard * records)
                    now, whole = shard, np.full((many, length), PAD, unit)
                    numbers, filled = np.zeros(many, np.int64), np.zeros(many, np.int64)
                raw = unpress.decompress(data.as_py())
                k = int.from_bytes(raw[:8], "little")
                number, offset, size = np.frombuffer(raw, "<i8", 3 * k, 8).reshape(3, k)
                ids, at = np.frombuffer(raw, unit, offset=8 + 24 * k), 0
                record = slots_of(number, n, key) - now * records
                numbers[record] = number
                np.add.at(filled, record, size)
                for r, o, m in zip(record.tolist(), offset.tolist(), size.tolist()):
                    whole[r, o : o + m] = ids[at : at + m]
                    at += m
        if whole is not None:
            yield close()

    dealt = placed.select("first", "at", "ids").mapInArrow(deal, "part int, shard int, data binary")
    dealt = dealt.repartitionById(max(1, -(-shards // each)), F.col("part")).sortWithinPartitions("shard").select("shard", "data")
    written = staged(dealt.mapInArrow(write, "number long, slot long, n_tokens int, ids_crc32 long"), "token-records")
    # which documents lie in which sequences, from where each begins and how long it is
    each_doc = placed.select("first", F.explode(F.arrays_zip("doc_ids", "doc_at", "doc_lengths")).alias("d"))
    each_doc = each_doc.select(F.col("d.doc_ids").alias("doc_id"), (F.col("first") + F.col("d.doc_at")).alias("begin"), (F.col("first") + F.col("d.doc_at") + F.col("d.doc_lengths")).alias("end"))
    number = F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor((F.col("end") - 1) / length))).alias("number")
    each_doc = each_doc.select("doc_id", "begin", "end", number)
    low, high = F.greatest("begin", F.col("number") * length), F.least("end", (F.col("number") + 1) * length)
    part = F.struct(low.alias("low"), "doc_id", (low - F.col("begin")).alias("start"), (high - low).alias("length"))
    parts = each_doc.groupBy("number").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    found = written.join(parts, "number").select(
        "slot", F.floor(F.col("slot") / records).cast("int").alias("shard"), F.pmod("slot", F.lit(records).cast("long")).alias("record"), "n_tokens", "ids_crc32",
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.start").alias("doc_starts"), F.col("parts.length").alias("doc_lengths"),
    )
    found = staged(found, "token-manifest")
    discard(stream)
    return found


def read_slots(folder: str, first: int, many: int, length: int = SEQUENCE, records: int = SHARD_RECORDS, unit: int = 2) -> np.ndarray:
    """Records of slots first..first+many-1, read by seeking; fewer at the end."""
    files, root = filesystem(folder)
    out, stride = [], length * unit
    while many > 0:
        shard, record = divmod(first, records)
        path = f"{root}/shard-{shard:06d}.bin"
        if files.get_file_info(path).type.name == "NotFound":
            break
        with files.open_input_file(path) as f:
            data = f.read_at(min(many, records - record) * stride, record * stride)
        got = len(data) // stride
        out.append(np.frombuffer(data, f"<u{unit}").reshape(got, length))
        first, many = first + got, many - got
        if not got:
            break
    return np.concatenate(out) if out else np.zeros((0, length), f"<u{unit}")
