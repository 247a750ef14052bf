"""Media columns: content-addressed payloads in tar shards, rows with digest, offset and length.

A payload of 8-bit samples becomes a lossless greyscale PNG, 192 samples to a row, named by
the payload's SHA-256 and appended to a tar shard in the shared folder. A table carries where
it lies. Metadata columns are filled by reading the 33 bytes of signature and header alone.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import join_hot, maybe_in, scratch, staged

WIDTH = 192
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = len(SIGNATURE) + 25
SHARD_BYTES = 256 << 20
LEVEL = 1


def filesystem(path: str):
    """The file system of a folder's URI, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def payload(data: bytes, width: int = WIDTH) -> bytes:
    """``data`` with spaces up to a positive multiple of ``width`` bytes."""
    return data.ljust(max(1, -(-len(data) // width)) * width, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(samples: bytes, width: int = WIDTH) -> bytes:
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    plain = np.zeros((len(rows), width + 1), np.uint8)
    plain[:, 1:] = rows
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(plain.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from a PNG's first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(stored: bytes) -> bytes:
    """The samples of a PNG that to_png() wrote; every checksum is verified."""
    width, height, depth, colour = read_header(stored[:HEADER_BYTES])
    at, body = 8, []
    while at < len(stored):
        size, kind = struct.unpack(">I4s", stored[at : at + 8])
        data = stored[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", stored[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        body += [data] * (kind == b"IDAT")
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if (depth, colour) != (8, 0) or rows[:, 0].any():
        raise ValueError("not 8-bit greyscale without filters")
    return rows[:, 1:].tobytes()


class ShardWriter:
    """Appends members to tar shards of this task; a task that is run again writes new shards, and no row names the old ones."""

    def __init__(self, folder: str, limit: int = SHARD_BYTES):
        self.files, self.root = filesystem(folder)
        self.limit, self.out = limit, None

    def add(self, name: str, data: bytes) -> tuple[str, int]:
        if self.out is None:
            self.name, self.at = f"shard-{uuid.uuid4().hex}.tar", 0
            self.out = self.files.open_output_stream(f"{self.root}/{self.name}")
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.out.write(head + data + b"\0" * (-len(data) % 512))
        place = self.name, self.at + len(head)
        self.at += len(head) + len(data) + -len(data) % 512
        if self.at >= self.limit:
            self.close()
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.write(b"\0" * 1024)
            self.out.close()
            self.out = None


def payload_columns(width: int = WIDTH) -> tuple[Column, Column]:
    """n_bytes of the text, and digest: the SHA-256 of its payload, as payload() makes it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.octet_length(text)
    return n.cast("long"), F.sha2(F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(1), F.ceil(n / width)).cast("int") * width - n)), 256)


def store_texts(docs: DataFrame, folder: str) -> DataFrame:
    """Write every distinct payload once to tar shards in ``folder``; (digest, shard, offset, length) of each, on disk.

    Payloads that occur once are stored where they are read. Only those that occur again (and
    the few that a Bloom filter takes for such) are shuffled, one of a task at most, to meet
    their equals.
    """

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = ShardWriter(folder)
        for f in frames:
            rows = []
            for digest, text in zip(f["digest"], f["text"]):
                png = to_png(payload((text or "").encode()))
                rows.append((digest, *to.add(f"{digest}.png", png), len(png)))
            yield pd.DataFrame(rows, columns=["digest", "shard", "offset", "length"])
        to.close()

    ship(docs.sparkSession)
    texts = docs.select("text", payload_columns()[1].alias("digest")).withColumn("name", F.xxhash64("digest"))
    again = staged(texts.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "media-again")
    repeated = maybe_in(again, "name")(F.col("name"))
    single, several = texts.filter(~repeated), texts.filter(repeated)
    met = several.groupBy("digest").agg(F.first("text").alias("text"))
    # written before anything reads it: shards are closed when a task's rows are
    return staged(single.select("digest", "text").unionByName(met).mapInPandas(store, "digest string, shard string, offset long, length long"), "media-objects")


def _reader(folder: str):
    files, root = filesystem(folder)
    opened: dict[str, io.IOBase] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in opened:
            while opened:
                opened.popitem()[1].close()
            opened[shard] = files.open_input_file(f"{root}/{shard}")
        data = opened[shard].read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{shard} ends before {offset + length}")
        return data

    return read


def with_metadata(objects: DataFrame, folder: str) -> DataFrame:
    """Add width, height, bit_depth and colour_type to stored objects, read from headers alone."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _reader(folder)
        for f in frames:
            heads = [read_header(read(s, o, HEADER_BYTES)) for s, o in zip(f["shard"], f["offset"])]
            yield pd.concat([f, pd.DataFrame(heads, f.index, ["width", "height", "bit_depth", "colour_type"])], axis=1)

    ship(objects.sparkSession)
    schema = objects.select("*", *[F.lit(0).alias(c) for c in ("width", "height", "bit_depth", "colour_type")]).schema
    return objects.sortWithinPartitions("shard", "offset").mapInPandas(look, schema)


def features(samples: bytes) -> tuple[float, float, str]:
    """Mean and deviation of the samples, and 64 bits: which of 64 equal spans lie over the mean."""
    x = np.frombuffer(samples, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(np.int64)
    sums = np.add.reduceat(x, edges[:-1], dtype=np.int64) / np.diff(edges)
    mean = float(sums.mean())
    return float(x.mean()), float(x.std()), np.packbits(sums > mean).tobytes().hex()


def read_back(objects: DataFrame, folder: str) -> DataFrame:
    """Read every stored object (with metadata) whole: payload and media digests, tail checksum, feature."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = _reader(folder)
        for f in frames:
            out = []
            for digest, shard, offset, length, height in zip(f["digest"], f["shard"], f["offset"], f["length"], f["height"]):
                stored = read(shard, offset, length)
                samples = from_png(stored)
                if hashlib.sha256(samples).hexdigest() != digest:
                    raise ValueError(f"{shard} at {offset} is not {digest}")
                mean, spread, bits = features(samples)
                out.append((digest, shard, offset, length, len(samples), digest, zlib.crc32(samples[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), f"png {WIDTH}x{height} mean {mean:.4f} std {spread:.4f} hash {bits}"))
            yield pd.DataFrame(out, columns=["digest", "shard", "offset", "length", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    ship(objects.sparkSession)
    return objects.mapInPandas(look, "digest string, shard string, offset long, length long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Store every text of ``docs`` as media, read it back, and return what was read.

    Per row: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature, shard, offset, length (where the one stored copy lies). Null text
    is empty; equal texts, repeated rows too, have equal values; an empty table gives no rows;
    other columns are ignored. ``folder`` must be shared by all executors; without one, a
    scratch folder is taken.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    size, digest = payload_columns()
    objects = with_metadata(store_texts(docs, folder), folder)
    seen = staged(read_back(objects, folder), "media-read")
    rows = staged(docs.select("doc_id", size.alias("n_bytes"), digest.alias("digest")), "media-rows")
    return join_hot(rows, seen, "digest").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "shard", "offset", "length")
