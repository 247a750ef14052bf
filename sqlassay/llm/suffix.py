"""Removal of byte strings that occur more than once, by suffix arrays of shards.

Every string of ``DEPTH`` bytes has a minimizer: the leftmost of the smallest hashes of its
``GRAM``-byte pieces, which the string alone decides. Strings that start next to each other
and have the same minimizer make up a window. Equal strings lie in windows with equal
minimizers, so windows are dealt to shards by minimizer, and only those whose minimizer occurs
twice. A minimizer with very many windows is split: its windows are cut again by the minimizer
under another hash, until few enough differ. Equal windows, as copies make them, are counted
before they move. A shard's windows that differ under one minimizer are joined to one text, on disk, whose suffixes are sorted by
external induced sorting with common prefixes: a string occurs elsewhere if its suffix shares
``DEPTH`` bytes with a neighbour.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import staged
from .induced import MEMORY_ENTRIES, SEPARATOR, repeated
from .tokens import blocks
from .words import _BYTE, mix64

DEPTH = 200
GRAM = 32
#: Bytes of window text in one shard, on the average.
SHARD_BYTES = 6_000_000
#: A minimizer with more windows is split, for as many times at most.
HOT = 20_000
LEVELS = 8
#: Longer texts are cut into windows piece by piece.
PIECE = 8_000_000


def windows(texts: list[bytes], depth: int = DEPTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of all texts: the text's number, first start, number of starts, minimizer."""
    out = []
    for a, b in blocks(texts, 1_000_000):
        for k in range(0, max(1, len(texts[a]) - depth + 1), PIECE) if b == a + 1 else (0,):
            part = [texts[a][k : k + PIECE + depth - 1]] if b == a + 1 else texts[a:b]
            who, at, many, key = _windows(part, depth, gram)
            out.append((who + a, at + k, many, key))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _windows(texts: list[bytes], depth: int, gram: int, level: int = 0) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    if len(data) < depth:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, span, power = _BYTE[data], 1, np.uint64(0x9E3779B97F4A7C15)
    total, left = None, gram
    while left:  # the hash of ``gram`` bytes from hashes of powers of two of them
        if left & 1:
            total, size = (h, span) if total is None else (total[: len(h) - size] * power + h[size:], size + span)
        left >>= 1
        if left:
            h = h[:-span] * power + h[span:]
            power = np.uint64(int(power) ** 2 % 2**64)
            span *= 2
    h = mix64(total + np.uint64(level * 0x632BE59BD9B4E019 % 2**64))
    # the upper 40 bits of the hash, then the place: the least is the leftmost of the smallest
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    count, span, least = depth - gram + 1, 1, low
    while span * 2 <= count:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < count:
        least = np.minimum(least[: len(least) - (count - span)], least[count - span :])
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size) - size
    many = np.maximum(size - depth + 1, 0)
    starts = np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    least = least[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(starts) != 1)
    at = np.flatnonzero(new)
    who = np.searchsorted(first, starts[at], side="right") - 1
    return who, starts[at] - first[who], np.diff(np.append(at, len(starts))), h[(least[at] & np.uint64((1 << 24) - 1)).astype(np.int64)]


def distinct_texts(docs: DataFrame, depth: int) -> DataFrame:
    """On disk: every distinct text of a task once (tid, text) with its windows (starts, counts, keys)."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for f in frames:
            new = {}
            for t in f["text"]:
                data = (t or "").encode()
                tid = hashlib.sha256(data).digest()[:16]
                if len(data) >= depth and tid not in seen:
                    seen.add(tid)
                    new[tid] = data
            names, texts = list(new), list(new.values())
            for a, b in blocks(texts, 4_000_000):
                who, at, many, key = windows(texts[a:b], depth)
                cuts = np.cumsum(np.bincount(who, minlength=b - a))[:-1]
                yield pd.DataFrame({"tid": names[a:b], "text": texts[a:b], "starts": np.split(at, cuts), "counts": np.split(many, cuts), "keys": np.split(key.view(np.int64), cuts)})

    ship(docs.sparkSession)
    return staged(docs.select("text").mapInPandas(cut, "tid binary, text binary, starts array<long>, counts array<long>, keys array<long>"), "texts")


def split_windows(texts: DataFrame, hot: list[set[int]], depth: int) -> DataFrame:
    """tid, start, many, key, body (hash of the bytes) of the windows under the ``hot`` keys of each level, cut by one level more."""
    shared = texts.sparkSession.sparkContext.broadcast([np.array(sorted(x), np.int64) for x in hot])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            who, at, many, key = [], [], [], []
            for k, (starts, counts, keys) in enumerate(zip(f["starts"], f["counts"], f["keys"])):
                some = np.isin(keys, shared.value[0])
                who.append(np.full(int(some.sum()), k)), at.append(starts[some]), many.append(counts[some]), key.append(keys[some])
            who, at, many, key = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (who, at, many, key))
            texts = f["text"].tolist()
            for level in range(1, len(shared.value) + 1):
                if level > 1:
                    some = np.isin(key, shared.value[level - 1])
                    who, at, many, key = who[some], at[some], many[some], key[some]
                bodies = [texts[w][s : s + n + depth - 1] for w, s, n in zip(who.tolist(), at.tolist(), many.tolist())]
                parts = []
                for a, b in blocks(bodies, 1_000_000):
                    of, start, n, more = _windows(bodies[a:b], depth, GRAM, level)
                    of = of + a
                    parts.append((who[of], at[of] + start, n, mix64(key[of].view(np.uint64) * np.uint64(3) + more).view(np.int64)))
                who, at, many, key = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
            body = [int.from_bytes(hashlib.blake2b(texts[w][s : s + n + depth - 1], digest_size=8).digest(), "little", signed=True) for w, s, n in zip(who.tolist(), at.tolist(), many.tolist())]
            yield pd.DataFrame({"tid": [f["tid"].iloc[w] for w in who.tolist()], "start": at, "many": many, "key": key, "body": np.array(body, np.int64)})

    ship(texts.sparkSession)
    return texts.mapInPandas(cut, "tid binary, start long, many long, key long, body long")


def window_texts(texts: DataFrame, depth: int, hot: int = HOT) -> DataFrame:
    """On disk, for each window whose minimizer occurs twice: tid, start, key, sid (names its content) and, once a task, the bytes."""
    each = texts.select("tid", F.explode(F.arrays_zip("starts", "counts", "keys")).alias("w")).select("tid", F.col("w.starts").alias("start"), F.col("w.counts").alias("many"), F.col("w.keys").alias("key"))
    often = staged(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "minimizers")
    # at most one key for each ``hot`` windows
    levels = [{r["key"] for r in often.filter(F.col("n") > hot).collect()}]
    spark, parts = texts.sparkSession, []
    while levels[-1]:
        keys = spark.createDataFrame([(k,) for k in sorted(levels[-1])], "key long")
        each = each.join(F.broadcast(keys), "key", "left_anti").select("tid", "start", "many", "key")
        parts.append(each.join(often.select("key"), "key"))
        each = staged(split_windows(texts, levels, depth).distinct(), "split")
        # equal windows are counted and never move, so that only different ones make a key hot
        kinds = each.groupBy("key", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
        often = staged(kinds.filter("n > 1"), "minimizers")
        each = each.drop("body")
        if len(levels) == LEVELS:
            break
        levels.append({r["key"] for r in often.filter(F.col("kinds") > hot).collect()})
    found = each.join(often.select("key"), "key")
    for part in parts:
        found = found.unionByName(part)
    found = found.distinct().groupBy("tid").agg(F.collect_list(F.struct("start", "many", "key")).alias("found"))
    # a text that several tasks kept is taken from any one of them
    rows = texts.select("tid", "text").join(found, "tid").dropDuplicates(["tid"])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[bytes] = set()
        for f in frames:
            out = []
            for tid, text, some in zip(f["tid"], f["text"], f["found"]):
                for w in some:
                    data = text[w["start"] : w["start"] + w["many"] + depth - 1]
                    sid = hashlib.blake2b(data, digest_size=16).digest()
                    out.append((tid, w["start"], w["key"], sid, None if sid in seen else data))
                    seen.add(sid)
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["tid", "start", "key", "sid", "data"])
                    out = []
            yield pd.DataFrame(out, columns=["tid", "start", "key", "sid", "data"])

    return staged(rows.mapInPandas(cut, "tid binary, start long, key long, sid binary, data binary"), "windows")


def repeated_in_shards(found: DataFrame, depth: int, shards: int, limit: int = MEMORY_ENTRIES) -> DataFrame:
    """(sid, runs): which starts of each window begin a string that starts elsewhere too, as [first, end) pairs in turn."""
    times = found.groupBy("key", "sid").agg(F.count(F.lit(1)).alias("n")).select("key", "sid", "n", F.lit(None).cast("binary").alias("data"))
    bytes_ = found.filter("data IS NOT NULL").select("key", "sid", F.lit(0).cast("long").alias("n"), "data")

    def runs(hit: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(hit, prepend=False, append=False))

    def sort(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        text = tempfile.TemporaryFile()
        names, sizes, sure = [], [], []
        last = alone = None  # the window being read; the first of its minimizer, until there is another
        many = 0

        def put(w):
            names.append(w[1])
            sizes.append(len(w[3]))
            sure.append(w[2] > 1)
            text.write(w[3] + bytes([SEPARATOR]))

        def close():
            nonlocal alone, many
            if many == 0:
                alone = last
            else:
                if alone is not None:
                    put(alone)
                    alone = None
                put(last)
            many += 1

        def settle():
            nonlocal alone, many
            out = [(alone[1], [0, len(alone[3]) - depth + 1])] if alone is not None and alone[2] > 1 else []
            alone, many = None, 0
            return out

        for f in frames:
            out = []
            for k, sid, n, data in zip(f["key"], f["sid"], f["n"], f["data"]):
                if last is not None and (k, sid) == (last[0], last[1]):
                    last = (k, sid, last[2] + n, last[3] if data is None else data)
                    continue
                if last is not None:
                    close()
                    if k != last[0]:
                        out += settle()
                last = (k, sid, n, data)
            yield pd.DataFrame(out, columns=["sid", "runs"])
        if last is not None:
            close()
        yield pd.DataFrame(settle(), columns=["sid", "runs"])
        if not names:
            return
        total = sum(sizes) + len(sizes)
        text.write(b"\0" * 8)
        text.flush()
        view = np.memmap(text, np.uint8, "r")
        hit, at, out = repeated(view, total, depth, limit), 0, []
        for sid, size, more in zip(names, sizes, sure):
            own = hit[at : at + size - depth + 1]
            at += size + 1
            if more or own.any():
                out.append((sid, [0, len(own)] if more else runs(own)))
        yield pd.DataFrame(out, columns=["sid", "runs"])
        text.close()

    ship(found.sparkSession)
    dealt = times.union(bytes_).repartition(shards, "key").sortWithinPartitions("key", "sid")
    return dealt.mapInPandas(sort, "sid binary, runs array<long>")


def remove_repeats(docs: DataFrame, depth: int = DEPTH, shard_bytes: int = SHARD_BYTES, limit: int = MEMORY_ENTRIES, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte is removed that a ``depth``-byte string covers which starts anywhere else in
    the texts of ``docs``, the same text included. Null text is empty; equal texts of that
    length, repeated rows too, are removed whole; an empty table gives no rows; other columns
    are ignored.
    """
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    rows = staged(docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), sha.alias("sha")), "digests")
    copies = rows.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"))
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= depth)
    texts = distinct_texts(docs, depth)
    found = window_texts(texts, depth, hot)
    size = found.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    marked = repeated_in_shards(found, depth, max(1, -(-size // shard_bytes)), limit)
    spans = found.select("tid", "start", "sid").join(marked, "sid").groupBy("tid").agg(F.collect_list(F.struct("start", "runs")).alias("marks"))
    whole = copies.filter(copied).select(F.unhex(F.substring("sha", 1, 32)).alias("tid"))
    spans = spans.join(whole, "tid", "left_anti")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for text, marks in zip(f["text"], f["marks"]):
                edge = np.zeros(len(text) + 1, np.int64)
                for m in marks:
                    r = np.asarray(m["runs"], np.int64) + m["start"]
                    np.add.at(edge, r[::2], 1)
                    np.add.at(edge, r[1::2] + depth - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                out.append((hashlib.sha256(text).hexdigest(), int(gone.sum()), int(np.diff(gone, prepend=False).sum() + gone[-1]) // 2, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["sha", "n_removed", "n_spans", "kept"])

    cuts = texts.select("tid", "text").join(spans, "tid").dropDuplicates(["tid"]).mapInPandas(cut, "sha string, n_removed long, n_spans long, kept string")
    gone = copies.filter(copied).select("sha", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept"))
    result = staged(cuts.union(gone), "cuts")
    return rows.join(result, "sha", "left").select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
