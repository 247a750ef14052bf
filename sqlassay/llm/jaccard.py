"""Near-duplicate documents by a parity-sketch join, exact for Jaccard similarity of word shingles.

Sketches. A set's shingles fall into K bands by hash; a band's sketch is the XOR of the 64-bit
hashes of its shingles. One shingle more or less changes one band, so two sets that differ in
d shingles differ in d bands at most. Sets of a and b shingles with similarity t or more differ
in d = (1 - t) / (1 + t) * (a + b) at most; with K = d + 1 + spare bands, spare + 1 are equal.

Size bands. Only sets of like sizes can be similar. Sizes are cut into bands, and K is set for
each band, and for each two neighbouring bands, by the largest sizes that can meet there.

Pigeonhole join. Sets that share a band's sketch meet. Empty bands are left out; a set with
more empty bands than the spare ones adds them all. Very common shingles, found on a sample,
are left out of bands as well: what is left differs no more than the whole. A set of which
that leaves too little adds its full bands under another name. No similar pair is lost.

Few sets that share a sketch are compared in pairs by one-bit parity sketches of all their
shingles, whose Hamming distance never exceeds the number of differing shingles: pairs that
these tell apart do not meet. Else, the larger the table, the more sets would meet by chance,
until most were one family.

Verification. Sets that meet, directly or through others, form a family. A small family is
compared whole: first by size, then by one-bit parity sketches, and at last shingle by shingle. In a large one,
blocks dealt at random are compared first, in a few rounds, which connects near copies at a
cost that grows with their number; only what is not in the family's largest part after that is
compared with all blocks. Pairs already connected are skipped, and a block hands on a spanning
forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, forget_shuffles, join_hot, only_ids, row_key, rows_with_keys, staged
from .components import components
from .tokens import blocks, release, text_blocks
from .words import mix64, shingle_hashes, word_hashes

SHINGLE = 5
#: Similarity in hundredths.
PERCENT = 80
GROWTH = 1.5
SPARE = 0.15
#: Bytes of a shingle's hash: all are kept.
KEPT = 8
#: Rounds in which the sets of a large family meet others by chance, before those still apart are compared exhaustively.
ROUNDS = 3
#: Sets, and shingles, in one block of a family.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Common shingles: at most this many, found at least so often among a sample of about so many sets, or of every so many-th set where
#: that is more: what stays uncommon is then in so many sets at most, however large the table.
HOT_SHINGLES, HOT_TIMES, SAMPLE_SETS, SAMPLE_OF = 1_000_000, 8, 16_000, 20
#: Sets that share a signature and are compared in pairs; more than that are linked unseen.
FEW = 64
#: Signatures sorted by one task.
PART_SIGNATURES = 1_000_000
#: Signatures are shuffled in turns: one more for each so many parts, at most so many, so that only a share of them is on disk at a time.
TURN_PARTS, TURNS = 64, 3
#: Times that families too large for one block are taken apart by what is common among their own sets.
APART = 4


def size_bands(top: int, growth: float = GROWTH) -> np.ndarray:
    """First sizes of the bands that cover 1..top."""
    starts = [1]
    while starts[-1] <= top:
        starts.append(max(starts[-1], int(starts[-1] * growth)) + 1)
    return np.array(starts, np.int64)


def _most(a: int, b: int, percent: int) -> int:
    """Most differing shingles of sets of a and b that are similar."""
    return (100 - percent) * (a + b) // (100 + percent)


def schemes(n: np.ndarray, percent: int = PERCENT) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For set sizes n (over 0): up to three (which sets, scheme number, K - 1 - spare = d)."""
    starts = size_bands(int(n.max()) if len(n) else 1)
    band = np.searchsorted(starts, n, side="right") - 1
    last = starts[1:] - 1
    last = np.append(last, last[-1] * 2)
    own = np.array([_most(x, x, percent) for x in last])
    cross = np.array([_most(x, x * 100 // percent, percent) for x in last])
    out = [(np.arange(len(n)), 2 * band, own[band])]
    up = np.flatnonzero(n * 100 // percent > last[band])
    out.append((up, 2 * band[up] + 1, cross[band[up]]))
    low = np.maximum(band - 1, 0)
    down = np.flatnonzero((band > 0) & (n <= last[low] * 100 // percent))
    out.append((down, 2 * low[down] + 1, cross[low[down]]))
    return out


def _band_sketches(shingles: np.ndarray, owner: np.ndarray, keys: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the non-empty bands of sets (owner: each shingle's set), and the set of each."""
    first = np.cumsum(bands) - bands
    band = mix64(shingles + np.uint64(0x1234567)) % bands[owner].astype(np.uint64)
    slot = first[owner] + band.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    begin = np.flatnonzero(np.diff(slot, prepend=-1)) if len(slot) else np.zeros(0, np.int64)
    value = np.bitwise_xor.reduceat(mix64(shingles[order]), begin) if len(begin) else np.zeros(0, np.uint64)
    slot = slot[begin]
    who = np.searchsorted(first, slot, side="right") - 1
    return mix64(value ^ mix64(keys[who] + (slot - first[who]).astype(np.uint64))), who


def signatures(sets: list[np.ndarray], hot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets (none empty) and the number of the set of each; similar sets share one."""
    n = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), n)
    at = np.searchsorted(hot, flat)
    common = hot[np.minimum(at, len(hot) - 1)] == flat if len(hot) else np.zeros(len(flat), bool)
    sigs, who = [], []
    for which, scheme, most in schemes(n, percent):
        if not len(which):
            continue
        spare = np.where(most > 0, np.ceil((most + 1) * SPARE).astype(np.int64), 0)
        # without the common shingles, then whole where that leaves too few bands, then with the empty ones
        place = np.full(len(sets), -1)
        place[which] = np.arange(len(which))
        for whole in (False, True):
            bands = most + 1 + spare
            local = place[owner]
            use = (local >= 0) & (~common if not whole else True)
            salt = mix64((scheme * 2 + whole).astype(np.uint64) + np.uint64(77)) + np.uint64(1 << 32)
            s, w = _band_sketches(flat[use], local[use], salt, bands)
            sigs.append(s)
            who.append(which[w])
            empty = bands - np.bincount(w, minlength=len(which))
            lacking = empty > spare
            if not whole:
                which, scheme, most, spare = which[lacking], scheme[lacking], most[lacking], spare[lacking]
                place[:] = -1
                place[which] = np.arange(len(which))
                if not len(which):
                    break
            elif lacking.any():
                for k in np.flatnonzero(lacking):
                    gone = np.setdiff1d(np.arange(bands[k]), (mix64(sets[which[k]] + np.uint64(0x1234567)) % np.uint64(bands[k])).astype(np.int64))
                    sigs.append(mix64(mix64(salt[k] + gone.astype(np.uint64)) ^ np.uint64(0xE0)))
                    who.append(np.full(len(gone), which[k]))
    return (np.concatenate(sigs), np.concatenate(who)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _groups(sig: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signature, id) pairs, each once, by signature and id; the place where each one's signature begins, and how many ids that has."""
    order = np.lexsort((ids, sig))
    sig, ids = sig[order], ids[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])
    sig, ids = sig[new], ids[new]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    many = np.diff(np.append(begin, len(sig)))
    return sig, ids, np.repeat(begin, many), np.repeat(many, many)


def _stars(sig: np.ndarray, ids: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of signatures with over ``few`` ids, of each to the first, and the (signature, id) pairs that are still needed: few + 1 of such a signature, all of others."""
    sig, ids, begin, many = _groups(sig, ids)
    place = np.arange(len(sig)) - begin
    other = (many > few) & (place > 0)
    needed = (many <= few) | (place <= few)
    return np.unique(np.stack([ids[begin][other], ids[other]], 1), axis=0), sig[needed], ids[needed]


def _meetings(sig: np.ndarray, ids: np.ndarray, few: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ids that share a signature with at most ``few``, each once; and links that connect those that share one with more."""
    sig, ids, begin, many = _groups(sig, ids)
    names, which = np.unique(ids, return_inverse=True)
    place = np.arange(len(sig)) - begin
    at, ahead, found, waiting = np.flatnonzero(many <= few), 0, np.zeros(0, np.int64), []
    while len(at):
        ahead += 1
        at = at[place[at] + ahead < many[at]]
        waiting.append(which[at] * len(names) + which[at + ahead])
        if not len(at) or sum(map(len, waiting)) > 1_000_000:  # near copies meet under many signatures
            found, waiting = np.unique(np.concatenate([found, *waiting])), []
    other = (many > few) & (place > 0)
    links = np.unique(np.stack([ids[begin][other], ids[other]], 1), axis=0)
    return np.stack([names[found // max(1, len(names))], names[found % max(1, len(names))]], 1), links


#: Bytes of a signature that travel, beside the part it is sent to. Fewer only make some more sets meet, of which the comparison
#: decides: of n signatures in parts of a million, one in two million meets another by chance.
SENT = 5


def _packed(sig: np.ndarray, ids: np.ndarray) -> bytes:
    """(signature, id) pairs, sorted by signature: its upper bytes plane by plane, and ids whole or, where that is shorter, as places in a list of them."""
    names, which = np.unique(ids, return_inverse=True)
    wide = np.uint16 if len(names) <= 1 << 16 else np.uint32
    listed = 8 * len(names) + np.dtype(wide).itemsize * len(ids) < 8 * len(ids)
    planes = np.ascontiguousarray(sig.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :SENT].T)
    head = np.array([len(ids), len(names) if listed else 0], np.int64)
    return b"".join([head.tobytes(), planes.tobytes(), names.tobytes() + which.astype(wide).tobytes() if listed else ids.tobytes()])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    many, listed = np.frombuffer(data, np.int64, 2).tolist()
    at = 16 + SENT * many
    sig = np.zeros((many, 8), np.uint8)
    sig[:, 8 - SENT :] = np.frombuffer(data, np.uint8, SENT * many, 16).reshape(SENT, many).T
    if not listed:
        return sig.view(">u8").ravel().astype(np.uint64), np.frombuffer(data, np.int64, many, at)
    wide = np.uint16 if listed <= 1 << 16 else np.uint32
    names = np.frombuffer(data, np.int64, listed, at)
    return sig.view(">u8").ravel().astype(np.uint64), names[np.frombuffer(data, wide, many, at + 8 * listed)]


class Forest:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def spanning(pairs: np.ndarray) -> np.ndarray:
    """Those pairs that first connect something."""
    names, number = np.unique(pairs, return_inverse=True)
    forest = Forest(len(names))
    keep = [forest.join(x, y) for x, y in number.reshape(-1, 2).tolist()]
    return pairs[np.array(keep, bool)] if len(pairs) else pairs


def _pack(values: np.ndarray) -> bytes:
    """Sorted hashes, byte plane by byte plane (the first planes of sorted numbers compress well)."""
    return np.ascontiguousarray(values.astype(">u8").view(np.uint8).reshape(-1, KEPT).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(KEPT, -1)
    return np.ascontiguousarray(planes.T).view(">u8").ravel().astype(np.uint64)


def set_ids(docs: DataFrame, shingle: int = SHINGLE, bits: int = 64) -> DataFrame:
    """On disk, per row: all columns but text, n_shingles, set_id (null if empty), and the set's shingles once a task.

    Equal sets, and only those, have equal ids: an id (``bits`` bits of a hash) that a second
    hash shows to stand for different sets is replaced by a hash of both.
    """
    names = [c for c in docs.columns if c != "text"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for a, b, texts in text_blocks(batch):
                words, per = word_hashes([t.encode() for t in texts])
                flat, many = shingle_hashes(words, per, shingle)
                out, end = [], 0
                for m in many.tolist():
                    s = np.unique(flat[end : end + m])
                    end += m
                    if not m:
                        out.append((0, None, None, None))
                        continue
                    name = mix64(s.sum(dtype=np.uint64).reshape(1) ^ mix64(np.bitwise_xor.reduce(s).reshape(1) + np.uint64(len(s))))
                    name = int((name >> np.uint64(64 - bits)).view(np.int64)[0])
                    check = int(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).view(np.int64))
                    out.append((len(s), name, check, None if (name, check) in seen else _pack(s)))
                    seen.add((name, check))
                n, name, check, blob = zip(*out)
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in names), pa.array(n, pa.int64()), pa.array(name, pa.int64()), pa.array(check, pa.int64()), pa.array(blob, pa.binary())], [*names, "n_shingles", "set_id", "check", "shingles"])

    kinds = dict(docs.dtypes)
    ship(docs.sparkSession)
    # the other columns stay Arrow columns: pandas would make doubles of longs beside a null
    head = ", ".join(f"{c} {kinds[c]}" for c in names)
    rows = staged(docs.select(*names, "text").mapInArrow(sets, f"{head}, n_shingles long, set_id long, check long, shingles binary"), "shingle-sets")
    while True:
        clash = rows.groupBy("set_id").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).filter("lo <> hi").select("set_id", F.lit(True).alias("clash"))
        clash = staged(clash, "set-clashes")
        if clash.isEmpty():
            return rows
        named = F.when(F.col("clash"), F.xxhash64("set_id", "check")).otherwise(F.col("set_id"))
        rows = staged(rows.join(clash, "set_id", "left").withColumn("set_id", named).drop("clash"), "shingle-sets")


def common_shingles(sets: DataFrame, n_sets: int) -> np.ndarray:
    """Shingles that are common in a sample of sets; sorted, at most HOT_SHINGLES. It only bears on speed."""
    rate = min(1.0, max(SAMPLE_SETS / max(n_sets, 1), 1 / SAMPLE_OF))
    sample = sets.filter(F.pmod("set_id", F.lit(1_000_003)) < int(rate * 1_000_003) + 1).select("set_id", "shingles")

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for f in frames:
            for _, row in f.groupby(np.arange(len(f)) // 64):
                h, n = np.unique(np.concatenate([_unpack(x) for x in row["shingles"]]), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n})

    found = sample.dropDuplicates(["set_id"]).mapInPandas(spread, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= HOT_TIMES)
    top = found.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def sketch(shingles: np.ndarray) -> bytes:
    """One-bit parity sketch of one to two bits a shingle, a power of two of them and 64 at least; folded to half its length, it is the shorter one."""
    wide = 64 << max(0, (len(shingles) - 1).bit_length() - 6)
    at = ((shingles * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & np.uint64(wide - 1)
    return np.packbits((np.bincount(at.astype(np.int64), minlength=wide) & 1).astype(np.uint8)).tobytes()


def _may_link(percent: int):
    """Of rows (m, x, n, y), sizes and sketches of two sets: false only where these show that the two are not similar."""

    @F.pandas_udf("boolean")
    def may(m: pd.Series, x: pd.Series, n: pd.Series, y: pd.Series) -> pd.Series:
        a, b = m.to_numpy(np.int64), n.to_numpy(np.int64)
        out = np.maximum(a, b) * percent <= np.minimum(a, b) * 100
        wide, other = x.str.len().to_numpy(np.int64), y.str.len().to_numpy(np.int64)
        for w, o in np.unique(np.stack([wide[out], other[out]], 1), axis=0).tolist():
            at = np.flatnonzero(out & (wide == w) & (other == o))
            short = min(w, o)
            fold = lambda rows, of: np.bitwise_xor.reduce(np.frombuffer(b"".join(rows.iloc[at]), np.uint8).reshape(len(at), of // short, short), axis=1)
            apart = np.bitwise_count(fold(x, w) ^ fold(y, o)).sum(1, dtype=np.int64)
            out[at] = apart * (100 + percent) <= (100 - percent) * (a[at] + b[at])
        return pd.Series(out)

    return may


def sketches(sets: DataFrame) -> DataFrame:
    """On disk, (id, n, sketch) of each set."""

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for f in frames:
            yield pd.DataFrame({"id": f["set_id"], "n": f["n_shingles"], "sketch": [sketch(_unpack(x)) for x in f["shingles"]]})

    ship(sets.sparkSession)
    drawn = sets.select("set_id", "n_shingles", "shingles").mapInPandas(draw, "id long, n long, sketch binary")
    return staged(drawn.dropDuplicates(["id"]), "sketches")


def possible_links(met: DataFrame, drawn: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) of ``met`` (a, b, sure), without pairs that are not sure and that sketches tell apart."""
    pairs = met.filter("NOT sure").select("a", "b").distinct()
    pairs = pairs.join(drawn.toDF("a", "m", "x"), "a").join(drawn.toDF("b", "n", "y"), "b")
    return met.filter("sure").select("a", "b").union(pairs.filter(_may_link(percent)("m", "x", "n", "y")).select("a", "b"))


def candidate_links(sets: DataFrame, hot: np.ndarray, parts: int, percent: int = PERCENT, turn: int = 0, turns: int = 1, few: int = FEW) -> DataFrame:
    """(a, b, sure): of the parts whose turn it is, all pairs of sets with a signature that at most ``few`` share; and, sure, links that connect those with others."""
    ship(sets.sparkSession)
    shared = sets.sparkSession.sparkContext.broadcast(hot)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        for f in frames:
            lists, names = f["shingles"].tolist(), f["set_id"].to_numpy(np.int64)
            for a, b in blocks(lists, 500_000 * KEPT):
                sig, who = signatures([_unpack(x) for x in lists[a:b]], shared.value, percent)
                pairs, sig, ids = _stars(sig, names[a:b][who], few)
                part = (mix64(sig) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                sig, ids = sig[order], ids[order]  # still by signature within a part
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p // turns, False, _packed(sig[cuts[p] : cuts[p + 1]], ids[cuts[p] : cuts[p + 1]])) for p in np.flatnonzero(np.diff(cuts)) if p % turns == turn]
                if len(pairs) and not turn:
                    rows.append((int(names[a]) % parts // turns, True, spanning(pairs).tobytes()))
                yield pd.DataFrame(rows, columns=["part", "linked", "data"])

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        release()
        found, pairs = [np.zeros((0, 2), np.int64)], []
        for f in frames:
            found += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in f["data"][f["linked"]]]
            pairs += [_unpacked(x) for x in f["data"][~f["linked"]]]
        met = np.zeros((0, 2), np.int64)
        if pairs:
            met, links = _meetings(*map(np.concatenate, zip(*pairs)), few)
            found.append(links)
        for sure, some in ((True, spanning(np.concatenate(found))), (False, met)):
            yield pd.DataFrame(some, columns=["a", "b"]).assign(sure=sure)

    spread = sets.select("set_id", "shingles").mapInPandas(sign, "part int, linked boolean, data binary")
    # one task for each part, so that what a task holds does not grow with the data
    return spread.repartitionById((parts - 1) // turns + 1, F.col("part")).select("linked", "data").mapInPandas(meet, "a long, b long, sure boolean")


def candidate_families(sets: DataFrame, percent: int = PERCENT, apart: bool = False) -> DataFrame:
    """On disk, (id, component): the families of sets that share signatures, directly or through others; with ``apart``, but for pairs that sketches tell apart."""
    total = sets.agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s")).first()
    parts = max(1, int((total["s"] or 0) * 0.6 / PART_SIGNATURES) + 1)
    turns = min(TURNS, 1 + parts // TURN_PARTS)
    hot, found = common_shingles(sets, total["n"]), []
    drawn = sketches(sets) if apart else None
    for turn in range(turns):
        forget_shuffles(sets.sparkSession)  # the sample's, or the last turn's, before more signatures are shuffled
        found.append(staged(candidate_links(sets, hot, parts, percent, turn, turns), "candidates"))
        if apart:
            forget_shuffles(sets.sparkSession)
            met, found[-1] = found[-1], staged(possible_links(found[-1], drawn, percent), "candidates")
            discard(met)
    families = staged(components(reduce(DataFrame.union, [x.select("a", "b") for x in found])), "families")
    discard(*found, *([drawn] if apart else []))
    return families


def families_apart(sets: DataFrame, families: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``families``, those of more than ``block`` sets taken apart.

    In a large table a shingle that is rare overall still joins very many sets, and families
    grow together. What is common among the sets of large families alone tells them apart:
    their signatures are made anew without it. Sets that are similar stay together, since they
    are in one family and their new signatures meet as well. This is done again as long as it
    leaves much less in large families.
    """
    done, before = [], None
    for _ in range(APART):
        large = families.groupBy("component").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > block).select("component")
        of_large = staged(join_hot(families, large.withColumn("large", F.lit(True)), "component").select("id"), "large-families")
        many = of_large.count()
        if not many or before and many > 0.7 * before:
            break
        done.append(families.join(of_large, "id", "left_anti"))
        members = of_large.withColumnRenamed("id", "set_id")
        own = staged(only_ids(sets, "set_id", members).join(members, "set_id", "left_semi").dropDuplicates(["set_id"]), "large-family-sets")
        families, before = candidate_families(own, percent, True), many
        discard(own)
    return reduce(DataFrame.unionByName, done, families)


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _bits(sets: list[np.ndarray], width: int) -> np.ndarray:
    """One-bit parity sketches of ``width`` * 64 bits."""
    n = np.array([len(s) for s in sets])
    at = (np.concatenate(sets) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
    at = at % np.uint64(width * 64) + np.repeat(np.arange(len(sets), dtype=np.uint64) * np.uint64(width * 64), n)
    odd = np.bincount(at.astype(np.int64), minlength=len(sets) * width * 64).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(sets), -1), axis=1).view(np.uint64)


def block_links(sets: list[np.ndarray], labels: np.ndarray | None = None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A spanning forest of the similar pairs among ``sets``; those with equal ``labels`` count as connected."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n = n[order]
    sets = [sets[k] for k in order]
    forest, links, at = Forest(len(sets)), [], 0
    first: dict[int, int] = {}
    for k, label in enumerate(labels[order].tolist() if labels is not None else ()):
        forest.join(first.setdefault(label, k), k)
    apart_yet = len(sets) if labels is None else len(first)
    while at < len(sets) and apart_yet > 1:  # sets of like sizes share a sketch width
        end = int(np.searchsorted(n, n[at] * 2, side="right"))
        reach = int(np.searchsorted(n, n[end - 1] * 100 // percent, side="right"))
        sketch = _bits(sets[at:reach], max(1, int(n[reach - 1]) // 64))
        for x in range(at, end):
            top = int(np.searchsorted(n, n[x] * 100 // percent, side="right"))
            if top <= x + 1 or apart_yet == 1:
                continue
            apart = np.bitwise_count(sketch[x + 1 - at : top - at] ^ sketch[x - at]).sum(1, dtype=np.int64)
            near = np.flatnonzero(apart * (100 + percent) <= (100 - percent) * (n[x + 1 : top] + n[x]))
            for y in (near[np.argsort(apart[near], kind="stable")] + x + 1).tolist():
                if forest.root(x) != forest.root(y) and similar(sets[x], sets[y], percent):
                    forest.join(x, y)
                    apart_yet -= 1
                    links.append((int(order[x]), int(order[y])))
        at = end
    return links


def _compare(percent: int):
    """Links of each family in a job's rows (family, set_id, label, shingles)."""

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        release()
        out = []
        for _, g in f.groupby("family"):
            if len(g) > 1:
                names = g["set_id"].to_numpy(np.int64)
                out += [(names[x], names[y]) for x, y in block_links([_unpack(x) for x in g["shingles"]], g["label"].to_numpy(np.int64), percent)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return compare


def _cuts(block: int, block_shingles: int):
    return F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).cast("int")


def _labelled(large: DataFrame, links: DataFrame) -> DataFrame:
    """set_id, family, n, step and label: the component that ``links`` give the set, itself without any."""
    found = components(links).withColumnRenamed("id", "set_id")
    return staged(large.select("set_id", "family", "n", "step").join(found, "set_id", "left").select("set_id", "family", "n", "step", F.coalesce("component", "set_id").alias("label")), "set-labels")


def large_links(large: DataFrame, percent: int, block: int, block_shingles: int, rounds: int = ROUNDS) -> DataFrame:
    """(a, b): links that connect, in large families, all that similar sets connect.

    large: family, set_id, n, step (of sizes that similar sets may differ by), shingles. In
    some rounds the sets are dealt at random, by size, into blocks that a task holds, and
    those of a block are compared: copies and near copies of a text find one another so, at a
    cost that grows with their number. What then lies in its family's largest part need not be
    compared among itself. Every other block is compared with all blocks of its size class and
    with the ends of the classes beside it, so that no link is lost.
    """
    links = large.select(F.col("set_id").alias("a"), F.col("set_id").alias("b")).limit(0)
    labels = _labelled(large, links)
    for turn in range(rounds):
        if labels.groupBy("family").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y").isEmpty():
            return links
        dealt = labels.withColumn("class", F.floor((F.col("step") + 2 * (turn % 2)) / 4))
        dealt = dealt.join(dealt.groupBy("family", "class").agg(_cuts(block, block_shingles).alias("cuts")), ["family", "class"])
        dealt = dealt.withColumn("job", F.xxhash64("family", "class", F.pmod(F.xxhash64("set_id", F.lit(turn)), F.col("cuts").cast("long"))))
        rows = large.select("set_id", "shingles").join(dealt.select("set_id", "job", "family", "label"), "set_id")
        found = staged(rows.groupBy("job").applyInPandas(_compare(percent), "a long, b long"), "round-links")
        links = links.union(found)
        labels = _labelled(large, links)
    # in each family the sets of its largest part, and the rest
    parts = labels.groupBy("family", "label").agg(F.count(F.lit(1)).alias("many"))
    most = parts.groupBy("family").agg(F.max_by("label", F.struct("many", "label")).alias("main"))
    cells = labels.join(most, "family").withColumn("main", (F.col("label") == F.col("main")).cast("int"))
    cells = cells.withColumn("level", F.floor(F.col("step") / 4).cast("int")).withColumn("part", F.pmod("step", F.lit(4)))
    sizes = staged(cells.groupBy("family", "level", "main").agg(_cuts(block, block_shingles).alias("cuts")), "family-cells")
    cells = cells.join(sizes, ["family", "level", "main"]).withColumn("cut", F.pmod(F.xxhash64("set_id"), F.col("cuts").cast("long")).cast("int"))
    one = sizes.select("family", F.col("level").alias("l1"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("c1"), F.col("main").alias("m1"))
    rest = one.filter("m1 = 0")
    # pairs of blocks, not of sets, one of them of the rest; such a block on its own only where its class has no other
    others = one.toDF("family", "l2", "c2", "m2")
    alone = sizes.groupBy("family", F.col("level").alias("l1")).agg(F.sum("cuts").alias("blocks"))
    same = rest.join(others.withColumn("l1", F.col("l2")), ["family", "l1"]).filter("m2 = 1 OR c1 < c2")
    single = rest.join(alone, ["family", "l1"]).filter("blocks = 1").select("family", "l1", "c1", "m1", F.col("l1").alias("l2"), F.col("c1").alias("c2"), F.col("m1").alias("m2"))
    up = one.join(others.withColumn("l1", F.col("l2") - 1), ["family", "l1"]).filter("m1 = 0 OR m2 = 0")
    order = ["family", "l1", "c1", "m1", "l2", "c2", "m2"]
    jobs = same.select(*order).union(single.select(*order)).union(up.select(*order)).withColumn("job", F.xxhash64(*order))
    end = lambda k: F.struct(F.col(f"l{k}").alias("level"), F.col(f"c{k}").alias("cut"), F.col(f"m{k}").alias("main"), (k * (F.col("l1") < F.col("l2")).cast("int")).alias("end"))
    needs = jobs.select("family", "job", F.explode(F.array_distinct(F.array(end(1), end(2)))).alias("x")).select("family", "job", "x.*")
    dealt = cells.join(needs, ["family", "level", "cut", "main"]).filter("end = 0 OR end = 1 AND part = 3 OR end = 2 AND part = 0").select("set_id", "job", "family", "label")
    rows = large.select("set_id", "shingles").join(dealt, "set_id")
    return links.union(rows.groupBy("job").applyInPandas(_compare(percent), "a long, b long"))


def verified_links(sets: DataFrame, families: DataFrame, percent: int = PERCENT, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, over: tuple[DataFrame, ...] = ()) -> DataFrame:
    """(a, b): links between similar sets that connect all that similar sets connect.

    Small families are compared whole, many to a job; large ones as large_links() says. The
    staged tables ``over`` are deleted once the sets of families have been taken out of ``sets``.
    """
    ship(sets.sparkSession)
    members = families.select(F.col("id").alias("set_id"), F.col("component").alias("family"))
    sizes = sets.select("set_id", "n_shingles").distinct().join(members, "set_id").groupBy("family").agg(F.count(F.lit(1)).alias("many"), F.sum("n_shingles").alias("total"))
    sizes = staged(sizes.select("family", "total", ((F.col("many") > block) | (F.col("total") > block_shingles)).alias("large")), "family-sizes")
    bins = max(1, int((sizes.filter("NOT large").agg(F.sum("total")).first()[0] or 0) // block_shingles) + 1)
    members = join_hot(members, sizes.select("family", "large"), "family")
    rows = only_ids(sets, "set_id", members).join(members, "set_id").dropDuplicates(["set_id"])
    # classes span four steps of what similar sizes may differ by; only their last and first steps meet others
    step = F.floor(F.log("n_shingles") / float(np.log(100 / percent))).cast("int")
    rows = staged(rows.select("family", "large", "set_id", F.col("n_shingles").alias("n"), step.alias("step"), "shingles"), "family-sets")
    discard(*over)
    forget_shuffles(sets.sparkSession)
    small = rows.filter("NOT large").select(F.pmod(F.xxhash64("family"), F.lit(bins)).alias("job"), "family", "set_id", F.col("set_id").alias("label"), "shingles")
    links = small.groupBy("job").applyInPandas(_compare(percent), "a long, b long")
    if not sizes.filter("large").isEmpty():
        links = links.union(large_links(rows.filter("large"), percent, block, block_shingles))
    out = staged(links, "links")
    discard(rows)
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest doc_id that links reach), n_links.

    Documents link when their shingle sets (five words, A-Z as a-z; a shorter text's words as
    one) have a Jaccard similarity of ``percent`` hundredths or more. n_links counts this
    row's set's links in the spanning forest, plus its other copies. Null and empty texts,
    and texts without words, have no shingles and are alone. A null doc_id is never a
    component's smallest; alone, its component_id is null. Repeated rows are copies; an empty
    table gives no rows; other columns are ignored.
    """
    rows, per_set = _classes(docs.select("doc_id", "text"), percent, shingle, block, block_shingles)
    named = per_set.groupBy("component").agg(F.min("least").alias("component_id"))
    per_set = join_hot(per_set, named, "component").select("set_id", "component_id", "n_links")
    found = rows.join(per_set, "set_id", "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _classes(docs: DataFrame, percent: int, shingle: int, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """On disk, the rows of docs (all columns but text, n_shingles, set_id), and per set: set_id, component, least (doc_id), n_links."""
    all_rows = set_ids(docs, shingle)
    rows = staged(all_rows.drop("check", "shingles"), "set-rows")
    sets = all_rows.filter(F.col("shingles").isNotNull()).select("set_id", "n_shingles", "shingles")
    families = families_apart(sets, candidate_families(sets, percent, True), percent, block)
    links = verified_links(sets, families, percent, block, block_shingles, (all_rows,))
    classes = components(links)
    degree = links.select(F.col("a").alias("id")).union(links.select("b")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    per_set = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    per_set = per_set.join(classes.withColumnRenamed("id", "set_id"), "set_id", "left").join(degree.withColumnRenamed("id", "set_id"), "set_id", "left")
    n_links = F.coalesce("degree", F.lit(0)) + F.col("copies") - 1
    return rows, staged(per_set.select("set_id", F.coalesce("component", "set_id").alias("component"), "least", n_links.alias("n_links")), "set-classes")


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns, whatever their names: one of each component.

    The one with the smallest doc_id stays (a null one only where there is no other), of
    equals that with the smallest digest of its text, and of rows that agree in both any one.
    Null texts and those without words are linked with nothing: all of them stay. An empty
    table gives no rows.
    """
    rows, per_set = _classes(docs.select("doc_id", row_key().alias("key"), "text"), percent, shingle, BLOCK, BLOCK_SHINGLES)
    best = rows.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")).alias("best"))
    kept = best.join(per_set, "set_id").groupBy("component").agg(F.min("best").alias("best")).select("best.key")
    empty = docs.filter(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return rows_with_keys(docs, kept).unionByName(empty)
