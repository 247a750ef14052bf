"""Language-model scores by a class-based bigram model (Brown).

Every word that occurs ``LEAST`` times in training has a class of its own by exchange
clustering; only rarer and unseen words go by their shape (last bytes and length). The most
frequent words and the shapes are exchanged first, on the driver. From there on all words are
exchanged in rounds: their counts by class of the neighbours are added up over the cluster,
and in each round half the words, by their hash, move where the bigram likelihood rises most.
The best assignment seen is kept. The probability of a word after another is that of its
class after the other's class, times that of the word (or its shape and the word in it) in
the class, each smoothed. Texts are kept on disk as numbers of words; a worker holds class
and count of each clustered word, 6 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import running_total, staged
from .langid import fold
from .tokens import blocks, text_blocks
from .words import hash_spans, mix64, word_spans

CORE = 1023
SHAPES = 512
CLASSES = 64
SWEEPS = 8
ALPHA = 0.1
#: Words that occur so often in training are clustered.
LEAST = 2
#: Rounds of exchange over all clustered words; half of them may move in each.
ROUNDS = 4
#: A word table with more rows than this is joined instead of read by every worker (12 bytes a row).
TABLE_ROWS = 8_000_000
#: Words in one part of the vocabulary, whose counts a task holds in a round of exchange.
PART_WORDS = 100_000
#: Counted neighbours that a task holds before it sends them on; up to which count a gain is tabled.
BUFFER, SMALL = 4_000_000, 24
BLOCK = 1_000_000
#: The end of a text, as the hash of no word.
END_HASH = np.uint64(0x0123456789ABCDEF)
_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and shape of every token of all texts, and the number of tokens of each; a text's last one is its end."""
    data, first, size, per = word_spans(texts)
    h = hash_spans(data, first, size)
    last = first + size - 1
    tail = np.zeros(len(first), np.uint64)
    for k in range(3):
        tail = tail * np.uint64(256) + np.where(size > k, data[np.maximum(last - k, 0)], 0).astype(np.uint64)
    shape = (mix64(tail * np.uint64(8) + np.minimum(size // 3, 7).astype(np.uint64)) % np.uint64(SHAPES)).astype(np.int32)
    ends = np.cumsum(per)
    return np.insert(h, ends, END_HASH), np.insert(shape, ends, 0), per + 1


def lookup(h: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place of each hash in sorted ``names``, -1 where it is missing."""
    if not len(names):
        return np.full(len(h), -1)
    # each distinct hash once and in order: the search then goes through the table from end to end
    some, which = np.unique(h, return_inverse=True)
    at = np.minimum(np.searchsorted(names, some), len(names) - 1)
    return np.where(names[at] == some, at, -1)[which]


def word_counts(train: DataFrame) -> DataFrame:
    """On disk: h, shape, n for every distinct training token, the end included."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[np.ndarray] = []

        def total(parts):
            every = np.concatenate(parts)
            names, at = np.unique(every["h"], return_index=True)
            where = np.searchsorted(names, every["h"])
            return np.rec.fromarrays([names, every["shape"][at], np.bincount(where, every["n"], len(names)).astype(np.int64)], names="h,shape,n")

        for f in frames:
            texts = [t or "" for t in f["text"]]
            for a, b in blocks(texts, BLOCK):
                h, shape, _ = tokens([t.encode() for t in texts[a:b]])
                names, at, n = np.unique(h, return_index=True, return_counts=True)
                kept.append(np.rec.fromarrays([names, shape[at], n], names="h,shape,n"))
                if len(kept) >= 16:
                    kept = [total(kept)]
                    if len(kept[0]) > 1_000_000:
                        yield pd.DataFrame({"h": kept[0]["h"].view(np.int64), "shape": kept[0]["shape"], "n": kept[0]["n"]})
                        kept = []
        if kept:
            t = total(kept)
            yield pd.DataFrame({"h": t["h"].view(np.int64), "shape": t["shape"], "n": t["n"]})

    ship(train.sparkSession)
    found = train.select("text").mapInPandas(count, "h long, shape int, n long")
    return staged(found.groupBy("h").agg(F.first("shape").alias("shape"), F.sum("n").alias("n")), "word-counts")


def word_table(train: DataFrame) -> DataFrame:
    """On disk: h, shape, n and place of every training token; clustered words are numbered by hash, others have -1."""
    counts = word_counts(train)
    often = counts.filter(F.col("n") >= LEAST).withColumn("__bucket", F.shiftright("h", 48).cast("int"))
    often = running_total(often, [], "__bucket", ["h"], None, "place").drop("__bucket")
    rare = counts.filter(F.col("n") < LEAST).withColumn("place", F.lit(-1).cast("long"))
    return staged(often.unionByName(rare).withColumn("place", F.col("place").cast("int")), "words")


def unit_streams(docs: DataFrame, table: DataFrame, words: int, joined: bool) -> DataFrame:
    """On disk: doc_id, held_out and the unit of every token: its place, or ``words`` + 2 * shape + (seen in training)."""
    kind = dict(docs.dtypes)["doc_id"]
    path = table.staged_at
    head = f"doc_id {kind}, held_out boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b, texts in text_blocks(batch, BLOCK):
                h, shape, per = tokens([t.encode() for t in texts])
                part = [batch.column("doc_id")[a:b], batch.column("held_out")[a:b]]
                ends = np.append(0, np.cumsum(per)).astype(np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
                if joined:
                    rows = pa.array(np.arange(number, number + b - a))
                    number += b - a
                    yield pa.RecordBatch.from_arrays([*part, rows, lists(h.view(np.int64)), lists(shape)], ["doc_id", "held_out", "row", "h", "shape"])
                else:
                    names, place = _table(path)
                    at = lookup(h, names)
                    unit = words + 2 * shape + (at >= 0)
                    if len(names):
                        unit = np.where((at >= 0) & (place[at] >= 0), place[at], unit)
                    yield pa.RecordBatch.from_arrays([*part, lists(unit.astype(np.int32))], ["doc_id", "held_out", "units"])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", "held_out", "text")
    if not joined:
        return staged(rows.mapInArrow(cut, f"{head}, units array<int>"), "units")
    wide = staged(rows.mapInArrow(cut, f"{head}, row long, h array<long>, shape array<int>"), "tokens")
    each = wide.select("row", F.posexplode(F.arrays_zip("h", "shape")).alias("at", "x")).select("row", "at", F.col("x.h").alias("h"), F.col("x.shape").alias("shape"))
    each = each.join(table.select("h", "place"), "h", "left")
    unit = F.when(F.col("place") >= 0, F.col("place")).otherwise(F.col("shape") * 2 + F.col("place").isNotNull().cast("int") + words)
    lists = each.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", unit.cast("int").alias("u")))).alias("x"))
    return staged(wide.select("row", "doc_id", "held_out").join(lists, "row").select("doc_id", "held_out", F.col("x.u").alias("units")), "units")


def _stream(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of all texts of a batch, the units before them (a text's last one, its end, before its first), and each text's first place."""
    units = batch.column("units")
    u, per = units.flatten().to_numpy().astype(np.int64), units.value_lengths().to_numpy().astype(np.int64)
    first = np.cumsum(per) - per
    before = np.roll(u, 1)
    before[first] = u[first + per - 1]
    return u, before, first


def _labels(path: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Label and count of every clustered word by its place; read once by a worker."""
    if path not in _tables:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSelector

        from .media import filesystem

        files, root = filesystem(path)
        label, n = np.zeros(words, np.int16), np.zeros(words, np.int64)
        for p in files.get_file_info(FileSelector(root)):
            if p.path.endswith(".parquet"):
                t = pq.read_table(p.path, columns=["place", "label", "n"], filesystem=files)
                at = t["place"].to_numpy()
                label[at], n[at] = t["label"].to_numpy(), t["n"].to_numpy()
        _tables.clear()
        _tables[path] = label, n
    return _tables[path]


def _called(u: np.ndarray, words: int, label: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """The label of every unit."""
    out = shapes[np.maximum(u - words, 0) >> 1]
    some = np.flatnonzero(u < words)
    out[some] = label[u[some]]
    return out


def label_bigrams(train: DataFrame, labels: DataFrame, shapes: np.ndarray, words: int, size: int) -> np.ndarray:
    """How often each label follows each, over the whole training text."""
    path = labels.staged_at

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            u, before, _ = _stream(batch)
            label, _ = _labels(path, words)
            key = _called(before, words, label, shapes) * size + _called(u, words, label, shapes)
            total += np.bincount(key, minlength=size * size)
        some = np.flatnonzero(total)
        for k in range(0, len(some), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[k : k + 200_000].astype(np.int32)), pa.array(total[some[k : k + 200_000]])], ["k", "n"])

    ship(train.sparkSession)
    rows = train.select("units").mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    # at most size squared counts, as one blob for each row of them at most
    out = np.zeros(size * size, np.int64)
    blobs = rows.groupBy((F.col("k") / size).cast("int").alias("row")).agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("x"))
    for r in blobs.select(F.col("x.k").alias("k"), F.col("x.n").alias("n")).toPandas().itertuples():
        out[np.asarray(r.k)] = np.asarray(r.n)
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-9))


def likelihood(pair: np.ndarray) -> float:
    """Of the training text under class bigrams, without the part that classes do not change."""
    return float(_xlogx(pair.astype(float)).sum() - _xlogx(pair.sum(1).astype(float)).sum() - _xlogx(pair.sum(0).astype(float)).sum())


def best_class(who: np.ndarray, k: np.ndarray, n: np.ndarray, own: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """The class in which each word adds most to the likelihood, all others staying.

    Entries (who, k, n), sorted by who: n times the neighbour's class is k (after the word), or
    k - classes (before it). own: each word's class.
    """
    classes, words = len(pair), len(own)
    pair = pair.astype(float)
    rows, cols = pair.sum(1), pair.sum(0)
    lines = np.concatenate([pair.T, pair])  # by k: the counts with each class a word may be in
    base = _xlogx(lines)
    # most entries have a small n: what these add is worked out once for each k and n
    small = np.stack([_xlogx(lines + x) - base for x in range(SMALL + 1)])
    gain = np.zeros((words, classes))
    freq = np.bincount(who, n * (k < classes), words)[:, None]
    for a in range(0, len(who), 50_000):
        w, at, x = who[a : a + 50_000], k[a : a + 50_000], n[a : a + 50_000].astype(float)
        add = small[np.minimum(n[a : a + 50_000], SMALL).astype(np.int64), at]
        more = np.flatnonzero(x > SMALL)
        add[more] = _xlogx(lines[at[more]] + x[more, None]) - base[at[more]]
        stays = lines[at, own[w]]
        add[np.arange(len(w)), own[w]] = _xlogx(stays) - _xlogx(np.maximum(stays - x, 0))
        start = np.flatnonzero(np.diff(w, prepend=-1))
        gain[w[start]] += np.add.reduceat(add, start)
    for total in (rows, cols):
        lost = _xlogx(total + freq) - _xlogx(np.broadcast_to(total, gain.shape))
        at = np.arange(words), own
        lost[at] = _xlogx(total[own]) - _xlogx(np.maximum(total[own] - freq[:, 0], 0))
        gain -= lost
    best = gain.argmax(1)
    return np.where(gain[np.arange(words), best] > gain[np.arange(words), own] + 1e-6, best, own)


def exchange_round(train: DataFrame, labels: DataFrame, shapes: np.ndarray, words: int, pair: np.ndarray, turn: int) -> DataFrame:
    """On disk, the labels after half the words, those of one parity, have moved to their best class.

    Tasks count neighbours' classes and send the counts, packed, to the part of the vocabulary
    that a word's place belongs to; a task of the second stage has all counts of its part.
    """
    path, classes = labels.staged_at, len(pair)
    wide = 2 * classes
    parts = max(1, words // PART_WORDS)

    def packed(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        cuts = np.searchsorted(key, np.arange(parts + 1) * -(-words // parts) * wide)
        cuts[-1] = len(key)
        some = np.flatnonzero(np.diff(cuts))
        data = [key[cuts[p] : cuts[p + 1]].tobytes() + n[cuts[p] : cuts[p + 1]].astype(np.uint32).tobytes() for p in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(data, pa.binary())], ["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        held = 0
        for batch in batches:
            u, before, _ = _stream(batch)
            label, _ = _labels(path, words)
            after, to = _called(u, words, label, shapes), _called(before, words, label, shapes)
            own, left = (u < words) & (u % 2 == turn % 2), (before < words) & (before % 2 == turn % 2)
            kept += [before[left] * wide + after[left], u[own] * wide + classes + to[own]]
            held += len(kept[-1]) + len(kept[-2])
            if held >= BUFFER:
                yield packed(kept)
                kept, held = [], 0
        if held:
            yield packed(kept)

    def merged(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, n = (np.concatenate(x) for x in zip(*kept))
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        start = np.flatnonzero(np.diff(key, prepend=-1))
        return key[start], np.add.reduceat(n, start)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0
        for batch in batches:
            for data in batch.column("data").to_pylist():
                many = len(data) // 12
                kept.append((np.frombuffer(data, np.int64, many), np.frombuffer(data, np.uint32, many, 8 * many).astype(np.int64)))
                held += many
                if held >= 2 * BUFFER:
                    kept = [merged(kept)]
                    held = len(kept[0][0]) // 2  # what is merged only grows when there is more of it
        if not kept:
            return
        key, n = merged(kept)
        label, _ = _labels(path, words)
        who = key // wide
        start = np.flatnonzero(np.diff(who, prepend=-1))
        start = np.append(start, len(who))
        for a in range(0, len(start) - 1, 10_000):  # a row of gains for each word
            cut = start[a : a + 10_001]
            some = slice(cut[0], cut[-1])
            place = who[cut[:-1]]
            best = best_class(np.repeat(np.arange(len(place)), np.diff(cut)), key[some] % wide, n[some], label[place].astype(np.int64), pair)
            yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int32)), pa.array(best.astype(np.int32))], ["place", "to"])

    ship(train.sparkSession)
    found = train.select("units").mapInArrow(count, "part int, data binary")
    moved = found.repartitionById(parts, F.col("part")).select("data").mapInArrow(choose, "place int, to int")
    return staged(labels.join(moved, "place", "left").select("place", "n", F.coalesce("to", "label").alias("label")), "classes")


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each unit: each unit in turn, frequent ones first, moves where the bigram likelihood rises most."""
    n = bigrams.astype(float)
    freq = n.sum(0)
    units = len(n)
    order = np.argsort(-freq, kind="stable")
    cls = np.zeros(units, np.int64)
    cls[order] = np.arange(units) % classes
    to = np.zeros((units, classes))  # how often a class follows a unit
    of = np.zeros((units, classes))  # how often a class precedes a unit
    for c in range(classes):
        to[:, c], of[:, c] = n[:, cls == c].sum(1), n[cls == c].sum(0)
    pair = np.stack([to[cls == c].sum(0) for c in range(classes)])
    size = np.bincount(cls, freq, classes)

    def f(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-9))

    for _ in range(sweeps):
        moved = 0
        for u in order:
            if not freq[u]:
                continue
            a, own = cls[u], n[u, u]
            right, left = to[u].copy(), of[u].copy()
            right[a] -= own
            left[a] -= own
            g = pair.copy()
            g[a] -= right
            g[:, a] -= left
            g[a, a] -= own
            m = size.copy()
            m[a] -= freq[u]
            rows, cols, diag = f(g + right) - f(g), f(g.T + left) - f(g.T), np.diag(g)
            gain = rows.sum(1) - np.diag(rows) + cols.sum(1) - np.diag(cols) + f(diag + left + right + own) - f(diag) - 2 * (f(m + freq[u]) - f(m))
            b = int(gain.argmax())
            if b != a and gain[b] > gain[a] + 1e-9:
                g[b] += right
                g[:, b] += left
                g[b, b] += own
                pair, size, cls[u] = g, m, b
                size[b] += freq[u]
                to[:, a] -= n[:, u]
                to[:, b] += n[:, u]
                of[:, a] -= n[u]
                of[:, b] += n[u]
                moved += 1
        if not moved:
            break
    return cls


def cluster(train: DataFrame, table: DataFrame, words: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Classes of all clustered words (place, n, label; on disk), of the shapes, and how often each class follows each."""
    often = table.filter("place >= 0")
    core = [r["h"] for r in often.orderBy(F.desc("n"), "h").limit(CORE).select("h").collect()]
    first = train.sparkSession.createDataFrame([(h, k) for k, h in enumerate(core)], "h long, core int")
    shapes = np.arange(CORE, CORE + SHAPES)
    start = often.join(F.broadcast(first), "h", "left").select("place", "n", F.coalesce("core", F.col("shape") + CORE).alias("label"))
    start = staged(start, "coarse")
    cls = exchange(label_bigrams(train, start, shapes, words, CORE + SHAPES))
    # a class for every coarse unit: all words begin where their unit is
    classes = F.element_at(F.lit(cls.tolist()), F.col("label") + 1).cast("int")
    labels, shapes = staged(start.select("place", "n", classes.alias("label")), "classes"), cls[CORE:]
    pair = label_bigrams(train, labels, shapes, words, CLASSES)
    for turn in range(ROUNDS if words else 0):
        moved = exchange_round(train, labels, shapes, words, pair, turn)
        now = label_bigrams(train, moved, shapes, words, CLASSES)
        if likelihood(now) <= likelihood(pair):
            continue
        labels, pair = moved, now
    return labels, shapes, pair


def fit(train: DataFrame, table: DataFrame, words: int) -> dict:
    """The bounded part of the model: log10 of class and shape probabilities, class totals; and where the words' classes are."""
    whole = table.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    labels, shapes, pair = cluster(train, table, words)
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for r in table.filter("place < 0").groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        shape_n[r["shape"]], shape_v[r["shape"]] = r["n"], r["v"]
    class_n, many = np.bincount(shapes, shape_n, CLASSES), np.bincount(shapes, minlength=CLASSES)
    for r in labels.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        class_n[r["label"]] += r["n"]
        many[r["label"]] += r["v"]
    inside = np.log10(class_n + ALPHA * np.maximum(many, 1))
    return {
        "labels": labels.staged_at, "shapes": shapes, "after": np.log10((pair + ALPHA) / (pair.sum(1, keepdims=True) + ALPHA * CLASSES)), "inside": inside,
        "shape": np.log10(shape_n + ALPHA) - inside[shapes] - np.log10(shape_n + shape_v + 1), "words": words, "n": int(whole["n"] or 0), "v": int(whole["v"] or 0),
    }


def _table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The staged word table's hashes, sorted, and their places; read once by a worker."""
    if path not in _tables:
        import pyarrow.parquet as pq

        from .media import filesystem

        files, root = filesystem(path)
        from pyarrow.fs import FileSelector

        parts = [pq.read_table(p.path, columns=["h", "place"], filesystem=files) for p in files.get_file_info(FileSelector(root)) if p.path.endswith(".parquet")]
        t = pa.concat_tables(parts)
        h, place = t["h"].to_numpy().view(np.uint64), t["place"].to_numpy()
        order = np.argsort(h)
        _tables.clear()
        _tables[path] = h[order], place[order]
    return _tables[path]


def score(docs: DataFrame, held_out: int = 2, parts: int = 7, table_rows: int = TABLE_ROWS) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on the rows outside fold ``held_out``. Null text is an end alone; repeated rows
    score alike; without training rows every count is 0; an empty table gives no rows; other
    columns are ignored.
    """
    spark = ship(docs.sparkSession)
    out = fold(F.col("doc_id"), parts) == held_out
    table = word_table(docs.filter(~out).select("doc_id", "text"))
    size = table.agg(F.count(F.lit(1)).alias("v"), F.count(F.when(F.col("place") >= 0, 1)).alias("words")).first()
    words = size["words"]
    streams = unit_streams(docs.select("doc_id", out.alias("held_out"), "text"), table, words, size["v"] > table_rows)
    model = fit(streams.filter(~F.col("held_out")), table, words)
    total = model["n"] + model["v"] + 1
    shared = spark.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)["doc_id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            u, before, first = _stream(batch)
            label, n = _labels(m["labels"], words)
            cls = _called(u, words, label, m["shapes"])
            c = (np.maximum(u - words, 0) & 1).astype(np.float64)
            some, other = np.flatnonzero(u < words), np.flatnonzero(u >= words)
            c[some] = n[u[some]]
            own = m["after"][_called(before, words, label, m["shapes"]), cls]
            own[some] += np.log10(c[some] + ALPHA) - m["inside"][cls[some]]
            own[other] += m["shape"][(u[other] - words) >> 1] + np.log10(c[other] + 1)
            sums = [np.add.reduceat((c > 0).astype(np.int64), first), np.add.reduceat(np.log10((c + 1) / total), first), np.add.reduceat(own, first)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), batch.column("units").value_lengths().cast(pa.int64()), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    found = streams.mapInArrow(whole, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return found.withColumn("train_tokens", F.lit(model["n"]).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
