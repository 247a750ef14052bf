"""Operators that give a row for each document, against plain Python on whole tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sqlassay.llm import brown, common, components, exact, hilbert, induced, jaccard, langid, media, mixing, packing, suffix, token_shards
from sqlassay.llm.tokens import WordEncoder, tokenizer_path

from .conftest import texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def mix_targets(sizes):
    """Plain rounds of sharing: sources over their cap leave, the rest share again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, live, rest = {}, set(order), 1.5 * sum(sizes.values())
    while live:
        share = {s: rest * weight[s] / sum(weight[x] for x in live) for s in live}
        over = {s for s in live if share[s] > 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in over} if over else share
        rest -= sum(2 * sizes[s] for s in over)
        live = live - over if over else set()
    return target


def assert_mix(table):
    mix = mixing.mix_sources(table)
    got = mixing.taken_rows(mix).collect()
    every = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in table.collect()]
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter(every)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for _, s, n in every:
        sizes[s] += n
        largest[s] = max(largest[s], n)
    for r in got:
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    target = mix_targets(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    for s in sizes:  # half a document at most, repeated rows or not
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
    again = mixing.taken_rows(mixing.mix_sources(table.repartition(3))).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mixed_documents(table)
    assert mixed.columns == table.columns
    want = Counter()
    for r in got:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixed.collect()) == +want
    content = Counter((r["doc_id"], r["text"]) for r in table.collect())
    assert all((r["doc_id"], r["text"]) in content for r in mixed.collect())


def test_mix(table):
    assert_mix(table)


def test_mix_cuts_inside_repeated_rows(spark):
    # 2000 rows without an id, all of 5 words, and another source: targets lie inside the group
    rows = [(None, "one two three four five", "a")] * 2000 + [(7, "w " * 50, "b")] * 60 + [(k, "x y z", "c") for k in range(40)]
    assert_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_rows_dealt_one_by_one(spark):
    groups = spark.createDataFrame([(1, 0), (2, 1), (3, 10_000), (None, 3)], "g long, n long")
    got = Counter((r["g"], r["k"]) for r in common.one_by_one(groups, "n", "k", most=7).collect())
    want = [(2, 1), *((3, k) for k in range(1, 10_001)), *((None, k) for k in (1, 2, 3))]
    assert got == Counter(want)


def test_join_on_hot_values(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    table = spark.range(3000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = common.join_hot(rows, table, "k", least=100)
    assert got.count() == 2000 and got.filter("v <> 2 * k").isEmpty() and got.columns == ["k", "id", "v"]


@pytest.mark.parametrize("bits", [64, 4])
def test_exact(table, bits):
    rows = texts(table)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact.exact_groups(table, bits).collect()
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert Counter((r["doc_id"], sha[r["text_sha256"]]) for r in got) == Counter(rows)
    for r in got:
        ids = [i for i in groups[sha[r["text_sha256"]]]]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert Counter(sha[r["text_sha256"]] for r in got if r["kept"]) == Counter(groups.keys())
    kept = exact.exact_dedup(table, bits)
    assert kept.columns == table.columns
    rows = Counter(map(tuple, kept.collect()))
    assert Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((max((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())
    assert rows <= Counter(map(tuple, table.collect()))


def test_repeats(table):
    rows = texts(table)
    data = {t: t.encode() for _, t in rows}
    starts = Counter(hash(b[k : k + 200]) for _, t in rows for b in (data[t],) for k in range(len(b) - 199))
    want = []
    for i, t in rows:
        b, gone = data[t], np.zeros(len(data[t]) + 1, int)
        for k in range(len(b) - 199):
            if starts[hash(b[k : k + 200])] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffix.remove_repeats(table, shard_bytes=20_000, limit=3000).collect()]
    assert Counter(got) == Counter(want)


def test_common_minimizers_are_split(spark):
    # one phrase in different surroundings in all texts, and a passage that some share around it
    rng = np.random.default_rng(7)
    some = lambda n: "".join(rng.choice(list("abcdefghij klmnop"), n))
    _, at, many, key = suffix.windows([(sea := some(300_000)).encode()], 200, 32)
    low = int(at[key.argmin()] + many[key.argmin()] - 1)  # the piece of the smallest hash
    phrase, passage = sea[low : low + 32] + some(8), some(200)
    rows = [(k, some(150) + phrase + (passage if k % 8 == 0 else some(150)) + some(40)) for k in range(80)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = [suffix.window_texts(suffix.distinct_texts(table, 200), 200, hot).groupBy("key").agg(F.countDistinct("sid").alias("n")).agg(F.max("n")).first()[0] for hot in (10**9, 20)]
    assert found[0] > 40 and found[1] <= 20
    plain, split = (Counter(map(tuple, suffix.remove_repeats(table, shard_bytes=5000, limit=50, hot=hot).collect())) for hot in (10**9, 20))
    starts = Counter(t[k : k + 200] for _, t in rows for k in range(len(t) - 199))
    gone = {i: sum(any(starts[t[k : k + 200]] > 1 for k in range(max(0, x - 199), min(x, len(t) - 200) + 1)) for x in range(len(t))) for i, t in rows}
    assert plain == split and {r[0]: r[2] for r in split} == gone and any(gone.values())


def test_media(table):
    got = media.media_columns(table).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len(t.encode())) for i, t in texts(table))
    by = defaultdict(set)
    want = {}
    for _, t in texts(table):
        p = media.payload(t.encode())
        want[hashlib.sha256(p).hexdigest()] = p
    for r in got:
        p = want[r["payload_sha256"]]
        png = media.to_png(p)
        assert (r["payload_bytes"], r["tail_crc32"]) == (len(p), zlib.crc32(p[-16:])) and len(p) % 192 == 0 and len(p) > 0
        assert (r["media_bytes"], r["media_sha256"]) == (len(png), hashlib.sha256(png).hexdigest())
        by[r["payload_sha256"]].add(tuple(r)[2:8])
    assert all(len(v) == 1 for v in by.values())


def test_media_store(odd, spark, tmp_path):
    # by the standard library's own tar reader and an inflate of our own: every payload is stored once
    import tarfile

    objects = media.store_texts(odd.repartition(5), f"file://{tmp_path}")
    want = {hashlib.sha256(media.payload(t.encode())).hexdigest(): media.payload(t.encode()) for _, t in texts(odd)}
    stored = Counter()
    for shard in tmp_path.glob("*.tar"):
        with tarfile.open(shard) as tar:
            for member in tar:
                png = tar.extractfile(member).read()
                width, height = (int.from_bytes(png[x : x + 4], "big") for x in (16, 20))
                at, body = 8, b""
                while at < len(png):
                    size = int.from_bytes(png[at : at + 4], "big")
                    body += png[at + 8 : at + 8 + size] if png[at + 4 : at + 8] == b"IDAT" else b""
                    at += size + 12
                lines = zlib.decompress(body)
                assert b"".join(lines[k * (width + 1) + 1 : (k + 1) * (width + 1)] for k in range(height)) == want[member.name[:-4]]
                stored[member.name[:-4]] += 1
    assert stored == Counter(want.keys()) and Counter(r["digest"] for r in objects.collect()) == stored
    for r in media.with_metadata(objects, f"file://{tmp_path}").collect():
        assert r["width"] == 192 and r["bit_depth"] == 8 and r["height"] * 192 == len(want[r["digest"]])
    with pytest.raises(ValueError):
        media.from_png(media.to_png(b"x" * 192)[:-20] + b"\0" * 20)


def test_media_features():
    p = bytes(range(192)) * 2
    x = [sum(p[k * 6 : k * 6 + 6]) / 6 for k in range(64)]
    mean = sum(x) / 64
    bits = int("".join("1" if v > mean else "0" for v in x), 2).to_bytes(8, "big").hex()
    got = media.features(p)
    assert got[2] == bits and got[0] == pytest.approx(sum(p) / len(p)) and got[1] == pytest.approx((sum((v - got[0]) ** 2 for v in p) / len(p)) ** 0.5)


def test_class_bigrams(table):
    import math

    rows = [(i, [lower(w) for w in WORD.findall(t)] and [w for w in WORD.findall(lower(t))]) for i, t in texts(table)]
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows}
    counts = Counter(w for i, ws in rows if not fold[i] for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    base = {(i, tuple(ws)): sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in [*ws, None]) for i, ws in rows}
    by_table = brown.score(table).collect()
    joined = brown.score(table, table_rows=-1).collect()
    key = lambda r: (r["n_tokens"], r["n_known"], round(r["base_score"], 6), str(r["doc_id"]))
    for a, b in zip(sorted(by_table, key=key), sorted(joined, key=key)):
        assert a["train_tokens"] == n and a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"]) and a["n_known"] == b["n_known"]
        assert a["held_out"] == fold[a["doc_id"]]
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in by_table)
    assert got == Counter((i, len(ws) + 1, sum(w in counts for w in [*ws, None]), round(base[i, tuple(ws)], 4)) for i, ws in rows)


def test_class_bigram_probabilities(docs):
    # every text's score once more in plain Python, from the classes alone
    import math

    rows = [(i, [*WORD.findall(lower(t)), None]) for i, t in texts(docs)]
    train = [ws for i, ws in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    n = Counter(w for ws in train for w in ws)
    folded = langid.fold(F.col("doc_id"), 7) == 2
    table = brown.word_table(docs.filter(~folded).select("doc_id", "text"))
    words = table.filter("place >= 0").count()
    streams = brown.unit_streams(docs.select("doc_id", folded.alias("held_out"), "text"), table, words, False)
    model = brown.fit(streams.filter("NOT held_out"), table, words)
    place = {r["h"]: r["place"] for r in table.collect()}
    label = {r["place"]: r["label"] for r in docs.sparkSession.read.parquet(model["labels"]).collect()}
    known = {}
    for w in {w for _, ws in rows for w in ws}:
        h, shape, _ = brown.tokens([b"" if w is None else w.encode()])
        own = int(h[:1].view(np.int64)[0])
        clustered = n[w] >= brown.LEAST
        assert clustered == (place.get(own, -1) >= 0)
        known[w] = (label[place[own]], None) if clustered else (int(model["shapes"][shape[0]]), int(shape[0]))
    pair, inside, many, shape_n, shape_v = Counter(), Counter(), Counter(int(c) for c in model["shapes"]), Counter(), Counter()
    for ws in train:
        pair.update((known[a][0], known[b][0]) for a, b in zip([None, *ws], ws))
    for w, c in n.items():
        inside[known[w][0]] += c
        if known[w][1] is None:
            many[known[w][0]] += 1
        else:
            shape_n[known[w][1]] += c
            shape_v[known[w][1]] += 1
    first = Counter()
    for (a, _), c in pair.items():
        first[a] += c

    def log_p(a, b):
        c, shape = known[b]
        p = (pair[known[a][0], c] + brown.ALPHA) / (first[known[a][0]] + brown.ALPHA * brown.CLASSES) / (inside[c] + brown.ALPHA * max(many[c], 1))
        return math.log10(p * (n[b] + brown.ALPHA) if shape is None else p * (shape_n[shape] + brown.ALPHA) * (n[b] + 1) / (shape_n[shape] + shape_v[shape] + 1))

    want = {i: sum(log_p(a, b) for a, b in zip([None, *ws], ws)) for i, ws in rows}
    assert {r["doc_id"]: r["score"] for r in brown.score(docs).collect()} == pytest.approx(want)


def test_class_bigrams_beat_the_base(docs):
    held = [r for r in brown.score(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_exchange_finds_classes():
    n = np.zeros((4, 4), int)
    n[np.ix_([0, 1], [2, 3])] = 50
    n[np.ix_([2, 3], [0, 1])] = 50
    cls = brown.exchange(n, classes=2)
    assert cls[0] == cls[1] != cls[2] == cls[3]


def test_class_bigrams_cluster_every_repeated_word(spark, monkeypatch):
    # words of one shape, outside the core, differ by their neighbours alone
    monkeypatch.setattr(brown, "CORE", 6)
    rows = [(k, " ".join(f"le {a}xyz ri la {b}xyz ro" for a, b in zip("abcdefgh", "ijklmnop"))) for k in range(30)]
    train = spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", F.lit(False))
    table = brown.word_table(train)
    words = table.filter("place >= 0").count()
    assert words == table.count() == 16 + 4 + 1
    streams = brown.unit_streams(train, table, words, False)
    labels = brown.cluster(streams, table, words)[0]
    of = {r["h"]: r["label"] for r in labels.join(table.select("place", "h"), "place").collect()}
    h = {w: of[int(brown.tokens([f"{w}xyz".encode()])[0][:1].view(np.int64)[0])] for w in "abcdefghijklmnop"}
    assert not {h[w] for w in "abcdefgh"} & {h[w] for w in "ijklmnop"}


def shingles(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def near_classes(names):
    """text -> one text that stands for its class, none without words; by comparing all pairs."""
    sets = {t: shingles(t) for t in names}
    names = list(sets)
    up = {t: t for t in names}

    def root(t):
        while up[t] != t:
            t = up[t]
        return t

    for x, a in enumerate(names):
        for b in names[:x]:
            i = len(sets[a] & sets[b])
            if sets[a] and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                up[root(a)] = root(b)
    return {t: root(t) if sets[t] else None for t in names}


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates(table, small_blocks):
    rows = texts(table)
    sets = {t: shingles(t) for _, t in rows}
    root = near_classes([t for _, t in rows]).get
    least = defaultdict(list)
    for i, t in rows:
        if sets[t] and i is not None:
            least[root(t)].append(i)
    want = Counter((i, len(sets[t]), min(least[root(t)], default=None) if sets[t] else i) for i, t in rows)
    options = {"block": 2, "block_shingles": 300} if small_blocks else {}
    got = jaccard.near_duplicates(table, **options).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want
    if not small_blocks:
        kept = jaccard.keep_one(table)
        assert kept.columns == table.columns
        groups = defaultdict(list)
        for i, t in rows:
            if sets[t]:
                groups[root(t)].append((i is None, i or 0, hashlib.sha256(t.encode()).digest(), t))
        want = Counter((None if g[0] else g[1], g[3]) for g in map(min, groups.values())) + Counter((i, t) for i, t in rows if not sets[t])
        assert Counter(texts(kept)) == want


@pytest.mark.parametrize("many, sets", [(0, 1), (5, 5), (4000, 7), (90_000, 80_000)])
def test_signatures_travel_whole(many, sets):
    rng = np.random.default_rng(many)
    sig, ids = np.sort(rng.integers(0, 2**64, many, dtype=np.uint64)), rng.integers(-(2**63), 2**63, sets)[rng.integers(0, sets, many)]
    short, back = jaccard._unpacked(jaccard._packed(sig, ids))
    assert (short == sig >> np.uint64(24)).all() and (back == ids).all()


def test_sets_whose_ids_clash(docs):
    # ids of 6 bits: most sets share one, and a second hash tells them apart
    plain, short = (jaccard.set_ids(docs.select("doc_id", "text"), bits=bits).select("doc_id", "set_id") for bits in (64, 6))
    group = lambda df: Counter(tuple(sorted(r["x"])) for r in df.filter("set_id IS NOT NULL").groupBy("set_id").agg(F.collect_list("doc_id").alias("x")).collect())
    assert group(plain) == group(short)


def test_large_family(spark):
    # a family of many times what a block holds: near copies of one text, and another group that a chain ties to it
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in rng.permutation(4000)]
    base, rows = words[:120], []
    for k in range(600):
        t = list(base)
        t[int(rng.integers(120))] = f"x{k}"
        rows.append((k, " ".join(t)))
    for k in range(1, 60):  # each is like the one before alone
        rows.append((1000 + k, " ".join(base[2 * k :] + words[200 : 200 + 2 * k])))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=32).collect()}
    sets = {i: frozenset(zip(*(t.split()[k:] for k in range(5)))) for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and root(a) != root(b):
                n = len(sets[a] & sets[b])
                if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                    up[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {i: root(i) for i in sets}


@pytest.mark.parametrize("task_links", [10**6, 60])
def test_components(spark, task_links):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-300, 300, (150, 2))] + [(1000, 1000 + k) for k in range(1, 60)] + [(2000 + k, 2001 + k) for k in range(20)] + [(5, 5)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long"), task_links).collect()}
    assert all(got.get(x, x) == root(x) for x in up)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(3)
    for n in (1, 2, 4, 5, 6, 9, 20, 60, 300):
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**40, n, dtype=np.uint64))
            b = a.copy()
            while True:
                c = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 and len(b) > 1 else np.unique(np.append(b, rng.integers(0, 2**40, dtype=np.uint64)))
                if not jaccard.similar(a, c):
                    break
                b = c
                if rng.random() < 0.02:
                    break
            hot = np.sort(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
            sig, who = jaccard.signatures([a, b], hot)
            assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_hilbert(table, spark):
    got = hilbert.hilbert_shards(table).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r["slot"])
    assert set(shards) == set(range(8)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in shards.values())
    assert [r["hilbert"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))] == sorted(r["hilbert"] for r in got)


def test_hilbert_cuts_of_many_values(spark):
    # more distinct values than 65536, all with one prefix
    rows = spark.range(70_000).select(F.format_string("source-%06d", "id").alias("source"))
    _, cuts = hilbert._cuts(rows, "source", 4)
    assert cuts == [f"source-{-(-70_000 * k // 16):06d}" for k in range(1, 16)]


def test_hilbert_curve_is_a_path(spark):
    from pyspark.sql import functions as F

    cells = spark.range(512).select(F.array(*[(F.shiftright("id", 3 * k) % 8).cast("int") for k in range(3)]).alias("c"))
    rows = sorted((r["h"], r["c"]) for r in cells.select("c", hilbert.hilbert_index(F.col("c"), 3, 3).alias("h")).collect())
    assert [h for h, _ in rows] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(a, b)) == 1 for (_, a), (_, b) in zip(rows, rows[1:]))


def test_shards_on_disk(table, spark, tmp_path):
    plan = hilbert.write_shards(table, str(tmp_path / "s"))
    got = spark.read.parquet(str(tmp_path / "s"))
    new = [c for c in got.columns if c not in table.columns]
    assert sorted(new) == (["shard", "slot"] if "shard" not in table.columns else ["shard_", "slot_"])
    name = {c.rstrip("_"): c for c in new}
    assert Counter(map(tuple, got.select(*table.columns).collect())) == Counter(map(tuple, table.collect()))
    key = lambda r: (r["doc_id"], zlib.crc32((r["text"] or "").encode()), r[name["shard"]], r[name["slot"]])
    assert Counter(map(key, got.collect())) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in plan.collect())


def test_language(docs):
    rows = {r["doc_id"]: r for r in langid.identify(docs, ["doc_id", "lang"]).collect()}
    held = [r for r in rows.values() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held) and all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_of_odd_rows(odd):
    rows = langid.identify(odd, ["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or "")))
    kept = langid.known_language(odd)
    assert kept.columns == odd.columns and all(any(map(str.isalpha, r["text"])) for r in kept.collect())


def test_language_blocks_agree_with_one_matrix(docs):
    # the posterior by hand from the model's own tables, in one block of languages and in blocks of one
    whole, parts = (langid.identify(docs, ["doc_id"], block=n) for n in (512, 1))
    a, b = ({r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in x.collect()} for x in (whole, parts))
    assert a == b
    (langs, logp, prior), = langid.fit(docs.filter(langid.fold(F.col("doc_id"), 4) != 2))
    for r in docs.limit(20).collect():
        grams, _, letter = langid.hashed_ngrams([r["text"] or ""])
        total = prior + sum(logp[h].astype(float).sum(0) for h in grams)
        total = np.exp(total - total.max())
        if letter[0]:
            assert a[r["doc_id"]] == (langs[total.argmax()], pytest.approx(total.max() / total.sum(), abs=1e-6))


def test_language_needs_no_labels(odd):
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string")), ["doc_id"]).collect()} == {"und"}


def test_documents_stay_without_labels(odd):
    plain = odd.withColumn("lang", F.lit(None).cast("string"))
    kept = langid.known_language(plain)
    want = Counter((i, t) for i, t in texts(odd) if any(map(str.isalpha, t)))
    assert kept.columns == plain.columns and Counter(texts(kept)) == want and want


def pieces_of(rows):
    """Each text's ids by the public tokenizer and an end, in pieces."""
    enc = Tokenizer.from_file(tokenizer_path())
    enc.encode_special_tokens = True
    want, known = Counter(), {}
    for i, t in rows:
        if t not in known:
            ids = np.array([*enc.encode(t, add_special_tokens=False).ids, 1], "<u4")
            known[t] = [(p, p * 4096, len(x), zlib.crc32(x.tobytes())) for p in range(-(-len(ids) // 4096)) for x in (ids[p * 4096 : (p + 1) * 4096],)]
        want.update((i, *p) for p in known[t])
    return want


def test_packing(table):
    want = pieces_of(texts(table))
    got = packing.pack_documents(table).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    fill = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(r["length"] for r in got) / 4096 * 1.02 + 1


def test_packing_plan():
    rng = np.random.default_rng(1)
    for _ in range(20):
        counts = np.zeros(65, np.int64)
        for x in rng.integers(1, 65, rng.integers(0, 200)):
            counts[x] += 1
        rows, n = packing.plan(counts, 64)
        seen, room = Counter(), defaultdict(list)
        by = defaultdict(list)
        for length, first, each, seq, off in rows.tolist():
            by[length].append((first, each, seq, off))
        for length, c in enumerate(counts.tolist()):
            for k in range(c):
                first, each, seq, off = [r for r in by[length] if r[0] <= k][-1]
                room[seq + (k - first) // each].append((off + (k - first) % each * length, length))
                seen[length] += 1
        assert len(room) == n
        for parts in room.values():
            end = 0
            for off, length in sorted(parts):
                assert off == end
                end += length
            assert end <= 64


def test_token_shards(table, tmp_path):
    folder = f"file://{tmp_path}"
    got = token_shards.write_token_shards(table, folder, length=32, records=16).collect()
    enc = Tokenizer.from_file(tokenizer_path())
    enc.encode_special_tokens = True
    want = defaultdict(list)
    for i, t in texts(table):
        want[i].append([*enc.encode(t, add_special_tokens=False).ids, 1])
    n = len(got)
    assert sorted(r["slot"] for r in got) == list(range(n))
    data = token_shards.read_slots(folder, 0, n + 5, 32, 16)
    assert len(data) == n
    parts = defaultdict(list)
    for r in got:
        ids = data[r["slot"]]
        assert (r["shard"], r["record"]) == divmod(r["slot"], 16) and r["ids_crc32"] == zlib.crc32(ids[: r["n_tokens"]].tobytes()) and not ids[r["n_tokens"] :].any()
        at = 0
        for doc, start, length in zip(r["doc_ids"], r["doc_starts"], r["doc_lengths"]):
            parts[doc].append((start, ids[at : at + length].tolist()))
            at += length
        assert at == r["n_tokens"]
    assert parts.keys() == want.keys()
    for doc, whole in want.items():
        assert sum(len(x) for _, x in parts[doc]) == sum(map(len, whole))
        for start, ids in parts[doc]:
            assert any(w[start : start + len(ids)] == ids for w in whole)
        if len(whole) == 1:
            assert [t for _, x in sorted(parts[doc]) for t in x] == whole[0]
    assert sum(r["n_tokens"] < 32 for r in got) <= 1
    for r in got:
        assert sum(r["doc_lengths"]) == r["n_tokens"] <= 32
    assert (token_shards.read_slots(folder, n // 2, 7, 32, 16) == data[n // 2 : n // 2 + 7]).all()


def test_token_shards_do_not_depend_on_files(docs, tmp_path):
    some = []
    for k, df in enumerate((docs, docs.repartition(7).orderBy(F.rand(3)), docs.coalesce(1))):
        folder = f"file://{tmp_path}/{k}"
        (tmp_path / str(k)).mkdir()
        rows = token_shards.write_token_shards(df, folder, length=64, records=100, chunk=500 * (k + 1)).collect()
        some.append((Counter(str(r) for r in rows), token_shards.read_slots(folder, 0, 10**9, 64, 100).tobytes()))
    assert some[0] == some[1] == some[2] and some[0][1]


def test_long_texts_are_taken_in_pieces(monkeypatch):
    from sqlassay.llm import tokens, words

    text = " ".join(f"Word{k % 977} naïve,  {k}." for k in range(3000))
    enc = WordEncoder(tokenizer_path())
    want = enc.encode([text])[0].tolist(), words.word_hashes([text.encode()])[0].tolist()
    monkeypatch.setattr(tokens, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(words, "PIECE", 1000)
    flat, per = enc.encode([text])
    h, many = words.word_hashes([text.encode()])
    assert (flat.tolist(), h.tolist()) == want and per.tolist() == [len(flat)] and many.tolist() == [len(h)]


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        assert sorted(token_shards.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert (token_shards.feistel(np.arange(1000), 1000, 1) != token_shards.feistel(np.arange(1000), 1000, 2)).any()


def test_word_encoder():
    enc, plain = WordEncoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    plain.encode_special_tokens = True
    odd = ["", " a  b\tc ", "It's DON'T 1999-03-04 a_b!?", "naïve Straße ΑΣ İstanbul", "<|endoftext|> x", " nbsp　wide\x1cfs", "é ́x", "日本語 テキスト", "🙂🙂 ok", "a​b"]
    flat, per = enc.encode(odd)
    assert [x.tolist() for x in np.split(flat, np.cumsum(per)[:-1])] == [plain.encode(t, add_special_tokens=False).ids for t in odd]


def test_induced_sorting():
    rng = np.random.default_rng(5)
    for trial in range(150):
        k, n = rng.choice([1, 2, 4, 200]), rng.integers(1, 250)
        b = rng.integers(1, k + 1, n).astype(np.uint8).tobytes()
        b = b + b"\xff" + b[: rng.integers(0, len(b) + 1)]
        d = int(rng.choice([1, 2, 5, 20]))
        starts = Counter(b[i : i + d] for i in range(len(b) - d + 1))
        want = [i + d <= len(b) and starts[b[i : i + d]] > 1 for i in range(len(b))]
        text = np.frombuffer(b + b"\0" * 8, np.uint8)
        assert induced.repeated(text, len(b), d, int(rng.choice([3, 10**9]))).tolist() == want


@pytest.mark.parametrize("run", [mixing.mix_sources, mixing.mixed_documents, exact.exact_groups, exact.exact_dedup, suffix.remove_repeats, media.media_columns, brown.score, jaccard.near_duplicates, jaccard.keep_one, hilbert.hilbert_shards, lambda d: langid.identify(d, ["doc_id"]), packing.pack_documents, token_shards.write_token_shards], ids=str)
def test_empty_table(none, run):
    assert run(none).count() == 0
