"""Words that any polynomial hash modulo a power of two confuses, and words that share a hash by force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from sqlassay.llm import brown, jaccard, packing, token_shards, tokens, words

SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    """The Thue-Morse word of n letters (a power of two), and the one with its letters exchanged."""
    w = "a"
    while len(w) < n:
        w += w.translate(SWAP)
    return w, w.translate(SWAP)


LENGTHS = (1024, 2048, 4096)


@pytest.fixture(scope="module")
def pairs(spark):
    rows = []
    for k, n in enumerate(LENGTHS):
        x, y = thue_morse(n)
        rows += [(10 * k + 1, x), (10 * k + 2, y), (10 * k + 3, f"{x} a b c"), (10 * k + 4, f"{y} a b c")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("n", LENGTHS)
def test_hashes_of_thue_morse_words(n):
    h, per = words.word_hashes([w.encode() for w in thue_morse(n)])
    assert per.tolist() == [1, 1] and h[0] != h[1]


def test_hashes_tell_lanes_and_lengths_apart():
    some = ["abcdefgh" + "ijklmnop", "ijklmnop" + "abcdefgh", "abcdefgh", "abcdefgh\x00", "\x00", "\x00\x00", "abcdefgh" * 2, "a" * 8, "a" * 9, "a" * 16, "a" * 17]
    h, _ = words.word_hashes([w.encode() for w in some])
    assert len(set(h.tolist())) == len(some)
    again, _ = words.word_hashes([" ".join(some).upper().encode()])
    assert again.tolist() == h.tolist()


@pytest.mark.parametrize("batches", [1, 2])
def test_ids_of_thue_morse_words(batches):
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [w for n in LENGTHS for w in thue_morse(n)]
    want = [i for t in texts for i in enc.tokenizer.encode(t, add_special_tokens=False).ids]
    parts = [texts] if batches == 1 else [texts[::2], texts[1::2]]
    got = [enc.encode(p) for p in parts]
    if batches == 1:
        assert got[0][0].tolist() == want
    else:
        for p, (flat, counts) in zip(parts, got):
            assert flat.tolist() == [i for t in p for i in enc.tokenizer.encode(t, add_special_tokens=False).ids] and len(counts) == len(p)


@pytest.mark.parametrize("different", [1, 3, 1000])
def test_ids_are_right_whatever_the_hash(monkeypatch, docs, different):
    monkeypatch.setattr(tokens, "hash_lanes", lambda lanes, start, many, size: words.hash_lanes(lanes, start, many, size) % np.uint64(different))
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [r["text"] or "" for r in docs.limit(40).collect()]
    for k in range(0, 40, 4):
        flat, counts = enc.encode(texts[k : k + 4])
        each = [e.ids for e in enc.tokenizer.encode_batch(texts[k : k + 4], add_special_tokens=False)]
        assert flat.tolist() == [i for x in each for i in x] and counts.tolist() == [len(x) for x in each]


def test_packing_of_thue_morse_words(pairs):
    t = Tokenizer.from_file(tokens.tokenizer_path())
    want = Counter()
    for r in pairs.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[r["doc_id"], k // 4096, zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packing.pack_documents(pairs).collect()) == want


def test_near_duplicates_of_thue_morse_words(pairs):
    found = jaccard.near_duplicates(pairs).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_shingles"] == 1 for r in found) and len(found) == 12


def test_scores_of_thue_morse_words(spark):
    x, y = thue_morse(2048)
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2][0]
    learnt = [k for k in range(100) if zlib.crc32(str(k).encode()) % 7 != 2][:3]
    table = spark.createDataFrame([(k, x) for k in learnt] + [(held, y)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in brown.score(table).collect()}
    assert got[held]["n_known"] == 1 and all(got[k]["n_known"] == 2 for k in learnt)


def test_cached_words_are_narrow():
    # what the encoder remembers of a word, beside its ids and bytes, stays under 24 bytes and survives merging of runs
    from sqlassay.llm import tokens

    enc = tokens.WordEncoder(tokens.tokenizer_path())
    texts = [" ".join(f"w{chr(97 + k)}{chr(97 + n // 26)}{chr(97 + n % 26)}x" for n in range(300)) for k in range(10)]
    for t in texts:
        enc.encode([t])
    assert all(sum(c.nbytes for c in run) <= 24 * len(run[0]) for run in enc.runs) and len(enc.runs) <= 6
    flat, counts = enc.encode(texts)
    want, many = enc._whole(texts)
    assert flat.tolist() == want.tolist() and counts.tolist() == many.tolist()


def test_encoding_gives_memory_back_between_batches(monkeypatch):
    # a task keeps of earlier batches what it remembers of words, within a bound, and no freed memory
    import pyarrow as pa

    freed, texts = [], [" ".join(f"w{chr(97 + n // 26)}{chr(97 + n % 26)}{'x' * k}" for n in range(300)) for k in range(1, 9)]
    monkeypatch.setattr(packing, "release", lambda words=True: freed.append(words))
    task = []

    class Docs:
        sparkSession, dtypes = None, [("doc_id", "bigint")]
        select = lambda self, *_: self
        mapInArrow = lambda self, f, _: task.append(f)

    monkeypatch.setattr(packing, "ship", lambda _: None)
    packing.cut(Docs())
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], ["doc_id", "text"]) for k, t in enumerate(texts)]
    rows = [r for b in task[0](iter(batches)) for r in b.to_pylist()]
    assert len(rows) == 8 and freed == [False] * 9
    # arrays that grow leave the pages that nothing was written to alone, and keep what they hold
    grown = tokens._with_room(np.arange(1, 9), 5, 9)
    assert len(grown) == 16 and grown.tolist() == [1, 2, 3, 4, 5] + [0] * 11 and grown.base is None
    assert tokens._with_room(grown, 5, 11) is grown and tokens.CACHE_WORDS * 45 < 100_000_000
