"""Fill-in-the-middle, SentencePiece ids and spelling variants, against plain Python on whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from sqlassay.llm import fim, marked_words, queries, spelling

from .conftest import texts

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


@pytest.fixture(scope="module", params=["docs", "odd"])
def table(request):
    return request.getfixturevalue(request.param)


def digest(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def fim_row(doc_id, text):
    units, h = UNIT.findall(text), digest(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    head, middle, tail = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(head), len(middle), f"<S>{tail}<P>{head}<M>{middle}"
    return doc_id, len(units), "psm", len(head), len(middle), f"<P>{head}<S>{tail}<M>{middle}"


def assert_fim(table):
    found = fim.fill_in_middle(table).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((*fim_row(i, t), t) for i, t in texts(table))
    assert Counter(map(tuple, found)) == want
    return found


def test_fill_in_middle(table):
    assert_fim(table)


def test_fill_in_middle_of_hard_texts(spark, monkeypatch):
    rng = random.Random(5)
    alphabet = ["a", "é", "🦙", " ", "\t", " ", "\n", "<", "S>", "<P", "<M>", "<S", "word", "\x0b", "\x1c"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for k in range(3000)]
    rows += [(5000 + k, " x" * 70_000 + " ") for k in range(4)] + [(None, "no name here")] * 2
    found = assert_fim(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("events", [1, 2, 7])
def test_units_in_small_blocks_of_events(monkeypatch, events):
    monkeypatch.setattr(fim, "EVENTS", events)
    found, rng = fim.automaton(), random.Random(6)
    for _ in range(500):
        text = "".join(rng.choice("ab  \té<P>") for _ in range(rng.randrange(30)))
        units, want = fim.Units(text, found), UNIT.findall(text)
        assert [units.end(k) for k in range(units.n + 1)] == [len("".join(want[:k])) for k in range(len(want) + 1)]
        assert units.sentinel == ("<P>" in text)


def test_fill_in_middle_query_agrees_with_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    got = queries.op11_fill_in_middle(spark, small)
    want = con.execute(queries.ORACLES["op11_fill_in_middle"])
    assert [d[0] for d in want.description] == got.columns
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def pieces_of(table):
    m = sentencepiece.SentencePieceProcessor(model_file=marked_words.model_path())
    out = Counter()
    for doc_id, text in texts(table):
        ids = m.encode(text, add_bos=True, add_eos=True)
        out[doc_id, len(ids), np.array(ids, "<u4").tobytes(), m.decode(ids)] += 1
    return out


def encoded(table, **options):
    found = marked_words.encode_documents(table, **options).collect()
    return Counter((r["doc_id"], r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in found)


def test_sentencepiece_ids(table):
    assert encoded(table) == pieces_of(table)


@pytest.mark.parametrize("block", [1, 9, 300])
def test_sentencepiece_ids_in_small_blocks(spark, block):
    rng = random.Random(7)
    alphabet = ["a", "é", "🦙", " ", "  ", "\t", "▁", "\n", "　", "<s>", "the", "ﬁ", "\x00", "́", "<0x41>", "ing"]
    rows = [(k, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30)))) for k in range(300)]
    rows += [(900, " "), (901, "  "), (902, "▁"), (903, " ▁x"), (904, None), (905, ""), (906, " " * 40 + "x"), (None, "one two"), (None, "one two")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert encoded(table, block=block) == pieces_of(table)
    assert encoded(table, block=block, most_words=20) == pieces_of(table)


def test_models_whose_pieces_cross_words_are_refused(monkeypatch):
    class Crossing:
        def __init__(self, **_):
            pass

        def get_piece_size(self):
            return 2

        def id_to_piece(self, k):
            return ("▁a", "a▁b")[k]

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="crosses"):
        marked_words.model("another")


def one_edit(w):
    for k in range(len(w)):
        yield w[:k] + w[k + 1 :], k


def variants(words):
    """Near words of every word by deletion and replacement patterns, forms and roots by following them."""
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for x, k in one_edit(w):
            holes[x, k].append(w)
            if x in words:
                near[w].add(x)
                near[x].add(w)
    for same in holes.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    form = {}
    for w, n in words.items():
        if near[w]:
            top = min(near[w], key=lambda x: (-words[x], x))
            if words[top] >= 10 * n:
                form[w] = top
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None))
    return out


def words_of(table):
    counts = Counter()
    for doc_id, text in texts(table):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_spelling_variants(table):
    got = spelling.spelling_variants(table).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == variants(words_of(table))


@pytest.mark.parametrize("together", [2, 5, 64])
def test_near_words_of_crowded_dictionaries(spark, together):
    rng = random.Random(together)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(7, 10))): rng.choice([2, 3, 20, 200, 2000]) for _ in range(1500)}
    # many words share all but a place, runs of one letter, and very long words
    words |= {"prefixes" + c + "suffixes": 5 for c in "abcdefghijklmnopqrstuvwxyzàéîõü"} | {"a" * k: k for k in range(7, 30)}
    words |= {"x" * 3000 + "y" * k: 9 for k in range(40)} | {"z" + "x" * 3000: 90}
    found = spelling.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), together)
    got = {r["word"]: (r["n_near"], r["best_n"]) for r in found.collect()}
    want = variants(words)
    assert {w: c[0] for w, c in got.items()} == {w: near for w, _, _, _, near, _ in want if near}
    best = {r["word"]: r["best"] for r in found.collect()}
    for w, form, _, _, _, form_n in want:
        if form:
            assert (best[w], got[w][1]) == (form, form_n)


def test_roots_follow_long_chains(spark):
    forms = [(f"w{k}", f"w{k + 1}") for k in range(13)] + [("lone", "other")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(forms, "word string, form string")).collect()}
    assert got == {f"w{k}": "w13" for k in range(13)} | {"lone": "other"}


def test_empty_tables(none):
    assert fim.fill_in_middle(none).count() == 0
    assert marked_words.encode_documents(none).count() == 0
    assert spelling.spelling_variants(none).count() == 0


def test_near_duplicate_candidates_in_turns_and_families_apart(spark, monkeypatch):
    """Signatures shuffled in turns lose no link; sets that only share a phrase rare in the table are no family, near copies stay one."""
    from sqlassay.llm import jaccard

    def text(k):
        own = " ".join(f"w{k}x{i}" for i in range(40))
        return own if k >= 300 else f"{own} alpha beta gamma delta epsilon zeta eta theta iota kappa"

    near = [(1000 + c, text(500) + f" end{c}") for c in range(3)]
    docs = spark.createDataFrame([(k, text(k)) for k in range(400)] + near, "doc_id long, text string")
    sets = jaccard.set_ids(docs).filter("shingles IS NOT NULL").select("set_id", "n_shingles", "shingles")
    largest = lambda f: f.groupBy("component").count().agg({"count": "max"}).first()[0]
    common = jaccard.common_shingles
    monkeypatch.setattr(jaccard, "common_shingles", lambda s, n: common(s, n)[:0])  # as in a table where the phrase is rare
    whole = jaccard.candidate_families(sets)
    monkeypatch.setattr(jaccard, "PART_SIGNATURES", 500)
    monkeypatch.setattr(jaccard, "TURN_PARTS", 2)
    in_turns = jaccard.candidate_families(sets)
    assert {tuple(r) for r in in_turns.collect()} == {tuple(r) for r in whole.collect()} and largest(whole) > 100
    monkeypatch.setattr(jaccard, "common_shingles", common)
    apart = jaccard.families_apart(sets, whole, block=16)
    assert largest(apart) <= 16
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs, block=16).collect()}
    assert got == {**{k: k for k in range(400)}, **{k: 1000 for k, _ in near}}


def test_near_duplicates_that_meet_by_chance_are_no_family(spark, monkeypatch):
    """Few sets that share a phrase are told apart before they are moved; sketches keep every similar pair."""
    from sqlassay.llm import jaccard

    own = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    texts = {k: f"{own(k)} alpha beta gamma delta epsilon zeta eta theta iota kappa k{k // 10}" for k in range(30)} | {100: own(100), 101: own(100) + " end"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    names = {r["set_id"]: r["doc_id"] for r in jaccard.set_ids(docs).collect()}
    compared, own_links = [], jaccard.verified_links
    monkeypatch.setattr(jaccard, "verified_links", lambda sets, families, *a: (compared.extend(r["id"] for r in families.collect()), own_links(sets, families, *a))[1])
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(docs).collect()}
    assert got == {**{k: k for k in texts}, 101: 100} and {names[k] for k in compared} == {100, 101}
    rng, pairs = np.random.default_rng(3), []
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - rng.integers(0, len(a) // 8 + 1)], rng.integers(0, 2**63, rng.integers(0, len(a) // 8 + 2)).astype(np.uint64)]))
        pairs.append((a, b) if rng.random() < 0.5 else (b, a))
    frame = spark.createDataFrame([(k, len(a), jaccard.sketch(a), len(b), jaccard.sketch(b), jaccard.similar(a, b)) for k, (a, b) in enumerate(pairs) if len(b)], "k int, m long, x binary, n long, y binary, similar boolean")
    got = frame.withColumn("may", jaccard._may_link(80)("m", "x", "n", "y")).collect()
    assert sum(r["similar"] for r in got) > 50 and all(r["may"] for r in got if r["similar"])
