"""Which documents are mixed, what shards let a reader leave out, and posteriors, each worked out anew in plain Python."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from sqlassay.llm import hilbert, langid, mixing

LETTERS = regex.compile(r"\p{L}")


def unit(doc_id, size, seed=17):
    """The number between 0 and 1 that seed, id and size decide: a chain of 64-bit hashes."""
    h = 42
    for kind, v in (("<i", seed), ("<q", doc_id), ("<q", size)):
        h = xxhash.xxh64_intdigest(struct.pack(kind, v), seed=h)
    return ((h >> 11) + 0.5) / 2**53


def test_documents_are_mixed_in_the_order_of_their_keys(docs):
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    weight = {i: 0.1 + 0.9 * len(LETTERS.findall(t)) / len(t) if t else 0.1 for i, t in text.items()}
    sources = defaultdict(list)
    for r in mixing.mix_sources(docs).collect():
        if r["size"]:
            sources[r["source"]].append((-math.log(unit(r["doc_id"], r["size"])) / weight[r["doc_id"]], r["size"], r["extra"], r["budget"] if "budget" in r else r["target"] - r["epochs"] * r["source_size"], r["rows"]))
    partly = 0
    for rows in sources.values():
        rows.sort()
        taken = [x[2] > 0 for x in rows]
        # a run from the start, and nothing behind it; the run ends as near the budget as it can
        assert taken == sorted(taken, reverse=True)
        partly += 0 < sum(taken) < len(taken)
        if 0 < sum(taken) < len(taken):
            inside, budget, k = sum(x[1] for x in rows[: sum(taken)]), rows[0][3], sum(taken)
            assert abs(inside - budget) <= abs(inside + rows[k][1] - budget) + 1e-6 and abs(inside - budget) <= abs(inside - rows[k - 1][1] - budget) + 1e-6
    assert partly


def test_better_documents_are_mixed_more_often(spark):
    rows = [(k, "abcdefghij " * 10 if k % 2 else "12345 6789 a " * 10, s) for k in range(3000) for s in ("a",)] + [(9000 + k, "x " * 2000, "b") for k in range(20)]
    mix = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1.0, 6.0)).filter("source = 'a'").collect()
    taken = Counter(r["doc_id"] % 2 for r in mix if r["extra"])
    share = sum(taken.values()) / 3000
    assert 0.05 < share < 0.95 and taken[1] > 1.5 * taken[0]


def files_that_may_hold(path, column, value):
    """Shards whose Parquet statistics do not rule a value out, and all shards."""
    may, every = set(), set()
    for f in sorted(path.rglob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        at = [meta.schema.column(k).name for k in range(meta.num_columns)].index(column)
        for g in range(meta.num_row_groups):
            stats = meta.row_group(g).column(at).statistics
            every.add(f.parent.name)
            if stats is None or not stats.has_min_max or stats.min <= value <= stats.max:
                may.add(f.parent.name)
    return len(may), len(every)


@pytest.mark.parametrize("column", ["lang", "source", "n_chars"])
def test_shards_rule_files_out_in_every_dimension(spark, tmp_path, column):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(f"{column} IS NOT NULL")
    hilbert.write_shards(docs, str(tmp_path / "curve"), shards=64)
    docs.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("shard").parquet(str(tmp_path / "random"))
    values = [r[0] for r in docs.select(column).distinct().orderBy(column).collect()]
    read = {k: [files_that_may_hold(tmp_path / k, column, v) for v in values] for k in ("curve", "random")}
    share = {k: sum(a for a, _ in x) / sum(b for _, b in x) for k, x in read.items()}
    assert share["curve"] < 0.8 * share["random"], share
    # and nothing is lost by it
    wanted = values[len(values) // 2]
    found = spark.read.parquet(str(tmp_path / "curve")).filter(F.col(column) == wanted).count()
    assert found == docs.filter(F.col(column) == wanted).count()


def buckets(text, bits):
    """Buckets of all character n-grams of a text: lower case, ASCII that is no letter as a blank."""
    code = [ord(c) if ord(c) >= 128 or c.isalpha() else 32 for c in text.lower()]
    code = [0 if c == "\0" else k for c, k in zip(text.lower(), code)]
    out, mask = [], 2**32 - 1
    for n in langid.ORDERS:
        for k in range(len(code) - n + 1):
            some = code[k : k + n]
            h = 0
            for size in range(1, max(langid.ORDERS) + 1):
                if size > n:
                    break
                h = (some[0] * 0x9E3779B1 + 1) & mask if size == 1 else (h * 0x85EBCA6B + some[size - 1] * 0xC2B2AE35 + size) & mask
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & mask) >> (32 - bits))
    return out


def test_posterior_of_a_model_counted_in_plain_python(docs):
    rows = docs.filter("length(text) < 1500").orderBy("doc_id").limit(60)
    got = {r["doc_id"]: r for r in langid.identify(rows, ["doc_id"]).collect()}
    every = rows.collect()
    counts, sizes = defaultdict(Counter), Counter()
    for r in every:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None:
            counts[r["lang"]].update(buckets(r["text"], langid.BITS))
            sizes[r["lang"]] += 1
    totals = {lang: sum(c.values()) + 2**langid.BITS for lang, c in counts.items()}
    for r in every:
        grams = buckets(r["text"], langid.BITS)
        logs = {lang: math.log(sizes[lang] / sum(sizes.values())) + sum(math.log((c[b] + 1) / totals[lang]) for b in grams) for lang, c in counts.items()}
        best = max(logs, key=logs.get)
        if not any(map(str.isalpha, r["text"])):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        # log probabilities are kept in single precision
        assert got[r["doc_id"]]["lang_pred"] == best
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=2e-2)
