"""The pipeline against plain Python, stage by stage, and the registered queries."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from sqlassay.llm import langid, mixing

from .conftest import texts
from .test_rows import assert_mix, near_classes, pieces_of


def kept_languages(at):
    """By hand from the model's tables: a letter, and a posterior of one half or more."""
    (langs, logp, prior), = langid.fit(at.filter(langid.fold(F.col("doc_id"), 4) != 2))
    keep = []
    for i, t in texts(at):
        grams, _, letter = langid.hashed_ngrams([t])
        total = prior + sum(logp[h].astype(float).sum(0) for h in grams)
        if letter[0] and 1 / np.exp(total - total.max()).sum() >= 0.5:
            keep.append((i, t))
    return Counter(keep)


def one_of_each(at):
    best = {}
    for i, t in texts(at):
        best[t] = max(i, best.get(t, i))
    return Counter((i, t) for t, i in best.items())


def one_of_near(at):
    rows = texts(at)
    sets, least = near_classes([t for _, t in rows]), {}
    for i, t in rows:
        if sets[t] is not None:
            least[sets[t]] = min(least.get(sets[t], (i, t)), (i, t))
    return Counter(least.values()) + Counter((i, t) for i, t in rows if sets[t] is None)


def test_stages(spark, docs, small):
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, small).cache()
        if name == "pack":
            assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == pieces_of(texts(at))
            break
        assert out.columns == docs.columns
        if name == "mix":
            assert_mix(at)
            assert Counter(map(tuple, out.collect())) == Counter(map(tuple, mixing.mixed_documents(at.repartition(3)).collect()))
        else:
            want = {"language": kept_languages, "exact_duplicates": one_of_each, "near_duplicates": one_of_near}[name](at)
            assert Counter(texts(out)) == want and Counter(map(tuple, out.collect())) <= Counter(map(tuple, at.collect()))
        at = out


def test_run(spark, docs, small):
    at = docs
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, small)
    piece = lambda r: (r["doc_id"], r["piece"], r["ids_crc32"])
    got = corpus_pipeline.run(spark, small).collect()
    assert got and Counter(map(piece, got)) == Counter(map(piece, at.collect()))


def test_registered():
    names = __spark_entry__.queries().keys()
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
