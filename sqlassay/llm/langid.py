"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become code points, n-grams of 1 to 3 of them hash into a fixed number of buckets, and
a text's score for a language is a sum of log probabilities looked up, for a whole batch of
texts at once, in a matrix of buckets by languages that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import staged, unit_hash, whole
from .tokens import blocks, release

BITS = 16
ORDERS = (1, 2, 3)
#: Training reads about so many documents of each language at most, picked by a hash of doc_id.
TRAIN_DOCS = 3000
#: Languages whose matrix is broadcast at once (134 MB); more are scored block by block.
BLOCK_LANGS = 512
UNKNOWN = "und"
BLOCK = 500_000


def hashed_ngrams(texts: list[str], bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the bucket of the n-gram at each position (1 << bits where there is none), the first position of each text, and whether it has a letter."""
    joined = "\0".join(t.lower() for t in texts) + "\0\0\0"
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    lens = np.array([len(t.lower()) for t in texts], np.int64)
    first = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    ascii_letter = (code >= 97) & (code <= 122)
    code = np.where((code < 128) & ~ascii_letter, np.uint32(32), code)
    code[(first + lens)] = 0
    code[-2:] = 0
    letter = np.array([any(map(str.isalpha, t)) for t in texts], bool)
    none, out = np.uint32(1 << bits), []
    inside = code != 0
    h = np.zeros(len(code), np.uint32)
    for n in ORDERS:
        if n == 1:
            h, valid = code * np.uint32(0x9E3779B1) + np.uint32(1), inside.copy()
        else:
            h = h[:-1] * np.uint32(0x85EBCA6B) + code[n - 1 :] * np.uint32(0xC2B2AE35) + np.uint32(n)
            valid = valid[:-1] & inside[n - 1 :]
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out.append(np.where(valid, mixed >> np.uint32(32 - bits), none))
    return out, first, letter


def fit(train: DataFrame, bits: int = BITS, train_docs: int = TRAIN_DOCS, block: int = BLOCK_LANGS) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """The model, from columns doc_id, text, lang, for ``block`` languages at a time: languages, log probabilities (buckets + 1, languages), log priors."""
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs, total = sorted(sizes), sum(sizes.values())
    if not langs:
        return
    rates = train.sparkSession.createDataFrame([(k, min(1.0, train_docs / sizes[k])) for k in langs], "lang string, rate double")
    sample = train.join(F.broadcast(rates) if len(langs) <= block else rates, "lang").filter(unit_hash(5, F.col("doc_id"), F.col("text")) < F.col("rate"))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for f in frames:
            for lang, rows in f.groupby("lang"):
                texts = rows["text"].tolist()
                into = sums.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                for a, b in blocks(texts, BLOCK):
                    for h in hashed_ngrams(texts[a:b], bits)[0]:
                        into += np.bincount(h, minlength=len(into))
            if len(sums) > 64:  # a table of counts for each language met: not for all of very many
                yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["lang", "counts"])
                sums = {}
        yield pd.DataFrame([(k, v.tobytes()) for k, v in sums.items()], columns=["lang", "counts"])

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": f["lang"][:1], "counts": [sum(np.frombuffer(x, np.int64) for x in f["counts"]).tobytes()]})

    ship(train.sparkSession)
    shape = "lang string, counts binary"
    parts = sample.select("lang", "text").repartition(max(8, len(langs))).mapInPandas(count, shape).groupBy("lang").applyInPandas(add, shape)
    if len(langs) > block:
        parts = staged(parts, "language-counts")
    for k in range(0, len(langs), block):
        some = langs[k : k + block]
        counts = np.ones(((1 << bits) + 1, len(some)))
        for r in parts.filter(F.col("lang").between(some[0], some[-1])).collect():
            counts[:, some.index(r["lang"])] += np.frombuffer(r["counts"], np.int64)
        counts[-1] = 0
        logp = np.log(np.maximum(counts, 1e-300) / counts.sum(0))
        logp[-1] = 0
        yield some, logp.astype(np.float32), np.log(np.array([sizes[x] for x in some], float) / total)


def predict(docs: DataFrame, model: Iterable[tuple[list[str], np.ndarray, np.ndarray]], row: Column) -> DataFrame:
    """Columns row (as given), lang (the most probable language) and score (its posterior probability) for each of docs.

    Null texts, and texts without a letter, get 'und' and 0; without a model all do. Only the
    text is looked at. Each block of languages is scored on its own; the best of the blocks'
    best and the sum of their sums are exactly those of all languages.
    """
    ship(docs.sparkSession)

    def scorer(shared):
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            release()
            langs, table, prior = shared.value
            bits = (table.shape[1] - 1).bit_length() - 1
            called = np.array(langs, object)
            for batch in batches:
                texts = [t or "" for t in batch]
                best, most, mass, some = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts), bool)
                for a, b in blocks(texts, BLOCK):
                    grams, first, letter = hashed_ngrams(texts[a:b], bits)
                    total = np.tile(prior, (b - a, 1))
                    for h in grams:
                        # no text starts past the end of the n-grams: three zeros follow the last
                        total += np.stack([np.add.reduceat(row[h].astype(np.float64), first) for row in table], 1)
                    best[a:b], most[a:b], some[a:b] = total.argmax(1), total.max(1), letter
                    mass[a:b] = np.exp(total - most[a:b, None]).sum(1)
                yield pd.DataFrame({"lang": np.where(some, called[best], None), "most": most, "mass": mass})

        return F.pandas_udf(score, "lang string, most double, mass double", F.PandasUDFType.SCALAR_ITER)

    # only the text goes to Python; structs are taken apart after the rows are back
    found = []
    for langs, logp, prior in model:
        found.append(scorer(docs.sparkSession.sparkContext.broadcast((langs, np.ascontiguousarray(logp.T), prior)))(F.col("text")))
    if not found:
        return docs.select(row.alias("row"), F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    each = docs.select(row.alias("row"), F.array(*found).alias("found"))
    top = F.array_max(F.transform("found", lambda f: F.struct(f["most"].alias("most"), f["lang"].alias("lang"), f["mass"].alias("mass"))))
    each = each.select("row", "found", top.alias("top"))
    mass = F.aggregate("found", F.lit(0.0), lambda s, f: s + f["mass"] * F.exp(f["most"] - F.col("top.most")))
    known = F.col("top.lang").isNotNull()
    return each.select("row", F.coalesce("top.lang", F.lit(UNKNOWN)).alias("lang"), F.when(known, 1 / mass).otherwise(0.0).alias("score"))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(parts))


def identify(docs: DataFrame, keep: list[str], held_out: int = 2, parts: int = 4, **options) -> DataFrame:
    """Columns ``keep`` of docs, held_out, lang_pred and score: learned from the labelled documents outside fold ``held_out``, told for all.

    Repeated rows are predicted alike, an empty table gives no rows, and without any labelled
    document everything is 'und'. Nulls as in predict(); other columns are ignored.
    """
    out = fold(F.col("doc_id"), parts) == held_out
    model = fit(docs.filter(~out), **options)
    found = predict(docs, model, F.struct(*keep, out.alias("held_out")))
    return found.select("row.*", F.col("lang").alias("lang_pred"), "score")


def with_letter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a letter."""

    @F.pandas_udf("boolean")
    def has(texts: pd.Series) -> pd.Series:
        return pd.Series([any(map(str.isalpha, t or "")) for t in texts], dtype=bool)

    return docs.filter(has(F.col("text")))


def known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is told with a probability of ``least`` or more, with their columns, whatever their names.

    Null texts, empty ones and those without a letter go; repeated rows stay or go alike; an
    empty table gives no rows. Where no document outside the held-out fold has a label,
    nothing is learned, and every document with a letter is kept.
    """
    model = fit(docs.filter(fold(F.col("doc_id"), 4) != 2))
    first = next(model, None)
    if first is None:
        return with_letter(docs)
    return predict(docs, chain([first], model), whole(docs)).filter((F.col("lang") != UNKNOWN) & (F.col("score") >= least)).select("row.*")
