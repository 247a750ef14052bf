"""Queries over what the library writes: committed tables, collections, the vector index."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import consolidate, store, vector_index
from ..sources import corpora
from ..staging import folder
from ..streaming import strategies
from .registry import query, table
from .tables import PAIRS


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("strategy_id"), F.col("s_name").alias("name"), F.lit("P").alias("pattern"), F.round(F.col("s_acctbal") / 10000, 6).alias("success_rate"))


@query("""WITH s AS (SELECT s_suppkey AS k, round(s_acctbal / 10000, 6) AS r FROM supplier)
    SELECT 'strategy' AS kind, k::VARCHAR AS id, CASE WHEN k % 3 = 0 THEN 0.25::DOUBLE ELSE r END AS value, 1 + (k % 3 = 0)::INT AS version FROM s
    UNION ALL SELECT 'new', (k + 1000000)::VARCHAR, r, 1 FROM s WHERE k % 2 = 0 UNION ALL SELECT 'evolution', k::VARCHAR, round(0.25 - r, 6), 2 FROM s WHERE k % 3 = 0 AND r <> 0.25
    UNION ALL SELECT 'before', k::VARCHAR, r, 1 FROM s UNION ALL SELECT 'application', k::VARCHAR, 1.0, 0 FROM s WHERE k % 5 = 0""")
def b02_commits(spark, sf):
    # three commits: a first put, one that changes and adds (and again as the same batch, which changes nothing), applications; and the table as it was before
    rows = _suppliers(spark, sf)
    s = store.StrategyStore(spark, folder(spark, "store"))
    first = s.put(rows, "2024-05-01")
    more = rows.filter("strategy_id % 3 = 0").withColumn("success_rate", F.lit(0.25)).unionByName(rows.filter("strategy_id % 2 = 0").withColumn("strategy_id", (F.col("strategy_id").cast("long") + 1_000_000).cast("string")))
    for _ in range(2):
        s.put(more, "2024-05-02", ("events", 7))
    s.record(rows.filter("strategy_id % 5 = 0").select("strategy_id", F.lit("t").alias("trajectory_id"), F.lit(True).alias("success")), "2024-05-03")
    now = s.table("strategies").select(F.when(F.col("strategy_id").cast("long") >= 1_000_000, "new").otherwise("strategy").alias("kind"), F.col("strategy_id").alias("id"), F.col("success_rate").alias("value"), "version")
    changed = s.table("strategy_evolution").select(F.lit("evolution").alias("kind"), F.col("strategy_id").alias("id"), F.round("performance_delta", 6).alias("value"), "version")
    before = s.table("strategies", first).select(F.lit("before").alias("kind"), F.col("strategy_id").alias("id"), F.col("success_rate").alias("value"), "version")
    used = s.table("strategy_applications").select(F.lit("application").alias("kind"), F.col("strategy_id").alias("id"), F.lit(1.0).alias("value"), F.lit(0).alias("version"))
    return now.unionByName(changed).unionByName(before).unionByName(used)


@query("SELECT s_suppkey::VARCHAR AS strategy_id, s_name AS name, round(s_acctbal / 10000, 6) AS success_rate, 1 AS version, true AS is_active FROM supplier")
def s23_export_load(spark, sf):
    # out of one store and into another through its files
    where = folder(spark, "exported")
    one, other = (store.StrategyStore(spark, f"{where}/{n}") for n in ("one", "other"))
    one.put(_suppliers(spark, sf), "2024-05-01")
    one.export(f"{where}/lines")
    other.load(f"{where}/lines", "2024-05-02")
    return other.table("strategies").select("strategy_id", "name", "success_rate", "version", "is_active")


@query("""SELECT n_nationkey::VARCHAR AS id, CASE WHEN n_nationkey % 4 = 0 THEN upper(n_name) || '!' ELSE n_name END AS document FROM nation UNION ALL SELECT 'c' || c_custkey, c_name FROM customer WHERE c_custkey % 7 = 0""")
def s16_collection_upsert(spark, sf):
    n, where = table(spark, sf, "nation"), folder(spark, "collections")
    rows = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("document"))
    corpora.write_collection(rows, where, "names")
    corpora.write_collection(rows.filter("id % 4 = 0").withColumn("document", F.concat(F.upper("document"), F.lit("!"))), where, "names", reset=False)
    corpora.write_collection(table(spark, sf, "customer").filter("c_custkey % 7 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_name").alias("document")), where, "names", reset=False)
    return corpora.read_collection(spark, where, "names")


def _embedded(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs) SELECT q_id, id, rank::BIGINT AS rank, round(s, 6) AS similarity FROM r WHERE rank <= 10")
def v01_every_cell(spark, sf):
    # every cell probed: the exact answer, through the index; a vector is its own nearest and goes
    items, where = _embedded(spark, sf), folder(spark, "index")
    vector_index.build(items, where)
    asked = items.filter("id % 50 = 0").select(F.col("id").alias("q_id"), "vec")
    found = vector_index.search(asked, where, 11, probes=vector_index.MOST_CELLS).filter("q_id <> id")
    return vector_index.ranked(found, 10).select("q_id", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("SELECT 10 * count(*) AS pairs, true AS enough, true AS pruned FROM embeddings WHERE vec_id % 50 = 0")
def v01_index_recall(spark, sf):
    # queries by cell number of probes for a recall of 0.95: at least 0.9 of the exact neighbours come back, and one query alone reads fewer files than there are
    items, where = _embedded(spark, sf), folder(spark, "index")
    vector_index.build(items, where)
    asked = items.filter("id % 50 = 0").select(F.col("id").alias("q_id"), "vec")
    exact = vector_index.search(asked, where, 10, probes=vector_index.MOST_CELLS)
    found = vector_index.recall(vector_index.search(asked, where, 10), exact)
    files = len(vector_index.files_read(asked.filter("q_id = 0"), where))
    return found.select("pairs", (F.col("found") >= 0.9 * F.col("pairs")).alias("enough"), F.lit(files < vector_index.files(spark, where)).alias("pruned"))


# ---- consolidation -----------------------------------------------------------------------

#: Customers as strategies: those of a nation and segment share pattern and steps, and each has eight keywords, all but one of them those of the next.
CHAINS = """c AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m, 1 + c_custkey % 9 AS samples, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS i FROM customer)"""


def _chains(spark, sf):
    i = F.row_number().over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    c = table(spark, sf, "customer").withColumn("i", i)
    words = F.transform(F.sequence(F.col("i"), F.col("i") + 7), lambda x: F.concat_ws("-", "c_nationkey", "c_mktsegment", x))
    return c.select(
        F.col("c_custkey").alias("strategy_id"), F.concat_ws("_", F.lit("P"), "c_nationkey", "c_mktsegment").alias("pattern"), words.alias("keywords"), F.array(F.lit("s1"), F.col("c_mktsegment")).alias("steps"),
        (1 - F.col("i") / 1e6).alias("success_rate"), (1 + F.col("c_custkey") % 9).alias("sample_count"), F.lit(1).alias("version"))


@query(f"""WITH {CHAINS}, d AS (SELECT *, row_number() OVER (PARTITION BY n, m ORDER BY i) AS place, first_value(k) OVER (PARTITION BY n, m, (i - 1) // 2 ORDER BY i) AS p FROM c)
    SELECT p AS strategy_id, sum(samples)::BIGINT AS sample_count, round(sum((1 - i / 1e6) * samples) / sum(samples), 6) AS success_rate, count(*) AS version, 7 + count(*) AS keywords FROM d GROUP BY p""")
def j18_greedy_merge(spark, sf):
    # a strategy is like the next one of its chain and no other: the first takes in the second, the third the fourth, ...
    merged, _ = consolidate.merge_similar(_chains(spark, sf))
    return merged.select("strategy_id", "sample_count", F.round("success_rate", 6).alias("success_rate"), F.col("version").cast("long").alias("version"), F.size("keywords").cast("long").alias("keywords"))


@query("""WITH u AS (SELECT user_id % 20 AS k, event_id, event_type AS t, value > 60 AS good, value <= 30 AS bad, event_type || '-word seen' AS q FROM events),
    p AS (SELECT k, t, count(*) AS n, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, t) AS r FROM u WHERE bad GROUP BY 1, 2), w AS (SELECT k, t || '-word' AS w, count(*) AS n FROM u WHERE good GROUP BY 1, 2 UNION ALL SELECT k, 'seen', count(*) FROM u WHERE good GROUP BY 1),
    x AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, w) AS r FROM w)
    SELECT k AS strategy_id, round(0.7 * 0.5 + 0.3 * avg(good::INT), 6) AS success_rate, count(*) AS sample_count,
        coalesce((SELECT string_agg(t || ':' || round(n / b, 6)::DOUBLE, ',' ORDER BY r) FROM p, (SELECT k AS bk, count(*) AS b FROM u WHERE bad GROUP BY 1) WHERE p.k = u.k AND bk = u.k AND r <= 5), '') AS pitfalls,
        coalesce((SELECT string_agg(w, ',' ORDER BY r) FROM (SELECT w, r, row_number() OVER (ORDER BY r) AS s FROM x WHERE x.k = u.k AND r <= 10) WHERE s <= 5), '') AS keywords FROM u GROUP BY k""")
def j15_refined(spark, sf):
    e = table(spark, sf, "events").withColumn("strategy_id", F.col("user_id") % 20)
    outcome = F.when(F.col("value") > 60, "COMPLETE_SUCCESS").when(F.col("value") <= 30, "EXECUTION_FAILURE").otherwise("PARTIAL_SUCCESS")
    told = F.array(F.struct(F.col("event_type").alias("pattern"), F.lit("look at it").alias("lesson"), F.array(F.lit("fix")).alias("key_elements")))
    uses = e.select("strategy_id", F.col("event_id").alias("trajectory_id"), F.concat("event_type", F.lit("-word seen")).alias("question"), outcome.alias("outcome"), told.alias("insights"))
    known = uses.select("strategy_id").distinct().select("strategy_id", F.lit(0.5).alias("success_rate"), F.lit(0).cast("long").alias("sample_count"), F.lit(1).alias("version"), F.array().cast("array<string>").alias("keywords"), F.array().cast(consolidate.PITFALLS).alias("common_pitfalls"))
    got = consolidate.refine_strategies(known, uses)
    pits = F.array_join(F.transform("common_pitfalls", lambda p: F.concat_ws(":", p["mistake"], F.round(p["frequency"], 6).cast("string"))), ",")
    return got.select("strategy_id", F.round("success_rate", 6).alias("success_rate"), "sample_count", pits.alias("pitfalls"), F.array_join("keywords", ",").alias("keywords"))


@query("SELECT p_partkey AS q_id, repeat('+', least(p_size % 5, 2)::INT) AS said, least(p_size % 5 + 1, 3)::BIGINT AS attempts, least(p_size % 5, 2)::DOUBLE AS improvement FROM part")
def j25_feedback_loop(spark, sf):
    # what a part needs, up to four times '+', is told once a round: three rounds give two
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("q_id"), (F.col("p_size") % 5).alias("need"))
    right = F.length("sql") >= F.col("need")
    got = consolidate.refine_with_feedback(
        p, lambda df, k: df.withColumn("sql", F.concat(F.coalesce("previous_sql", F.lit("")), F.coalesce("feedback", F.lit("")))),
        lambda df: df.withColumns({"score": F.length("sql").cast("double"), "exact_match": right, "execution_match": right}), lambda sql, score: F.lit("+"))
    return got.select("q_id", F.col("sql").alias("said"), "attempts", "improvement")


@query("SELECT user_id::VARCHAR AS strategy_id, count(*) AS sample_count, round(avg((value > 30)::INT), 6) AS success_rate, 2 AS version FROM events GROUP BY 1")
def j09_stream_of_uses(spark, sf):
    # the events as a stream of uses, into a store, and then all again as batches that are in already
    where = folder(spark, "stream")
    e = table(spark, sf, "events")
    s = store.StrategyStore(spark, f"{where}/store")
    s.put(e.select(F.col("user_id").cast("string").alias("strategy_id")).distinct().withColumn("success_rate", F.lit(-1.0)), "2024-01-01")
    for checkpoint in ("one", "again"):
        uses = spark.readStream.schema(e.schema).parquet(f"{sf}/events.parquet*").select(F.col("user_id").alias("strategy_id"), (F.col("value") > 30).alias("success"), "ts")
        strategies.keep_up(uses, s, f"{where}/{checkpoint}", idle="3650 days").awaitTermination()
    return s.table("strategies").select("strategy_id", "sample_count", F.round("success_rate", 6).alias("success_rate"), "version")
