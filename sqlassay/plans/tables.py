"""Queries on scores, results, vectors and strategies, with the star schema and events in their place."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.arrays import cell, common
from ..operators import execute, grading, results, retrieval, strategies
from ..operators.singletable import safe_headers
from ..sources import corpora
from .registry import query, table


@query("SELECT p_size AS c, p_size % 7 AS p, p_size % 5 AS l, CASE WHEN p_size % 7 = p_size % 5 AND p_size = p_size % 7 THEN 1.0 ELSE 0.0 END AS score FROM part")
def m01_all_or_nothing(spark, sf):
    c, p, g = F.col("p_size"), F.col("p_size") % 7, F.col("p_size") % 5
    return table(spark, sf, "part").select(c.alias("c"), p.alias("p"), g.alias("l"), grading.all_or_nothing(c, p, g).alias("score"))


@query("""SELECT a.k, sum(least(a.n, b.n))::BIGINT AS overlap FROM (SELECT l_orderkey AS k, l_returnflag AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) a
    JOIN (SELECT l_orderkey AS k, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) b ON a.k = b.k AND a.v = b.v GROUP BY a.k""")
def m02_multiset_overlap(spark, sf):
    other = F.when(F.col("l_linestatus") == "O", "N").otherwise("R")
    bags = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_returnflag").alias("a"), F.collect_list(other).alias("b"))
    return bags.select("k", common(F.col("a"), F.col("b")).cast("long").alias("overlap")).filter("overlap > 0")


@query("""SELECT o_orderkey AS id, CASE WHEN c1 <= 1 AND o = 0 AND c2 = 0 THEN 'easy' WHEN (o <= 2 AND c1 <= 1 AND c2 = 0) OR (c1 <= 2 AND o < 2 AND c2 = 0) THEN 'medium'
    WHEN (o > 2 AND c1 <= 2 AND c2 = 0) OR (2 < c1 AND c1 <= 3 AND o <= 2 AND c2 = 0) OR (c1 <= 1 AND o = 0 AND c2 <= 1) THEN 'hard' ELSE 'extra' END AS level
    FROM (SELECT o_orderkey, o_orderkey % 5 AS c1, o_custkey % 3 AS c2, o_orderkey % 4 AS o FROM orders)""")
def m15_hardness(spark, sf):
    c1, c2, o = F.col("o_orderkey") % 5, F.col("o_custkey") % 3, F.col("o_orderkey") % 4
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), grading.hardness(c1, c2, o).alias("level"))


@query("SELECT level, count(*) AS count, round(avg(ok), 6) AS exact FROM (SELECT unnest([event_type, 'all']) AS level, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS ok FROM events) GROUP BY level")
def m18_score_rollup(spark, sf):
    rows = table(spark, sf, "events").select("event_type", (F.col("value") > 50).alias("ok"))
    return grading.score_table(rows, "event_type", exact="ok")


@query("SELECT l_orderkey AS k, l_linenumber AS n, 'n:' || CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS num, 's:' || l_returnflag AS txt FROM lineitem")
def x03_cells(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), cell(F.concat(F.lit(" "), F.col("l_quantity").cast("string"))).alias("num"), cell(F.concat("l_returnflag", F.lit(" "))).alias("txt"))


def _two_results(spark, sf):
    """Per customer the orders as label and, with columns swapped and every 40th price changed, as prediction."""
    o = table(spark, sf, "orders")
    changed = F.when(F.col("o_orderkey") % 40 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    gold = results.result_rows(o, "o_custkey", -1, "o_orderkey", ["o_orderkey", "o_totalprice"])
    pred = results.result_rows(o.withColumn("x", changed), "o_custkey", 1, "o_orderkey", ["x", "o_orderkey"])
    return gold.unionByName(pred)


@query("SELECT o_custkey AS query_id, max(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) = 0 AS equal FROM orders GROUP BY o_custkey")
def x08_results_equal(spark, sf):
    rows = _two_results(spark, sf)
    queries = rows.select("query_id").distinct().withColumn("ordered", F.col("query_id") % 2 == 0)
    return results.results_equal(queries, rows)


@query("SELECT o_custkey AS query_id, max(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) = 0 AS equal FROM orders GROUP BY o_custkey")
def x07_multisets_equal(spark, sf):
    rows = _two_results(spark, sf).withColumn("cells", F.array_sort("cells"))
    return results.multisets_equal(rows)


@query("SELECT l_orderkey AS query_id, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'mismatch' END AS kind FROM lineitem WHERE l_returnflag = 'R' OR l_quantity > 40")
def x11_failure_scan(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", "no such column").alias("pred_error"), (F.col("l_quantity") <= 40).alias("equal"))
    return results.failure_scan(rows).select("query_id", "line", "kind")


X12 = {
    "runs": "SELECT p_brand, count(*) AS n FROM x12_part GROUP BY p_brand", "is only planned": "SELECT raise_error(p_name) FROM x12_part", "fails when planned": "SELECT nothing FROM x12_part",
    "fails when run": "SELECT raise_error(p_name) FROM x12_part WHERE p_size >= 0", "changes tables": "DROP VIEW x12_part", "never ends": "SELECT count(*) FROM range(1000000000000000) WHERE id % 3 = 4",
}


@query("""SELECT 'runs' AS name, 'result' AS status, (SELECT count(DISTINCT p_brand) FROM part)::BIGINT AS n, (SELECT count(*) FROM part)::BIGINT AS total
    UNION ALL SELECT 'is only planned', 'result', NULL, NULL UNION ALL SELECT unnest(['fails when planned', 'fails when run', 'changes tables']), 'exception', NULL, NULL UNION ALL SELECT 'never ends', 'timeout', NULL, NULL""")
def x12_try_sql(spark, sf):
    # counts a statement's rows and adds up its last column, where it has run
    table(spark, sf, "part").createOrReplaceTempView("x12_part")
    found = []
    for name, sql in X12.items():
        run = name != "is only planned"
        status, rows = execute.try_sql(spark, sql, run, seconds=3)
        found.append((name, status, len(rows) if run and status == "result" else None, sum(r[-1] for r in rows) if run and status == "result" else None))
    return spark.createDataFrame(found, "name string, status string, n long, total long")


def _wide_results(spark, sf):
    """Per order its lines with twelve columns: all equal, or two of them others, in another order; every seventh order has a changed cell."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("row_id"), F.col("l_quantity").cast("string").alias("q"), F.col("l_extendedprice").cast("string").alias("p"), F.col("l_linenumber").cast("string").alias("n"))
    same = F.array_repeat("q", 12)
    gold = F.when(F.col("query_id") % 2 == 0, same).otherwise(F.concat(F.array_repeat("q", 5), F.array("p"), F.array_repeat("q", 5), F.array("n")))
    pred = F.when(F.col("query_id") % 2 == 0, same).otherwise(F.concat(F.array("n", "p"), F.array_repeat("q", 10)))
    pred = F.when(F.col("query_id") % 7 == 0, F.concat(F.array(F.lit("other")), F.slice(pred, 2, 11))).otherwise(pred)
    sides = [rows.select("query_id", F.lit(side).alias("side"), "row_id", cells.alias("cells")) for side, cells in ((-1, gold), (1, pred))]
    return sides[0].unionByName(sides[1])


@query("SELECT DISTINCT l_orderkey AS query_id, l_orderkey % 7 <> 0 AS equal FROM lineitem")
def x06_column_orders(spark, sf):
    rows = _wide_results(spark, sf)
    return results.results_equal(rows.select("query_id").distinct().withColumn("ordered", F.col("query_id") % 3 == 0), rows)


# ---- vectors -----------------------------------------------------------------------------


def _pairs(spark, sf, k=None, where=None):
    """Vectors whose id is divisible by 50 as queries, against all, or all that meet ``where``; unit vectors, made once a row; with k, the pairs that can be among a query's k nearest."""
    e = retrieval.with_unit_vectors(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"))
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), F.col("label").alias("q_label"))
    items = retrieval.matching(e, where or {}).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    if k:
        return retrieval.nearest(queries, items, k)
    return retrieval.scored(queries, items, F.col("q_id") != F.col("id"))


PAIRS = """pairs AS (SELECT q.vec_id AS q_id, i.vec_id AS id, q.label AS q_label, i.label AS label, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 9) AS s
    FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id)"""


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs) SELECT q_id, id, rank::BIGINT AS rank, round(s, 6) AS similarity FROM r WHERE rank <= 10")
def v01_cosine_topk(spark, sf):
    pairs = _pairs(spark, sf, 10).withColumn("similarity", F.round("similarity", 9))
    return retrieval.top(pairs, 10, F.desc("similarity"), F.col("id")).select("q_id", "id", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("""SELECT vec_id, k AS place, round(CASE WHEN n > 0 THEN embedding[k + 1]::DOUBLE / n ELSE 0.0 END, 6) AS x
    FROM (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n, unnest(range(len(embedding))) AS k FROM embeddings)""")
def v02_normalise(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(retrieval.normalised(F.col("embedding"))).alias("place", "x"))
    return e.select("vec_id", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS near FROM pairs),
    s AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY (q_label = label) DESC, near) AS rank FROM r WHERE near <= 15) SELECT q_id, id, rank::BIGINT AS rank FROM s WHERE rank <= 5""")
def v03_same_first(spark, sf):
    pairs = _pairs(spark, sf, 15).withColumn("similarity", F.round("similarity", 9))
    return retrieval.knn_same_first(pairs, 5, F.col("q_label") == F.col("label")).select("q_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS near FROM pairs WHERE label >= 1),
    s AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM r WHERE near <= 9 AND s >= 0.05) SELECT q_id, id, rank::BIGINT AS rank FROM s WHERE rank <= 3""")
def v04_filtered_topk(spark, sf):
    pairs = _pairs(spark, sf, 9, {"label": {"$gte": 1}}).withColumn("similarity", F.round("similarity", 9))
    return retrieval.similar_questions(pairs, 3, 0.05, F.lit(False)).select("q_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs) SELECT q_id, id, rank::BIGINT AS rank FROM r WHERE rank <= 5 AND s >= 0.1")
def v05_rank_then_threshold(spark, sf):
    pairs = _pairs(spark, sf, 5).withColumn("similarity", F.round("similarity", 9))
    return retrieval.similar_statements(pairs, 5, 0.1).select("q_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def v09_collection_counts(spark, sf):
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT vec_id FROM embeddings WHERE label >= 2 AND vec_id < 300")
def v10_filter_algebra(spark, sf):
    e = table(spark, sf, "embeddings")
    return retrieval.matching(e, {"$and": [{"label": {"$gte": 2}}, {"vec_id": {"$lt": 300}}]}).select("vec_id")


@query(f"""WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS near FROM pairs),
    s AS (SELECT *, round(0.6 * s + 0.4 * (id % 10) / 10, 6) AS score FROM r WHERE near <= 10), t AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, id) AS rank FROM s) SELECT q_id, id, rank::BIGINT AS rank, score FROM t WHERE rank <= 5""")
def v11_hybrid_rerank(spark, sf):
    pairs = _pairs(spark, sf, 10).withColumn("similarity", F.round("similarity", 9))
    found = retrieval.hybrid_search(pairs, 5, (F.col("id") % 10) / 10).withColumn("score", F.round("score", 6))
    return found.select("q_id", "id", F.col("rank").cast("long").alias("rank"), "score")


# ---- strategies --------------------------------------------------------------------------


def _applications(spark, sf):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 20).alias("strategy_id"), (F.col("value") > 30).alias("success"), F.col("value").alias("seconds"), "event_type", "ts", "event_id")


@query("SELECT user_id % 20 AS strategy_id, count(*) AS uses, sum(CASE WHEN value > 30 THEN 1 ELSE 0 END)::BIGINT AS successes, sum(CASE WHEN value > 30 THEN 0 ELSE 1 END)::BIGINT AS failures, round(avg(CASE WHEN value > 30 THEN 1.0 ELSE 0 END), 6) AS success_rate, round(avg(value), 6) AS avg_seconds FROM events GROUP BY 1")
def b07_performance(spark, sf):
    return strategies.performance(_applications(spark, sf))


@query("SELECT pattern, count(*) AS strategies, round(avg(r), 6) AS avg_rate, sum(n)::BIGINT AS samples FROM (SELECT unnest([event_type, 'all']) AS pattern, value / 100 AS r, user_id AS n FROM events) GROUP BY pattern")
def b08_statistics(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("pattern"), (F.col("value") / 100).alias("success_rate"), F.col("user_id").alias("sample_count"))
    return strategies.statistics(rows)


def _store(spark, sf):
    s = table(spark, sf, "supplier")
    words = F.array(F.lit("k"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")))
    return s.select(F.col("s_suppkey").alias("strategy_id"), F.col("s_name").alias("name"), F.concat(F.lit("P_"), (F.col("s_nationkey") % 5).cast("string")).alias("pattern"), words.alias("keywords"), F.array(F.lit("a"), F.lit("b")).alias("steps"), F.round(F.col("s_acctbal") / 10000 + 0.25, 6).alias("success_rate"), (F.col("s_suppkey") % 60).alias("sample_count"), F.lit(True).alias("is_active"), F.lit(1).alias("version"))


@query("""SELECT s_suppkey AS strategy_id, round(CASE WHEN s_suppkey % 3 = 0 THEN 0.5 ELSE round(s_acctbal / 10000 + 0.25, 6) END, 6) AS success_rate, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM supplier""")
def b02_upsert(spark, sf):
    store = _store(spark, sf)
    new = store.filter("strategy_id % 3 = 0").withColumn("success_rate", F.lit(0.5).cast("double"))
    merged, _ = strategies.upsert(store, new, "2024-02-01")
    return merged.select("strategy_id", F.round("success_rate", 6).alias("success_rate"), F.col("version").cast("long").alias("version"))


@query("SELECT s_suppkey AS strategy_id, 2::BIGINT AS version, round(s_acctbal / 10000 + 0.25, 6) AS old_rate, 0.5::DOUBLE AS new_rate FROM supplier WHERE s_suppkey % 3 = 0 AND round(s_acctbal / 10000 + 0.25, 6) <> 0.5")
def b06_history(spark, sf):
    store = _store(spark, sf)
    _, history = strategies.upsert(store, store.filter("strategy_id % 3 = 0").withColumn("success_rate", F.lit(0.5).cast("double")), "2024-02-01")
    return history.select("strategy_id", F.col("version").cast("long").alias("version"), "old_rate", "new_rate")


@query("SELECT s_suppkey AS strategy_id FROM supplier WHERE s_nationkey % 5 = 2 AND round(s_acctbal / 10000 + 0.25, 6) >= 0.3")
def b03_b04_listed(spark, sf):
    return strategies.listed(_store(spark, sf), "P_2", 0.3).select("strategy_id")


@query("SELECT s_suppkey AS strategy_id FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08)")
def b09_hard_delete(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.1 AND l_tax >= 0.08").select(F.col("l_suppkey").alias("strategy_id"))
    return strategies.hard_delete(_store(spark, sf), gone).select("strategy_id")


@query("SELECT event_id, CASE WHEN d <= 7 THEN 1.0 WHEN d <= 30 THEN 0.8 ELSE 0.6 END AS recency FROM (SELECT event_id, date_diff('day', ts::DATE, DATE '2024-02-01') AS d FROM events)")
def k05_recency(spark, sf):
    return table(spark, sf, "events").select("event_id", strategies.recency(F.col("ts").cast("date"), F.lit("2024-02-01").cast("date")).alias("recency"))


@query("""SELECT event_id, round(CASE WHEN (s > 0.8)::INT + (i > 0.7)::INT + (r > 0.8)::INT >= 2 THEN least(1.0, b * f * 1.1) ELSE b * f END, 6) AS confidence, round(0.35 * s + 0.25 * i + 0.25 * r + 0.15 * 0.8, 6) AS relevance FROM (
    SELECT event_id, s, i, r, (s + i + r) / 3 AS b, CASE WHEN n < 5 THEN 0.7 WHEN n < 20 THEN 0.85 WHEN n < 50 THEN 0.95 ELSE 1.0 END AS f FROM (
    SELECT event_id, (event_id % 101) / 100 AS s, (user_id % 11) / 10 AS i, (event_id % 7) / 6 AS r, user_id % 60 AS n FROM events))""")
def k06_k07_scores(spark, sf):
    s, i, r, n = (F.col("event_id") % 101) / 100, (F.col("user_id") % 11) / 10, (F.col("event_id") % 7) / 6, F.col("user_id") % 60
    return table(spark, sf, "events").select("event_id", F.round(strategies.confidence(s, i, r, n), 6).alias("confidence"), F.round(strategies.relevance(s, i, r, F.lit(0.8)), 6).alias("relevance"))


@query("""SELECT q_id, strategy_id, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY relevance DESC, strategy_id) AS rank FROM (
    SELECT user_id AS q_id, event_id AS strategy_id, value AS relevance FROM events WHERE (event_id % 10) / 10 >= 0.5)) WHERE rank <= 3""")
def k08_ranked(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("strategy_id"), F.col("value").alias("relevance"), ((F.col("event_id") % 10) / 10).alias("confidence"))
    return strategies.ranked(rows).select("q_id", "strategy_id", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS again FROM events)
    SELECT user_id AS q_id, event_id AS strategy_id, k::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY again > 1, place) AS k FROM r) WHERE k <= 3""")
def k09_diverse(spark, sf):
    # every user: those of few types fill up with repeated ones
    e = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("strategy_id"), F.col("event_type").alias("pattern"), F.array(F.col("event_id").cast("string")).alias("keywords"))
    rows = e.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("strategy_id")))
    return strategies.diverse(rows, 3).select("q_id", "strategy_id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_partkey AS id, ['aggregation,ranking', 'grouping', 'basic_select', 'aggregation,filtering'][(p_partkey % 4 + 1)::INT] AS patterns FROM part""")
def k01_patterns(spark, sf):
    qs = ("highest total", "each one", "show it", "average greater")
    q = F.element_at(F.array(*map(F.lit, qs)), (F.col("p_partkey") % 4 + 1).cast("int"))
    found = F.filter(strategies.question_patterns(q), lambda p: p != "ordering")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(F.array_sort(found), ",").alias("patterns"))


JUDGED = """SELECT event_id, user_id, event_type, CASE WHEN event_id % 9 = 0 THEN 'PARSE_FAILURE' WHEN value > 60 THEN 'COMPLETE_SUCCESS' WHEN value > 30 THEN 'PARTIAL_SUCCESS' ELSE 'EXECUTION_FAILURE' END AS outcome FROM events"""


def _judged(spark, sf):
    errors = F.when(F.col("event_id") % 9 == 0, F.array(F.lit("Syntax error"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", strategies.success_type(errors, F.lit("select"), F.col("value") > 60, F.col("value") > 30).alias("outcome"))


@query(JUDGED)
def j01_success_type(spark, sf):
    return _judged(spark, sf)


@query("SELECT p_partkey AS id, ['MULTI_TABLE_JOIN', 'AGGREGATION_GROUPING', 'NESTED_SUBQUERY', 'BASIC_SELECT'][(p_partkey % 4 + 1)::INT] AS kind, ['JOIN', 'AGGREGATION_GROUPING', 'FILTERING_SUBQUERY', 'ORDERING_RANKING'][(p_partkey % 4 + 1)::INT] AS pattern FROM part")
def j07_j10_query_type(spark, sf):
    sqls = ("select a from t join u", "select a, count(*) from t group by a", "select a from t where b in (select c from u)", "select a from t order by a limit 3")
    sql = F.element_at(F.array(*map(F.lit, sqls)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), strategies.query_type(sql).alias("kind"), strategies.sql_pattern(sql).alias("pattern"))


@query("SELECT p_partkey AS id, ['SYNTAX_ERROR', 'EXECUTION_ERROR', 'SCHEMA_ERROR', 'UNKNOWN_ERROR'][(p_partkey % 4 + 1)::INT] AS category FROM part")
def j06_error_category(spark, sf):
    errors = ("SYNTAX near parse", "runtime fault", "no such column", "what")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), strategies.error_category(F.element_at(F.array(*map(F.lit, errors)), (F.col("p_partkey") % 4 + 1).cast("int"))).alias("category"))


@query("SELECT outcome, count(*) AS count, round(avg((event_id % 10) / 10), 6) AS avg_confidence FROM (" + JUDGED + ") GROUP BY outcome")
def j08_judgments(spark, sf):
    rows = _judged(spark, sf).withColumn("confidence", (F.col("event_id") % 10) / 10).withColumn("insights", F.array("event_type"))
    return strategies.judgment_statistics(rows)[0]


@query(f"SELECT pattern, round(s / (s + f), 6) AS success_rate, s AS sample_count FROM (SELECT event_type || user_id % 30 AS pattern, sum((outcome = 'COMPLETE_SUCCESS')::INT)::BIGINT AS s, sum((outcome LIKE '%FAILURE')::INT)::BIGINT AS f FROM ({JUDGED}) GROUP BY 1) WHERE s >= 3")
def j11_distil(spark, sf):
    rows = _judged(spark, sf).withColumn("pattern", F.concat("event_type", (F.col("user_id") % 30).cast("string")))
    return strategies.distil(rows).select("pattern", "success_rate", "sample_count")


@query("""WITH a AS (SELECT user_id % 20 AS s, (value > 30)::INT AS ok, event_type FROM events), u AS (SELECT s, count(*) AS n, avg(ok) AS r FROM a GROUP BY s),
    g AS (SELECT s, max(r) - min(r) AS spread, count(*) AS c FROM (SELECT s, event_type, avg(ok) AS r, count(*) AS n FROM a GROUP BY 1, 2) WHERE n >= 3 GROUP BY s),
    x AS (SELECT s_suppkey AS strategy_id, s_suppkey % 60 AS m, coalesce(n, 0) AS uses, r, coalesce(spread, 0) AS spread, coalesce(c, 0) AS c FROM supplier LEFT JOIN u ON u.s = s_suppkey LEFT JOIN g ON g.s = s_suppkey)
    SELECT strategy_id, uses, round(r, 6) AS rate, CASE WHEN uses < 10 THEN 'KEEP' WHEN r < 0.2 AND m >= 5 THEN 'DELETE' WHEN r < 0.4 THEN 'DEPRECATE' WHEN uses >= 20 AND c > 1 AND spread > 0.15 THEN 'SPLIT' WHEN r < 0.6 THEN 'REFINE' ELSE 'KEEP' END AS action FROM x""")
def j14_decisions(spark, sf):
    return strategies.decisions(_applications(spark, sf), _store(spark, sf), "event_type")


@query("WITH u AS (SELECT user_id % 20 AS s, count(*) AS n, avg((value > 30)::INT) AS r FROM events GROUP BY 1) SELECT s_suppkey AS strategy_id, round(CASE WHEN r IS NULL THEN round(s_acctbal / 10000 + 0.25, 6) ELSE 0.7 * round(s_acctbal / 10000 + 0.25, 6) + 0.3 * r END, 6) AS success_rate, s_suppkey % 60 + coalesce(n, 0) AS sample_count FROM supplier LEFT JOIN u ON s = s_suppkey")
def j15_refine(spark, sf):
    per = strategies.performance(_applications(spark, sf)).select("strategy_id", "uses")
    exact = _applications(spark, sf).groupBy("strategy_id").agg(F.avg(F.col("success").cast("double")).alias("rate")).join(per, "strategy_id")
    return strategies.refine(_store(spark, sf), exact).select("strategy_id", F.round("success_rate", 6).alias("success_rate"), "sample_count")


@query("SELECT user_id % 20 AS strategy_id, round(max(r) - min(r), 6) AS spread, count(*) AS contexts FROM (SELECT user_id % 20 AS user_id, event_type, avg((value > 30)::INT) AS r, count(*) AS n FROM events GROUP BY 1, 2) WHERE n >= 3 GROUP BY 1")
def j16_split_spread(spark, sf):
    return strategies.split_spread(_applications(spark, sf), "event_type").select("strategy_id", F.round("spread", 6).alias("spread"), "contexts")


@query("""SELECT a.s_suppkey AS a, b.s_suppkey AS b, 1.0::DOUBLE AS similarity FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def j18_merge_pairs(spark, sf):
    return strategies.merge_pairs(_store(spark, sf))


@query("""WITH c AS (SELECT user_id AS q, event_type AS h, count(*) AS n, min(event_id) AS f FROM events WHERE value > 20 GROUP BY 1, 2), t AS (SELECT user_id AS q, count(*) AS n FROM events GROUP BY 1),
    b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, f) AS k FROM c) SELECT t.q AS q_id, b.f AS winner, round(coalesce(b.n, 0) / t.n, 6) AS agreement FROM t LEFT JOIN b ON t.q = b.q AND b.k = 1""")
def j21_vote(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("candidate"), F.when(F.col("value") > 20, F.col("event_type")).alias("result_hash"))
    return strategies.vote(rows).select("q_id", "winner", "agreement")


@query("SELECT user_id AS q_id, arg_max(event_id, value) AS candidate, max(value) AS score FROM events GROUP BY user_id")
def j23_best_candidate(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("candidate"), F.col("value").alias("score"))
    return strategies.best_candidates(rows)


# ---- sources -----------------------------------------------------------------------------


@query("SELECT split, count(*) AS size, count(DISTINCT db_id) AS databases FROM (SELECT lang AS split, source AS db_id FROM documents) GROUP BY split")
def s05_split_statistics(spark, sf):
    return corpora.split_statistics(table(spark, sf, "documents").select(F.col("lang").alias("split"), F.col("source").alias("db_id")))


@query("SELECT l_orderkey AS id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def s21_unfinished(spark, sf):
    todo = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("example_id"))
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("example_id"))
    return corpora.unfinished(todo, done).groupBy(F.col("example_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT p_brand AS db_id, idx, safe FROM (SELECT p_brand, p_partkey AS idx, b || CASE WHEN r > 1 THEN '_' || (r - 1) ELSE '' END AS safe FROM (
    SELECT p_brand, p_partkey, b, row_number() OVER (PARTITION BY p_brand, lower(b) ORDER BY p_partkey) AS r FROM (SELECT p_brand, p_partkey, replace(p_name, ' ', '_') AS b FROM part)))""")
def s14_safe_headers(spark, sf):
    p = table(spark, sf, "part")
    lists = p.groupBy(F.col("p_brand").alias("db_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("x"))
    rows = safe_headers(lists.select("db_id", "x", F.transform("x", lambda h: h["p_name"]).alias("headers")), "db_id", "headers")
    ids = lists.select("db_id", F.posexplode("x").alias("at", "h")).select("db_id", "at", F.col("h.p_partkey").alias("id"))
    return rows.withColumnRenamed("idx", "at").join(ids, ["db_id", "at"]).select("db_id", F.col("id").alias("idx"), "safe")


@query("""SELECT line, session, 'sql ' || line AS sql, 'db' || line % 3 AS db_id FROM (SELECT event_id AS line, sum((event_id % 10 = 9)::INT) OVER (ORDER BY event_id)::BIGINT AS session FROM events) WHERE line % 10 <> 9""")
def s20_sessions(spark, sf):
    e = F.col("event_id")
    text = F.when(e % 10 == 9, "").otherwise(F.concat(F.lit("sql "), e.cast("string"), F.lit("\tdb"), (e % 3).cast("string")))
    return corpora.sessions(table(spark, sf, "events").select(e.alias("line"), text.alias("value")))


@query("SELECT p_brand AS db_id, string_agg(DISTINCT lower(replace(p_type, ' ', '_')), ',' ORDER BY lower(replace(p_type, ' ', '_'))) AS tables FROM part GROUP BY 1")
def s26_inferred_schema(spark, sf):
    q = F.concat(F.lit("SELECT a FROM "), F.replace("p_type", F.lit(" "), F.lit("_")))
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("db_id"), q.alias("query"))
    return corpora.inferred_schema(rows).select("db_id", F.array_join("tables", ",").alias("tables"))


@query("SELECT p_partkey AS id, ['number,text', 'text,text'][(p_partkey % 2 + 1)::INT] AS kinds FROM part")
def s09_column_kinds(spark, sf):
    first = F.when(F.col("p_partkey") % 2 == 0, "12.5").otherwise("x")
    rows = F.array(F.array(first, F.lit("y")), F.array(F.lit("1"), F.lit("2")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(corpora.column_kinds(rows, F.array(F.lit("a"), F.lit("b"))), ",").alias("kinds"))


@query("SELECT p_partkey AS db_id, r AS row_id, c AS col, CASE WHEN c = 0 THEN p_brand ELSE r::VARCHAR END AS value FROM part, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(r, c)")
def s13_cells(spark, sf):
    rows = F.array(F.array("p_brand", F.lit("0")), F.array("p_brand", F.lit("1")))
    return corpora.cells(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), rows.alias("rows")))


@query("""SELECT CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split, count(*) AS n
    FROM (SELECT ('0x' || substr(md5('7/' || doc_id), 1, 8))::BIGINT / 4294967296 AS u FROM documents) GROUP BY 1""")
def s12_hash_split(spark, sf):
    rows = corpora.hash_split(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", {"train": 0.8, "dev": 0.1, "test": 0.1})
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def s12_few_shot(spark, sf):
    return corpora.few_shot(table(spark, sf, "documents").select("source", "doc_id"), "source", 3, "doc_id")
