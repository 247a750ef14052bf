"""Queries that show single operators: components, rules, texts and tables that larger queries build on."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import parser, prompts, semantic, sqltext
from ..functions.arrays import common
from ..operators import grading, results, retrieval, singletable, strategies
from ..sources import corpora
from .registry import query, spread, table
from .tables import _applications, _pairs, _store, _two_results, PAIRS
from .textual import _headers, _pairs as _statements, _structural, graded, CATALOG


def pick(values, key="p_partkey"):
    """One of the values for each row, by the key."""
    cols = [v if not isinstance(v, str) else F.lit(v) for v in values]
    return F.element_at(F.array(*cols), (F.col(key) % len(values) + 1).cast("int"))


def case(values, key="p_partkey"):
    return f"[{', '.join(map(str, values))}][({key} % {len(values)} + 1)::INT]"


def parts(spark, sf):
    return table(spark, sf, "part").withColumn("id", F.col("p_partkey"))


# ---- parsing and components --------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {case([1, 3, 3, 7])}::BIGINT AS c1, {case([0, 0, 1, 0])}::BIGINT AS c2, {case([0, 1, 1, 3])}::BIGINT AS others FROM part")
def m12_m13_m14_counts(spark, sf):
    rows = parser.parse_statements(_statements(spark, sf).withColumn("catalog", F.lit(CATALOG)), "gold_sql", "catalog", "g")
    return rows.select("id", F.col("g.n_clauses").cast("long").alias("c1"), F.col("g.n_nested").cast("long").alias("c2"), F.col("g.n_others").cast("long").alias("others"))


@query("""SELECT p_partkey AS id, c AS component, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 5 = 0 AND c LIKE 'select%' THEN 0.0 WHEN (p_partkey % 5 = 0 OR p_partkey % 7 = 0) AND p_partkey % 4 >= 2 AND c = 'where' THEN 0.0 ELSE 1.0 END AS score
    FROM part, (SELECT unnest(['select', 'select(no AGG)', 'where', 'where(no OP)', 'group(no Having)', 'group', 'order', 'and/or', 'IUEN', 'keywords']) AS c) WHERE p_partkey % 11 <> 0 AND (p_partkey % 7 <> 0 OR p_partkey % 4 >= 2)
    """)
def m10_partial_scores(spark, sf):
    # the grader's own verdict says which rows have scores: what follows a whole statement is not read
    return graded(spark, sf).select("id", F.explode("partial").alias("s")).select("id", "s.component", "s.score")


@query("SELECT p_partkey AS id, true AS same_values, p_partkey % 2 = 0 AS same_literals FROM part")
def p08_rebuilt(spark, sf):
    # without literals, and with foreign-key columns under one name, two statements agree
    a, b = F.lit("select distinct t1.p_name from part as t1 where t1.p_partkey = 3"), pick(["select distinct t1.p_name from part as t1 where t1.p_partkey = 3", "select t1.p_name from part as t1 where t1.p_size = 4"])
    rows = parts(spark, sf).select("id", a.alias("a"), b.alias("b"), F.lit(CATALOG).alias("c"))
    rows = parser.parse_statements(parser.parse_statements(rows, "a", "c", "x"), "b", "c", "y")
    keys = F.lit('{"__part.p_size__": "__part.p_partkey__"}')
    same = parser.rebuilt(F.col("x.tree"), keys) == parser.rebuilt(F.col("y.tree"), keys)
    return rows.select("id", same.alias("same_values"), (F.col("x.tree") == F.col("y.tree")).alias("same_literals"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'SELECT COUNT(a) FROM t' ELSE 'SELECT a FROM t' END AS sql FROM part")
def n10_count_injection(spark, sf):
    return parts(spark, sf).select("id", sqltext.inject_count(F.lit("SELECT a FROM t"), pick(["How many are there?", "Which one?"])).alias("sql"))


@query("SELECT unnest(['strat_agg_001', 'strat_filter_001', 'strat_join_001', 'strat_order_001', 'strat_subq_001']) AS strategy_id, 0.0::DOUBLE AS success_rate, 0::BIGINT AS sample_count")
def b11_seeds(spark, sf):
    return strategies.seeds(spark).select("strategy_id", "success_rate", "sample_count")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'GROUPING,JOIN' ELSE 'FILTERING' END AS features, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::BIGINT AS rules FROM supplier")
def j12_rules(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("strategy_id"), F.when(F.col("s_suppkey") % 2 == 0, "GROUPING_JOIN").otherwise("FILTERING").alias("pattern"))
    got = strategies.with_rules(rows)
    return got.select(F.col("strategy_id").alias("id"), F.array_join("features", ",").alias("features"), F.size("rules").cast("long").alias("rules"))


@query("SELECT p_partkey AS id, p_partkey % 11 = 0 OR p_partkey % 7 = 0 OR p_partkey % 5 = 0 AS failed FROM part")
def o07_older_grader(spark, sf):
    # a prediction that does not parse is graded as an empty statement, not left ungraded
    rows = graded(spark, sf)
    older = grading.grade_turns(rows.drop("partial", "exact_match", "hardness", "counted"), unparsed="empty")
    return older.select("id", (~F.col("exact_match")).alias("failed"))


@query("SELECT p_partkey AS id, p_partkey % 3 = 0 AS same, p_partkey % 3 = 0 AS iuen FROM part")
def m09_set_operations(spark, sf):
    left = "select p_name from part union select s_name from supplier"
    right = pick([left, "select p_name from part union select p_name from part", "select p_name from part intersect select s_name from supplier"])
    rows = parts(spark, sf).select("id", F.lit(left).alias("g"), right.alias("p"), F.lit(CATALOG).alias("c"))
    rows = parser.parse_statements(parser.parse_statements(rows, "g", "c", "gold"), "p", "c", "pred")
    scores = grading.partial_scores(F.col("pred"), F.col("gold"))
    iuen = F.filter(scores, lambda s: s["component"] == "IUEN")[0]["score"] == 1.0
    return rows.select("id", grading.exact_match(scores, F.col("pred"), F.col("gold")).alias("same"), iuen.alias("iuen"))


@query(f"SELECT p_partkey AS id, {case([2, 1, 0, 3])}::BIGINT AS overlap FROM part")
def m03_m04_bag_overlap(spark, sf):
    a = F.array(F.lit("x"), F.lit("x"), F.lit("y"))
    b = pick([F.array(F.lit("x"), F.lit("x")), F.array(F.lit("y"), F.lit("z")), F.array(F.lit("z")), a])
    return parts(spark, sf).select("id", common(a, b).cast("long").alias("overlap"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'part' ELSE 'supplier' END AS stands_for FROM part")
def p02_aliases(spark, sf):
    toks = parser.lexed(F.when(F.col("id") % 2 == 0, "SELECT x.a FROM part AS x").otherwise("SELECT x.a FROM supplier x"))
    from ..shipping import ship

    ship(spark)
    rows = parts(spark, sf).select("id", toks.alias("t"))
    at = F.array_position("t", "from").cast("int")
    return rows.select("id", F.element_at("t", at + 1).alias("stands_for"))


# ---- results -----------------------------------------------------------------------------


@query("SELECT o_custkey AS query_id, max(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) = 0 AS agree, count(*) AS n FROM orders GROUP BY 1")
def x04_x05_quick_check(spark, sf):
    return results.shapes(_two_results(spark, sf)).select("query_id", F.col("bags_agree").alias("agree"), F.col("gold_rows").alias("n"))


@query("SELECT o_custkey AS query_id, max(CASE WHEN o_orderkey % 40 = 0 THEN 1 ELSE 0 END) = 0 AS execution_match FROM orders GROUP BY 1")
def x09_execution_verdict(spark, sf):
    rows = _two_results(spark, sf)
    gold = F.when(F.col("query_id") % 2 == 0, "select a from t order by a").otherwise("select a from t")
    queries = rows.select("query_id").distinct().withColumn("ordered", F.lower(gold).contains("order by"))
    return results.results_equal(queries, rows).withColumnRenamed("equal", "execution_match")


# ---- single-table ------------------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {case([0, 1, 2, 3, 1, 2])}::BIGINT AS op FROM part")
def e04_operators(spark, sf):
    return parts(spark, sf).select("id", singletable.operator_index(pick(["=", ">=", "<", "LIKE", ">", "<="])).cast("long").alias("op"))


def _conds(*items):
    return F.array(*[F.struct(F.lit(c).alias("col"), F.lit(o).alias("op"), singletable.value(F.lit(v)).alias("val")) for c, o, v in items])


@query(f"SELECT p_partkey AS id, {case(['true', 'true', 'true', 'false', 'false'])} AS relaxed, {case(['true', 'true', 'false', 'false', 'false'])} AS strict FROM part")
def e10_conditions(spark, sf):
    # a row's own conditions are read, once for both ways of matching
    raw = lambda *items: F.array(*[F.struct(F.lit(c).alias("col"), F.lit(o).alias("op"), F.lit(v).alias("val")) for c, o, v in items])
    pred = pick([raw((1, 1, "5"), (0, 0, "blue")), raw((7, 0, "blue"), (1, 1, "5"), (2, 2, "9")), raw((0, 3, "blue"), (1, 2, "5")), raw((0, 0, "blue")), raw((0, 0, "red"), (1, 1, "5"))])
    read = lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), singletable.value(c["val"]).alias("val"))
    rows = spread(spark, parts(spark, sf)).select("id", F.transform(pred, read).alias("pred"), F.transform(raw((0, 0, "blue"), (1, 1, "5")), read).alias("gold"))
    pred, gold = F.col("pred"), F.col("gold")
    return rows.select("id", singletable.conditions_match(pred, gold).alias("relaxed"), singletable.conditions_match(pred, gold, singletable.values_match_strict, False).alias("strict"))


@query(f"SELECT p_partkey AS id, {case(['true', 'false', 'true', 'false'])} AS agg_ok FROM part")
def e12_missing_aggregate(spark, sf):
    x = lambda agg, n: F.struct(F.lit(agg).alias("agg"), F.lit(0).alias("sel"), _conds(*[(0, 0, "a")] * n).alias("conds") if n else F.filter(_conds((0, 0, "a")), lambda c: F.lit(False)).alias("conds"))
    gold, pred = pick([x(1, 1), x(1, 0), x(4, 1), x(3, 1)]), pick([x(0, 1), x(0, 0), x(4, 1), x(0, 1)])
    return parts(spark, sf).select("id", singletable.structural(pred, gold)["agg_ok"].alias("agg_ok"))


@query("SELECT arg_max(category, n) AS category, max(n) AS count FROM (SELECT category, count(*) AS n FROM (SELECT ['ok', 'ok', 'agg', 'sel+cond', 'parse', 'agg', 'agg'][(p_partkey % 7 + 1)::INT] AS category FROM part) WHERE category <> 'ok' GROUP BY 1)")
def e18_dominant_failure(spark, sf):
    rows = parts(spark, sf).select(pick(["ok", "ok", "agg", "sel+cond", "parse", "agg", "agg"]).alias("category"))
    return singletable.dominant_failure(rows.groupBy("category").agg(F.count(F.lit(1)).alias("count")))


# ---- retrieval ---------------------------------------------------------------------------


@query("""WITH words AS (SELECT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+')) AS w FROM documents),
    slots AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 6))::INT % 16 AS slot, count(*)::DOUBLE AS n FROM words WHERE w <> '' GROUP BY 1, 2),
    norms AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM slots GROUP BY 1)
    SELECT d.doc_id, k.slot, round(coalesce(s.n / m.norm, 0.0), 6) AS x FROM documents d CROSS JOIN range(16) k(slot) LEFT JOIN slots s ON s.doc_id = d.doc_id AND s.slot = k.slot LEFT JOIN norms m ON m.doc_id = d.doc_id""")
def s19_hashed_embedding(spark, sf):
    # every document, wordless ones too: these are zero vectors
    e = table(spark, sf, "documents").select("doc_id", F.posexplode(retrieval.hashed_embedding(F.col("text"), 16)).alias("slot", "x"))
    return e.select("doc_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


# ---- strategies --------------------------------------------------------------------------


@query("""SELECT q_id, strategy_id, source, place FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY source, strategy_id)::BIGINT AS place FROM (
    SELECT user_id AS q_id, event_id AS strategy_id, min(CASE WHEN event_type = 'click' THEN 0 ELSE 1 END)::BIGINT AS source FROM events WHERE event_type IN ('click', 'view') OR value > 90 GROUP BY 1, 2)) WHERE place <= 5""")
def k02_candidates(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("strategy_id"), "event_type", "value")
    first, second = e.filter("event_type = 'click'"), e.filter("event_type IN ('click', 'view') OR value > 90")
    got = strategies.union_candidates([first.select("q_id", "strategy_id"), second.select("q_id", "strategy_id")], 5)
    return got.select("q_id", "strategy_id", F.col("source").cast("long").alias("source"), F.col("place").cast("long").alias("place"))


@query("SELECT p_partkey AS id, p_name || ' | ' || p_brand AS text FROM part")
def k03_search_text(spark, sf):
    return parts(spark, sf).select("id", strategies.search_text(F.col("p_name"), F.lit(""), F.lit(None).cast("string"), F.col("p_brand")).alias("text"))


@query(f"SELECT p_partkey AS id, round({case(['1.0', '0.5', '0.0'])}, 6) AS score FROM part")
def k04_intent(spark, sf):
    q = pick(["count rows", "count things", "show it"])
    none = F.array().cast("array<string>")
    score = strategies.intent_score(q, F.array(F.lit("count"), F.lit("rows")), F.lit("basic"), F.lit("read"), none, none)
    return parts(spark, sf).select("id", F.round(score, 6).alias("score"))


@query("SELECT event_id, CASE WHEN s > 0.8 THEN 'very similar question' WHEN s > 0.6 THEN 'similar question' ELSE 'general match' END AS why FROM (SELECT event_id, (event_id % 10) / 10 AS s FROM events)")
def k10_explanation(spark, sf):
    zero = F.lit(0.0)
    return table(spark, sf, "events").select("event_id", strategies.explanation((F.col("event_id") % 10) / 10, zero, zero, F.lit(1)).alias("why"))


@query("SELECT b.s_suppkey AS strategy_id FROM supplier a JOIN supplier b ON a.s_suppkey = 1 AND b.s_suppkey <> 1 AND a.s_nationkey <> b.s_nationkey")
def k11_complementary(spark, sf):
    return strategies.complementary(_store(spark, sf), "1").select("strategy_id")


@query("SELECT s_suppkey AS strategy_id, 'Strategy: ' || s_name || chr(10) || 'Pattern: P_' || s_nationkey % 5 || chr(10) || 'Keywords: k, n' || s_nationkey || chr(10) || 'Steps: a -> b' AS text FROM supplier")
def b10_k12_text(spark, sf):
    s = _store(spark, sf)
    return s.select("strategy_id", strategies.as_text(F.struct(*s.columns)).alias("text"))


@query("SELECT s_suppkey AS strategy_id, s_suppkey % 4 <> 0 AS is_active FROM supplier")
def b09_soft_delete(spark, sf):
    s = _store(spark, sf)
    return s.withColumn("is_active", F.col("is_active") & (F.col("strategy_id") % 4 != 0)).select("strategy_id", "is_active")


@query("SELECT user_id % 20 AS strategy_id, event_type AS context, count(*) AS sample_count, round(avg((value > 30)::INT), 6) AS success_rate FROM events WHERE user_id % 20 IN (SELECT s_suppkey FROM supplier) GROUP BY 1, 2 HAVING count(*) >= 5")
def j17_split(spark, sf):
    got = strategies.split(_store(spark, sf), _applications(spark, sf), "event_type")
    parts_ = F.split("strategy_id", "_")
    return got.select(parts_[0].cast("long").alias("strategy_id"), parts_[1].alias("context"), "sample_count", F.round("success_rate", 6).alias("success_rate"))


@query("SELECT event_id, round(least((event_id % 10) / 10 * ((user_id % 5) / 4), 0.85), 6) AS discounted, round(0.5 + 0.4 * ((event_id % 10) / 10 + 1) / 2, 6) AS partial FROM events")
def j02_j03_confidence(spark, sf):
    c, a = (F.col("event_id") % 10) / 10, (F.col("user_id") % 5) / 4
    return table(spark, sf, "events").select("event_id", F.round(strategies.pseudo_confidence(c, a), 6).alias("discounted"), F.round(strategies.partial_confidence(F.array(c, F.lit(1.0))), 6).alias("partial"))


@query(f"SELECT p_partkey AS id, {case([1, 2, 0, 1])}::BIGINT AS n, {case(['true', 'false', 'false', 'true'])} AS has_join, {case([1, 2, 1, 1])}::BIGINT AS n_select FROM part")
def j04_j05_insights(spark, sf):
    sql = pick(["select a from t join u", "select a from t where b in (select c from u group by c)", "select a from t", "select a from t join u"])
    outcome = pick(["COMPLETE_SUCCESS", "COMPLETE_SUCCESS", "COMPLETE_SUCCESS", "EXECUTION_FAILURE"])
    f = strategies.key_factors(sql, F.lit("a b"))
    return parts(spark, sf).select("id", F.size(strategies.insights(sql, outcome, F.array().cast("array<string>"))).cast("long").alias("n"), f["has_join"].alias("has_join"), f["n_select"].cast("long").alias("n_select"))


@query("SELECT event_id, (event_id % 10) / 10 >= 0.7 OR ((event_id % 10) / 10 >= 0.5 AND user_id % 40 >= 20) OR event_id % 30 < 7 AS viable, round(CASE WHEN user_id % 3 + event_id % 2 > 0 THEN (0.2 * (user_id % 3) + 0.8 * (event_id % 2)) / (user_id % 3 + event_id % 2) ELSE 0.5 END, 6) AS merged FROM events")
def j19_viable_merged(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select("event_id", strategies.viable((e % 10) / 10, u % 40, e % 30).alias("viable"), F.round(strategies.merged_rate(F.lit(0.2), u % 3, F.lit(0.8), e % 2), 6).alias("merged"))


@query("SELECT p_partkey AS id, '0.0,0.25,0.5,0.75,1.0' AS temperatures, (p_size // 2)::BIGINT AS focused, (p_size // 3)::BIGINT AS combined, (p_size - p_size // 2 - p_size // 3)::BIGINT AS exploratory, round(0.85 * (1 - 0.3 * p_size / 100), 6) AS confidence FROM part")
def j22_j24_scaling(spark, sf):
    mix = strategies.task_mix(F.col("p_size"))
    temps = F.array_join(F.transform(strategies.temperatures(5), lambda x: x.cast("string")), ",")
    return parts(spark, sf).select("id", temps.alias("temperatures"), *[mix[k].cast("long").alias(k) for k in ("focused", "combined", "exploratory")], F.round(strategies.candidate_confidence(F.lit(True), F.col("p_size") / 100), 6).alias("confidence"))


@query("SELECT doc_id, regexp_matches(lower(text), 'except|intersect|not in|not exists|having|nested|subquery|more than|at least|maximum|minimum among|rank') AS hard FROM documents")
def j27_hard_questions(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strategies.is_hard(F.col("text")).alias("hard"))


@query("SELECT user_id AS q_id, round(max(value), 6) AS score FROM events GROUP BY 1")
def j25_j26_refinement(spark, sf):
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("q_id")).agg(F.max("value").alias("v"))
    got = strategies.refine_loop(e, lambda df, k: df.withColumn("sql", F.lit(f"select {k}")), lambda df: df.withColumn("score", F.col("v")), rounds=2, good=1e9)
    return got.select("q_id", F.round("score", 6).alias("score"))


# ---- questions and prompts ---------------------------------------------------------------


@query(f"SELECT p_partkey AS id, {case([2, 3, 0])}::BIGINT AS complexity, {case(["'simple'", "'medium'", "'simple'"])} AS label, {case(["'medium'", "'medium'", "'easy'"])} AS level FROM part")
def l04_l09_complexity(spark, sf):
    a = semantic.analyse(pick(["how many", "average yearly", "show"]))
    return parts(spark, sf).select("id", a["complexity"].cast("long").alias("complexity"), a["complexity_text"].alias("label"), a["label"].alias("level"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'orders' ELSE 'city_names' END AS tables FROM part")
def l02_schema_entities(spark, sf):
    tables = F.array(F.lit("orders"), F.lit("city_names"))
    return parts(spark, sf).select("id", F.array_join(semantic.schema_entities(pick(["Which order is it?", "Name the city"]), tables), ",").alias("tables"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'SELECT COUNT(*) FROM t' ELSE 'SELECT * FROM t' END AS sql, CASE WHEN p_partkey % 2 = 0 THEN 'aggregate' ELSE 'select and filter' END AS approach, CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS patterns FROM part")
def l05_l06_l07_enhance(spark, sf):
    a = semantic.analyse(pick(["how many", "show"]))
    return parts(spark, sf).select("id", semantic.enhance(F.lit("SELECT * FROM t"), a).alias("sql"), semantic.approach(a).alias("approach"), F.size(semantic.suggested_patterns(a)).cast("long").alias("patterns"))


@query("SELECT p_partkey AS id, c AS \"column\" FROM part, (VALUES ('unit_price', 0), ('ship_city', 1)) v(c, k) WHERE p_partkey % 2 = k")
def l08_relevant_columns(spark, sf):
    cols = F.explode(F.array(F.lit("unit_price"), F.lit("ship_city"))).alias("column")
    rows = parts(spark, sf).select("id", pick(["what price is it", "which city"]).alias("q"), cols)
    return semantic.relevant_columns(rows, F.col("q")).select("id", "column")


@query("SELECT count(*) AS n, round(avg(c), 6) AS avg_complexity, min(c)::BIGINT AS min_complexity, max(c)::BIGINT AS max_complexity, 0::BIGINT AS entities FROM (SELECT [2, 3, 0][(p_partkey % 3 + 1)::INT] AS c FROM part)")
def l10_batch_statistics(spark, sf):
    rows = parts(spark, sf).select(semantic.analyse(pick(["how many", "average yearly", "show"])).alias("analysis"))
    s = semantic.batch_statistics(rows)
    return s.select("n", "avg_complexity", F.col("min_complexity").cast("long").alias("min_complexity"), F.col("max_complexity").cast("long").alias("max_complexity"), "entities")


@query("SELECT DISTINCT conv_id, turn, name FROM conversations, (VALUES ('ask', 'the'), ('ask', 'and'), ('greet', 'hello')) r(name, keyword) WHERE contains(lower(text), keyword)")
def l01_rules_as_table(spark, sf):
    rules = spark.createDataFrame([("ask", "the"), ("ask", "and"), ("greet", "hello")], "name string, keyword string")
    c = table(spark, sf, "conversations").withColumn("q_id", F.struct("conv_id", "turn"))
    return semantic.rule_matches(c, rules, "q_id", "text").select("q_id.conv_id", "q_id.turn", "name")


@query(f"SELECT p_partkey AS id, {case(["'EASY'", "'NON-NESTED'", "'NESTED'"])} AS class, 'part.' || p_size || ',supplier' AS links FROM part")
def t05_replies(spark, sf):
    reply = pick(['Label: "EASY"', "so Label: 'NON-NESTED'", "it is NESTED"])
    link = F.concat(F.lit("Thus Schema_links: [part."), F.col("p_size").cast("string"), F.lit(", supplier]"))
    return parts(spark, sf).select("id", prompts.decomposition_class(reply).alias("class"), F.array_join(prompts.schema_links(link), ",").alias("links"))


@query(f"SELECT p_partkey AS id, {case(['true', 'false', 'true'])} AS server, {case(["'SELECT a FROM t'", "'SELECT b'", "'SELECT a FROM t'"])} AS sql FROM part")
def o12_o15_answers(spark, sf):
    text = pick(["<think>x</think> SELECT a FROM t", "b", "SELECT a FROM t"])
    return parts(spark, sf).select("id", prompts.is_server_error(pick(["Error 503", "no such table", "Deadline exceeded"])).alias("server"), sqltext.strip_thoughts(text).alias("sql"))


# ---- sources -----------------------------------------------------------------------------


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 5 IN (0, 1, 2, 3)")
def s22_o13_failed(spark, sf):
    sql = pick(["SELECT 1", " select 1 ", "", "NULL", "SELECT a FROM t"])
    return corpora.failed(parts(spark, sf).select("id", sql.alias("sql"))).select("id")


@query("SELECT p_partkey AS id FROM part WHERE p_partkey % 2 = 1")
def s18_resolved(spark, sf):
    rows = parts(spark, sf).select("id", pick(["SELECT col FROM t", "SELECT col1 FROM t"]).alias("query"))
    return corpora.resolved(rows).select("id")


@query("SELECT p_partkey AS db_id, 't' || p_partkey AS name, 2::BIGINT AS n, p_brand AS second FROM part")
def s08_single_catalog(spark, sf):
    t = parts(spark, sf).select("id", F.concat(F.lit("t"), F.col("id").cast("string")).alias("name"), F.array(F.lit("a"), F.col("p_brand")).alias("header"), F.array(F.lit("text"), F.lit("real")).alias("types"))
    c = corpora.single_catalog(t)
    return c.select("db_id", F.col("table_names_original")[0].alias("name"), F.size("column_names_original").cast("long").alias("n"), F.col("column_names_original")[1][1].alias("second"))


@query("SELECT 'dev_' || p_partkey AS id, 'Database: ' || p_brand || chr(10) || 'Question: ' || p_name AS document, 'questions' AS type FROM part")
def s17_index_rows(spark, sf):
    ex = parts(spark, sf).select(F.col("id").alias("example_id"), F.col("p_brand").alias("db_id"), F.col("p_name").alias("question"), F.lit("select").alias("query"), F.lit("dev").alias("split"))
    doc = F.concat(F.lit("Database: "), "db_id", F.lit("\nQuestion: "), "question")
    return corpora.index_rows(ex, "questions", doc, F.array(F.lit(1.0))).select("id", "document", "type")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'again' ELSE p_name END AS sql FROM part")
def s22_replaced(spark, sf):
    p = parts(spark, sf).select(F.col("id").alias("line"), F.col("p_name").alias("sql"))
    return corpora.replace_failed(p, p.filter("line % 3 = 0").select("line", F.lit("again").alias("sql"))).select(F.col("line").alias("id"), "sql")


@query(f"SELECT p_partkey AS id, {case(["'REAL'", "'TEXT'", "'REAL'"])} AS type FROM part")
def s13_types(spark, sf):
    return parts(spark, sf).select("id", corpora.sql_type(pick(["Number", "text", "real"])).alias("type"))


@query("SELECT 'part' AS \"table\", lower(name) AS \"column\" FROM (SELECT unnest(['p_partkey', 'p_name', 'p_brand', 'p_type', 'p_size', 'p_retailprice']) AS name)")
def s15_introspection(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return corpora.introspect(spark, ["part"]).select("table", "column")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY 1, 2")
def o_stream_daily_counts(spark, sf):
    from ..streaming import grades

    # the plan of the stream, over the whole table at once
    return grades.daily_counts(table(spark, sf, "events"))
