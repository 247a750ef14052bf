"""Queries for grading end to end, strict reading, the store, retrieval as a whole, and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parser, prompts, semantic, sqltext, statements, strict
from ..operators import evaluate, grading, results, retrieval, singletable, store, strategies
from ..sources import corpora
from ..staging import staged
from .details import case, parts, pick
from .registry import query, spread, table
from .tables import PAIRS, _pairs, _store, _two_results
from .textual import _structural


def text(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


# ---- grading end to end ------------------------------------------------------------------

SCHEMA = '{"part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size"], "supplier": ["s_suppkey", "s_name"]}'
#: What a gold statement may be made of; every part changes what the grader counts.
ITEMS = ("p_name", "p_name , p_type", "count(*)", "max(p_size) , min(p_size)")
FROMS = ("part", "part AS t1 RIGHT JOIN supplier AS t2 ON t1.p_partkey = t2.s_suppkey")
WHERES = ("", " WHERE p_size > {n}", " WHERE p_size > {n} AND p_brand = '{b}'", " WHERE p_size > {n} OR p_name LIKE '%red%'", " WHERE p_size > ( SELECT avg(p_size) FROM part )", " WHERE p_type NOT IN ( SELECT p_type FROM part WHERE p_size = {n} )")
ENDS = ("", " GROUP BY p_brand", " ORDER BY p_size DESC LIMIT 3", " GROUP BY p_brand HAVING count(*) > 1", " UNION SELECT p_name FROM part WHERE p_size < {n}")
SHAPES = len(ITEMS) * len(FROMS) * len(WHERES) * len(ENDS)


def _corpus(spark, sf):
    """Lines (line, session, db_id, sql) of gold and prediction: 240 shapes; every fourth line right, or with a further column, a column that is not there, or none at all."""
    p = table(spark, sf, "part")
    k, n = F.col("p_partkey"), 1
    sql = F.lit("SELECT ")
    for values in (ITEMS, FROMS, WHERES, ENDS):
        chosen = F.element_at(F.array(*map(F.lit, values)), (F.floor(k / n) % len(values) + 1).cast("int"))
        sql = F.concat(sql, chosen, F.lit(" FROM ")) if n == 1 else F.concat(sql, chosen)
        n *= len(values)
    sql = F.replace(F.replace(sql, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{b}"), F.col("p_brand"))
    rows = p.select(k.alias("line"), F.floor(k / 6).alias("session"), F.lit("shop").alias("db_id"), sql.alias("sql"))
    kind = F.floor(F.col("line") / SHAPES + F.col("line")) % 4
    spelled = F.regexp_replace(F.regexp_replace(F.replace(F.col("sql"), F.lit("RIGHT JOIN"), F.lit("left outer  join")), "SELECT", "select "), "WHERE", "where\n")
    pred = F.when(kind == 0, spelled).when(kind == 1, F.regexp_replace("sql", "^SELECT", "SELECT p_brand ,")).when(kind == 2, F.regexp_replace("sql", "^SELECT", "SELECT p_weight ,")).otherwise("SELECT 1")
    catalogs = spark.createDataFrame([("shop", SCHEMA)], "db_id string, catalog string")
    return evaluate.pair_lines(rows, rows.select("line", pred.alias("sql"))), catalogs


# The same from the parts' numbers: clauses, nested queries, and what else counts, with an absent ORDER BY counted as one
# and a negated condition, and each entry of HAVING that is a connector or negated, counted as an aggregate.
GRADED = f"""(SELECT line, line // 6 AS session, kind, CASE WHEN kind = 3 THEN 'unknown' WHEN c1 <= 1 AND o = 0 AND c2 = 0 THEN 'easy' WHEN (o <= 2 AND c1 <= 1 AND c2 = 0) OR (c1 <= 2 AND o < 2 AND c2 = 0) THEN 'medium'
    WHEN (o > 2 AND c1 <= 2 AND c2 = 0) OR (2 < c1 AND c1 <= 3 AND o <= 2 AND c2 = 0) OR (c1 <= 1 AND o = 0 AND c2 <= 1) THEN 'hard' ELSE 'extra' END AS hardness
    FROM (SELECT line, kind, (w > 0)::INT + (e IN (1, 3))::INT + 1 + (e = 2)::INT + f + CASE WHEN w = 3 THEN 2 ELSE 0 END AS c1, (w >= 4)::INT + (e = 4)::INT AS c2,
        (CASE i WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END + (w = 5)::INT > 1)::INT + (i IN (1, 3))::INT + (w IN (2, 3))::INT AS o
    FROM (SELECT p_partkey AS line, floor(p_partkey / {SHAPES}.0 + p_partkey)::INT % 4 AS kind, p_partkey % 4 AS i, (p_partkey // 4) % 2 AS f, (p_partkey // 8) % 6 AS w, (p_partkey // 48) % 5 AS e FROM part)))"""


def _graded(spark, sf):
    pairs, catalogs = _corpus(spark, sf)
    verdicts = pairs.select("line", (F.col("line") % 3 == 0).alias("equal"))
    return evaluate.grade(pairs, catalogs, verdicts)


@query(f"SELECT line, hardness, kind = 0 AS exact_match, line % 3 = 0 AS execution_match FROM {GRADED}")
def grade_corpus(spark, sf):
    return _graded(spark, sf).select("line", "hardness", "exact_match", "execution_match")


@query(f"""SELECT level, count(*) AS count, round(avg(e), 6) AS exact, round(avg(x), 6) AS exec FROM (
    SELECT unnest([hardness, 'all', CASE WHEN line % 6 >= 4 THEN 'turn > 4' ELSE 'turn ' || (line % 6 + 1) END]) AS level, (kind = 0)::INT::DOUBLE AS e, (line % 3 = 0)::INT::DOUBLE AS x FROM {GRADED}
    UNION ALL SELECT 'joint_all', min((kind = 0)::INT)::DOUBLE, min((line % 3 = 0)::INT)::DOUBLE FROM {GRADED} GROUP BY session) GROUP BY level""")
def m18_m20_report(spark, sf):
    return evaluate.report(_graded(spark, sf))


@query(f"""WITH g AS (SELECT * FROM {GRADED}), s AS (SELECT hardness AS level, count(*) AS n, 100 * avg((kind = 0)::INT) AS e, 100 * avg((line % 3 = 0)::INT) AS x FROM g GROUP BY 1 UNION ALL SELECT 'all', count(*), 100 * avg((kind = 0)::INT), 100 * avg((line % 3 = 0)::INT) FROM g)
    SELECT * FROM (VALUES (0, 'SHOP EVALUATION SUMMARY'), (1, 'MAIN METRICS'), (100, 'SEMANTIC LAYER STATISTICS'), (101, '  rules: 3'), (1000, 'PER-DIFFICULTY BREAKDOWN')) v(place, text)
    UNION ALL SELECT unnest([2, 3, 4]), unnest([printf('  Exact Match Accuracy : %.2f%%', round(e / 100, 6) * 100), printf('  Execution Accuracy   : %.2f%%', round(x / 100, 6) * 100), '  Total Evaluated      : ' || n]) FROM s WHERE level = 'all'
    UNION ALL SELECT 1000 + list_position(['easy', 'medium', 'hard', 'extra', 'all'], level), '  ' || rpad(level, 8, ' ') || ' | count=' || rpad(n::VARCHAR, 5, ' ') || printf(' | EM=%.2f%% | EX=%.2f%%', round(e / 100, 6) * 100, round(x / 100, 6) * 100) FROM s WHERE level <> 'unknown'""")
def m20_summary_lines(spark, sf):
    return evaluate.summary_lines(evaluate.report(_graded(spark, sf)), "SHOP", {"semantic layer statistics": {"rules": 3}})


@query("SELECT event_type AS level, rpad(event_type, 20, ' ') || ' ' || rpad(printf('%.3f', round(avg(value), 6)), 20, ' ') || ' ' || printf('%.3f', round(max(value), 6)) AS line FROM events GROUP BY 1")
def m19_printed_table(spark, sf):
    wide = table(spark, sf, "events").groupBy(F.col("event_type").alias("level")).agg(F.round(F.avg("value"), 6).alias("a"), F.round(F.max("value"), 6).alias("b"))
    return evaluate.printed_table(wide, "level", ("a", "b"))


EXECUTED = (
    ("SELECT p_name, p_size FROM part", "SELECT DISTINCT p_size, p_name FROM part"), ("SELECT count(*) FROM part WHERE p_size > 25", "SELECT count(*) FROM part WHERE p_size > = 25"),
    ("SELECT p_name FROM part ORDER BY p_partkey", "SELECT p_name FROM part ORDER BY p_partkey DESC"), ("SELECT p_name FROM part", "SELECT p_weight FROM part"), ("SELECT max(p_size) FROM part WHERE p_size < 0", "SELECT min(p_size) FROM part WHERE p_size < 0"),
    # the same order from plans with other partitions; a word inside a literal; failures at run time; an endless one; a change
    ("SELECT o_orderkey FROM orders ORDER BY o_orderkey", "SELECT o_orderkey FROM (SELECT o_orderkey, count(*) AS c FROM orders GROUP BY o_orderkey) ORDER BY o_orderkey"),
    ("SELECT 'a distinct b' FROM part", "SELECT 'a  b' FROM part"), ("SELECT raise_error(p_name) FROM part", "SELECT p_name FROM part"), ("SELECT p_size FROM part", "SELECT CAST(p_name AS INT) FROM part"),
    ("SELECT p_size FROM part", "SELECT count(*) FROM range(1000000000000000) WHERE id % 3 = 4"), ("SELECT p_size FROM part", "DROP TABLE part"),
)
#: Further pairs, one for each size: every third prediction has another bound, every tenth fails at run time.
SIZES = [(f"SELECT p_brand, count(*) FROM part WHERE p_size <= {k} GROUP BY p_brand", f"SELECT {'raise_error(p_brand)' if k % 10 == 0 else 'count(*)'}, p_brand FROM part WHERE p_size < {k + (k % 3 > 0)} GROUP BY p_brand") for k in range(1, 51)]


@query("""
    SELECT 0::BIGINT AS line, true AS equal, 'result' AS status UNION ALL SELECT 1, count(*) FILTER (p_size = 25) = 0, 'result' FROM part UNION ALL SELECT 2, list(p_name ORDER BY p_partkey) = list(p_name ORDER BY p_partkey DESC), 'result' FROM part
    UNION ALL SELECT 3, false, 'exception' UNION ALL SELECT 4, true, 'result' UNION ALL SELECT 5, true, 'result' UNION ALL SELECT 6, false, 'result' UNION ALL SELECT unnest([7, 8, 10]), false, 'exception' UNION ALL SELECT 9, false, 'timeout'
    UNION ALL SELECT 10 + k, k % 10 <> 0 AND (k % 3 > 0 OR (SELECT count(*) FROM part WHERE p_size = k) = 0), CASE WHEN k % 10 = 0 THEN 'exception' ELSE 'result' END FROM range(1, 51) t(k)""")
def x01_execution_verdicts(spark, sf):
    # columns in another order, another bound, the other direction in an ordered result, a column that is not there, results that are null, ...
    for name in ("part", "orders"):
        table(spark, sf, name).createOrReplaceTempView(name)
    return evaluate.execution_verdicts(spark, [(k, *p) for k, p in enumerate((*EXECUTED, *SIZES))], seconds=5).select("line", "equal", "status")


@query("SELECT o_custkey AS query_id FROM orders WHERE o_custkey % 2 = 0 GROUP BY 1 HAVING max((o_orderkey % 40 = 0)::INT) = 1")
def x10_regression_scan(spark, sf):
    rows = _two_results(spark, sf).withColumn("cells", F.array_sort("cells"))
    before, after = rows.filter("side = -1").select("query_id", "cells"), rows.filter("side = 1").select("query_id", "cells")
    return results.regression_scan(before, after, before.select("query_id").distinct().filter("query_id % 2 = 0"))


@query("SELECT p_partkey AS id, lower(p_name) AS question, 2 * (contains(lower(p_name), 'total')::BIGINT + contains(lower(p_name), 'top')::BIGINT) AS score, p_partkey % 2 = 0 AS exact_match FROM part")
def o04_wrapped_grades(spark, sf):
    rows = parts(spark, sf).select("id", (F.col("id") % 2 == 0).alias("exact_match"), F.lower("p_name").alias("question"))
    graded, _ = evaluate.grade_with_analysis(rows)
    plain = F.filter("analysis.metrics", lambda m: m.isin("sum_value", "max_value"))
    return graded.select("id", "question", (2 * F.size(plain)).cast("long").alias("score"), "exact_match")


@query("SELECT p_partkey AS id, 'what ' || p_name AS question FROM part")
def o19_clean_question(spark, sf):
    return parts(spark, sf).select("id", evaluate.clean_question(F.concat(F.lit("  what \t "), "p_name", F.lit("\n"))).alias("question"))


# ---- strict reading ----------------------------------------------------------------------


def _headers():
    return F.array(*map(F.lit, ("Part Name", "Brand", "Size (cm)")))


@query("""SELECT p_partkey AS id, [1, 3, 0, NULL][(p_partkey % 4 + 1)::INT]::BIGINT AS agg, [2, -999, 0, NULL][(p_partkey % 4 + 1)::INT]::BIGINT AS sel, CASE p_partkey % 4 WHEN 0 THEN '1 0 ' || lower(p_brand) || ',2 1 ' || p_size || '.0' WHEN 1 THEN '2 2 ' || p_size || '.0,1 3 ' || lower(p_brand)
    WHEN 2 THEN '1 0 ' || lower(p_brand) END AS conds FROM part""")
def p10_parse_strict(spark, sf):
    # symbols, a word operator before a symbol, a nested comparison that is left out, and two columns, which do not parse
    b, n = F.col("p_brand"), F.col("p_size").cast("string")
    sql = F.when(F.col("id") % 4 == 0, F.concat(F.lit("SELECT MAX(size cm) FROM t WHERE brand = '"), b, F.lit("' AND size cm > "), n))
    sql = sql.when(F.col("id") % 4 == 1, F.concat(F.lit("SELECT COUNT(*) FROM t WHERE brand LIKE '"), b, F.lit("' AND size_cm<="), n))
    sql = sql.when(F.col("id") % 4 == 2, F.concat(F.lit("SELECT Part Name FROM t WHERE size_cm = (SELECT size_cm FROM t WHERE (brand = 'x')) AND brand = '"), b, F.lit("' LIMIT 1;")))
    rows = strict.parse_strict(parts(spark, sf).withColumn("sql", sql.otherwise("SELECT brand, part_name FROM t")).withColumn("headers", _headers()), "sql", "headers")
    shown = F.transform("strict.conds", lambda c: F.concat_ws(" ", c["col"].cast("string"), c["op"].cast("string"), F.coalesce(c["val"]["num"].cast("string"), c["val"]["str"])))
    return rows.select("id", F.col("strict.agg").cast("long").alias("agg"), F.col("strict.sel").cast("long").alias("sel"), F.array_join(shown, ",").alias("conds"))


def _golds(spark, sf):
    structured = F.concat(F.lit('{"agg": 1, "sel": 2, "conds": [[1, 0, "'), "p_brand", F.lit('"], [2, 1, "'), F.col("p_size").cast("string"), F.lit('"], [9]]}'))
    plain = F.concat(F.lit("SELECT MAX(size cm) FROM t WHERE brand = '"), "p_brand", F.lit("' AND size cm > "), F.col("p_size").cast("string"))
    rows = spread(spark, parts(spark, sf)).withColumn("gold_text", F.when(F.col("id") % 3 == 0, structured).when(F.col("id") % 3 == 1, plain).otherwise("neither")).withColumn("headers", _headers())
    return strict.gold_struct(rows, "gold_text", "headers")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 < 2 THEN 1 END::BIGINT AS agg, CASE WHEN p_partkey % 3 < 2 THEN 2 END::BIGINT AS sel, CASE WHEN p_partkey % 3 < 2 THEN lower(p_brand) || ' ' || p_size || '.0' END AS vals FROM part")
def p11_gold_struct(spark, sf):
    shown = F.array_join(F.transform("gold.conds", lambda c: F.coalesce(c["val"]["num"].cast("string"), c["val"]["str"])), " ")
    return _golds(spark, sf).select("id", F.col("gold.agg").cast("long").alias("agg"), F.col("gold.sel").cast("long").alias("sel"), shown.alias("vals"))


@query("SELECT p_partkey AS id, p_partkey % 3 < 2 AND p_partkey % 4 <> 1 AS agg_ok, p_partkey % 3 < 2 AND p_partkey % 4 NOT IN (2, 3) AS cond_ok, p_partkey % 3 < 2 AND p_partkey % 4 = 0 AS em FROM part")
def e_strict_match(spark, sf):
    # right, another aggregate, another operator, a condition short: nothing is forgiven
    head = pick(["SELECT MAX(size cm)", "SELECT size cm", "SELECT MAX(size cm)", "SELECT MAX(size cm)"])
    where = pick([" AND size cm > ", " AND size cm > ", " AND size cm < ", ""])
    sql = F.concat(head, F.lit(" FROM t WHERE brand = '"), "p_brand", F.lit("'"), F.when(where != "", F.concat(where, F.col("p_size").cast("string"))).otherwise(""))
    rows = strict.parse_strict(_golds(spark, sf).withColumn("sql", sql), "sql", "headers", "pred")
    s = strict.structural_strict(F.col("pred"), F.col("gold"))
    return rows.select("id", *[F.coalesce(s[c], F.lit(False)).alias(c) for c in ("agg_ok", "cond_ok", "em")])


@query("SELECT p_partkey AS id, [NULL, 1][(p_partkey % 2 + 1)::INT]::BIGINT AS lite, 1::BIGINT AS whole, p_size::DOUBLE AS num FROM part")
def o01_lite(spark, sf):
    # without looking inside AGG(...), and without number formats
    name = pick(["MAX(Brand)", "Brand"])
    return parts(spark, sf).select("id", singletable.resolve_column(name, _headers(), lite=True).cast("long").alias("lite"), singletable.resolve_column(name, _headers()).cast("long").alias("whole"), singletable.value_lite(F.concat(F.lit("'"), F.col("p_size").cast("string"), F.lit("%'")))["num"].alias("num"))


@query("SELECT p_partkey AS id, 'Brand = ' || lower(p_brand) || ' AND Size > ' || p_size || '.0' AS shown FROM part")
def e17_readable_conditions(spark, sf):
    return _structural(spark, sf).select("id", singletable.readable(F.col("gold.conds"), F.col("headers")).alias("shown"))


@query("SELECT place, text FROM (SELECT unnest([0, 1, 4, 5]) AS place, unnest([printf('Structural EM   : %.2f%%', 100 * round(avg((k < 2)::INT), 6)), printf('AGG accuracy    : %.2f%%', 100 * round(sum((k IN (0, 1, 3))::INT) / sum((k < 4)::INT), 6)), printf('Parse rate      : %.2f%%', 100 * round(avg((k < 4)::INT), 6)), 'Parse failures  : ' || sum((k = 4)::INT)]) AS text FROM (SELECT p_partkey % 5 AS k FROM part))")
def m20_structural_lines(spark, sf):
    rows = staged(_structural(spark, sf).select("gold_ok", "pred_ok", "agg_ok", "sel_ok", "cond_ok", "em"), "verdicts")  # read twice
    category = singletable.failure_category(*[F.col(c) for c in ("gold_ok", "pred_ok", "agg_ok", "sel_ok", "cond_ok")])
    lines = evaluate.structural_lines(singletable.accuracy(rows), singletable.failure_report(rows.select(category.alias("category"))))
    return lines.filter("place IN (0, 1, 4, 5)")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'external' WHEN p_partkey % 3 < 2 THEN 'embedded' ELSE 'sanitised' END AS header FROM part")
def p12_header_priority(spark, sf):
    p = parts(spark, sf).select("id")
    named = lambda where, name: p.filter(where).select("id", F.array(F.lit(name)).alias("headers"))
    found = corpora.headers_for(p, "id", named("id % 3 = 0", "external"), named("id % 3 < 2", "embedded"), named("true", "sanitised"))
    return found.select("id", F.get("headers", F.lit(0)).alias("header"))


# ---- names and schemas -------------------------------------------------------------------


@query("SELECT p_partkey AS asked, CASE WHEN p_partkey % 3 = 0 THEN 'part' WHEN p_partkey % 3 = 1 THEN 'supplier' END AS \"table\", CASE WHEN p_partkey % 3 = 0 THEN 'p_size' WHEN p_partkey % 3 = 1 THEN 's_name' END AS \"column\" FROM part WHERE p_partkey % 3 < 2")
def r22_column_resolution(spark, sf):
    # names as a model writes them, looked up in the tables of the statement in turn
    for n in ("part", "supplier"):
        table(spark, sf, n).createOrReplaceTempView(n)
    names = pick(["p__size", "s_name_", "p_weight"])
    asked = parts(spark, sf).select(F.concat_ws("/", F.col("id").cast("string"), names).alias("key"), names.alias("asked"), F.array(F.lit("supplier"), F.lit("part")).alias("scope"))
    found = parser.resolved_columns(asked.select("asked", "scope").distinct(), corpora.introspect(spark, ["part", "supplier"]))
    return asked.join(found, "asked").select(F.split("key", "/")[0].cast("long").alias("asked"), "table", "column")


@query("SELECT p_partkey AS id, p_partkey % 3 = 0 AS keyword, p_partkey % 3 = 1 AS identifier FROM part")
def p03_names(spark, sf):
    name = pick(["Group", "p_size", "2nd"])
    return parts(spark, sf).select("id", parser.is_keyword(name).alias("keyword"), parser.is_identifier(name).alias("identifier"))


@query("SELECT s_suppkey AS db_id, k AS col_idx, CASE WHEN k IN (2, 9) THEN 2 ELSE 1 END::BIGINT AS canonical FROM supplier, (SELECT unnest([1, 3, 2, 9]) AS k) UNION ALL SELECT s_suppkey, s_suppkey + 20, 1 FROM supplier")
def p07_foreign_key_sets(spark, sf):
    # 3-1 and 20+x-3 are one set; 9-2 is another, which 9-... does not join
    from ..shipping import ship

    ship(spark)
    pair = lambda a, b: F.array(a if not isinstance(a, int) else F.lit(a), F.lit(b))
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("db_id"), F.array(pair(3, 1), pair((F.col("s_suppkey") + 20).cast("int"), 3), pair(9, 2)).alias("foreign_keys"))
    got = corpora.canonical_keys(rows)
    return got.select(F.col("db_id").cast("long").alias("db_id"), F.col("col_idx").cast("long").alias("col_idx"), F.col("canonical").cast("long").alias("canonical"))


@query("SELECT DISTINCT lower(p_brand) AS wanted, CASE WHEN (SELECT count(DISTINCT q.p_brand) FROM part q WHERE lower(q.p_brand) = lower(part.p_brand)) = 1 THEN p_brand ELSE lower(p_brand) END AS stored FROM part UNION ALL SELECT 'nowhere', 'nowhere'")
def n24_literal_casing(spark, sf):
    brands = parts(spark, sf).select(F.col("p_brand").alias("value"))
    wanted = brands.select(F.lower("value").alias("wanted")).unionByName(spark.createDataFrame([("nowhere",)], "wanted string"))
    return sqltext.grounded(wanted, brands)


def _owners(spark, sf):
    rows = parts(spark, sf).select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(a).alias("alias"), F.lit(c).alias("column")) for k, (a, c) in enumerate((("t1", "name"), ("t2", "NAME"), ("t2", "city")))])).alias("o"))
    return rows.select("id", "o.*")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 't1.Name' ELSE 'city' END AS shown FROM part")
def n25_qualified(spark, sf):
    columns = parts(spark, sf).select("id", pick(["Name", "city"]).alias("column"))
    return sqltext.qualified(columns, _owners(spark, sf)).select("id", "shown")


@query("SELECT p_partkey AS id, 't1' AS alias, 'city' AS \"column\" FROM part WHERE p_partkey % 2 = 1")
def n26_unknown_references(spark, sf):
    used = parts(spark, sf).select("id", pick(["t2", "t1"]).alias("alias"), F.lit("City").alias("column"))
    return sqltext.unknown_references(used, _owners(spark, sf))


@query("SELECT p_partkey AS id, p_name AS a, p_brand || ',' || p_type AS b, p_name || '=' || p_brand AS c FROM part")
def n22_backticks(spark, sf):
    tick = lambda c: F.concat(F.lit("`"), F.col(c), F.lit("`"))
    deep = F.struct(tick("p_name").alias("a"), F.struct(F.array(tick("p_brand"), tick("p_type")).alias("list"), F.create_map(F.lit("k"), F.struct(F.concat(tick("p_name"), F.lit("="), tick("p_brand")).alias("x"))).alias("map")).alias("inner"))
    rows = parts(spark, sf).select("id", deep.alias("deep"))
    clean = rows.select("id", statements.clean_backticks(F.col("deep"), rows.schema["deep"].dataType).alias("d"))
    return clean.select("id", F.col("d.a").alias("a"), F.array_join("d.inner.list", ",").alias("b"), F.col("d.inner.map")["k"]["x"].alias("c"))


@query("SELECT n_name AS nation, r_name AS region FROM nation RIGHT JOIN (SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE') r ON n_regionkey = r_regionkey")
def r07_right_join(spark, sf):
    for n in ("nation", "region"):
        table(spark, sf, n).createOrReplaceTempView(n)
    return spark.sql("SELECT n_name AS nation, r_name AS region FROM nation RIGHT JOIN (SELECT * FROM region UNION ALL SELECT 99, 'NOWHERE') r ON n_regionkey = r_regionkey")


@query("SELECT p_partkey AS id, n AS place, 'SELECT a FROM t WHERE b = ' || CASE WHEN n < 2 THEN p_size ELSE 7 END || ' AND c = ' || CASE WHEN n % 2 = 0 THEN p_size ELSE 7 END AS sql FROM part, range(4) r(n) WHERE p_size <> 7")
def n18_every_way(spark, sf):
    # each way made alone, as a statement with very many of them has it
    sql = F.concat(F.lit("SELECT a FROM t WHERE b = "), F.col("p_size").cast("string"), F.lit(" AND c = 7"))
    rows = parts(spark, sf).filter("p_size <> 7").select("id", sqltext.strip_values(sql).alias("s"))
    each = rows.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), sqltext.ways(F.col("s.tokens"), F.col("s.values")) - 1)))
    made = sqltext.nth_way(F.col("s.tokens"), F.col("s.values"), F.col("place"))
    return each.select("id", "place", F.replace(F.replace(F.replace(F.replace(made, F.lit("select"), F.lit("SELECT")), F.lit("from"), F.lit("FROM")), F.lit("where"), F.lit("WHERE")), F.lit(" and "), F.lit(" AND ")).alias("sql"))


# ---- retrieval ---------------------------------------------------------------------------


@query("SELECT q.vec_id AS q_id, i.vec_id AS id, round(1 - list_sum(list_transform(range(len(q.embedding)), lambda k: (q.embedding[k + 1]::DOUBLE - i.embedding[k + 1]::DOUBLE) ** 2)), 4) AS similarity FROM embeddings q JOIN embeddings i ON q.vec_id % 50 = 0 AND i.label = q.label")
def v08_distance(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("q_vec"), "label")
    pairs = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label").join(q, "label")
    return pairs.select("q_id", "id", F.round(retrieval.similarity_of_distance(retrieval.squared_distance(F.col("q_vec"), F.col("vec"))), 4).alias("similarity"))


def _rounded(spark, sf, k=None, where=None):
    return _pairs(spark, sf, k, where).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs WHERE label = 0) SELECT q_id, id, rank::BIGINT AS rank FROM r WHERE rank <= 4")
def v06_relevant_schemas(spark, sf):
    return retrieval.relevant_schemas(_rounded(spark, sf, 4, {"label": 0}), 4).select("q_id", "id", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {PAIRS}, a AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS near FROM pairs WHERE label = 1), a2 AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM a WHERE near <= 6 AND s >= 0.05),
    b AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs WHERE label = 2), c AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs WHERE label = 0)
    SELECT 'question' AS kind, q_id, id, rank::BIGINT AS rank FROM a2 WHERE rank <= 2 UNION ALL SELECT 'statement', q_id, id, rank FROM b WHERE rank <= 2 AND s >= 0.05 UNION ALL SELECT 'schema', q_id, id, rank FROM c WHERE rank <= 2""")
def v07_comprehensive(spark, sf):
    questions, known, schemas = (_rounded(spark, sf, k, {"label": label}) for k, label in ((6, 1), (2, 2), (2, 0)))
    found = retrieval.comprehensive(questions, known, schemas, 2, 0.05, F.lit(False))
    return found.select("kind", "q_id", "id", F.col("rank").cast("long").alias("rank"))


@query("SELECT c_custkey AS id, ['leave', 'schema', 'sql', 'question', 'all-schemas', 'empty', 'help'][(c_custkey % 7 + 1)::INT] AS kind, CASE WHEN c_custkey % 7 IN (1, 2) THEN c_name WHEN c_custkey % 7 = 3 THEN 'who is ' || c_name ELSE '' END AS text FROM customer")
def v12_commands(spark, sf):
    n = F.col("c_name")
    typed = F.element_at(F.array(F.lit(" Quit "), F.concat(F.lit("schema  "), n), F.concat(F.lit("SQL "), n, F.lit(" ")), F.concat(F.lit("who is "), n), F.lit("ALL-schemas"), F.lit("   "), F.lit("help")), (F.col("c_custkey") % 7 + 1).cast("int"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), retrieval.command(typed).alias("c")).select("id", "c.kind", "c.text")


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY s DESC, id) AS rank FROM pairs) SELECT q_id, rank || '. ' || id AS line FROM r WHERE rank <= 3")
def o17_shown(spark, sf):
    found = retrieval.shown(retrieval.top(_rounded(spark, sf, 3), 3, F.desc("similarity"), F.col("id")), "id")
    return found.select("q_id", F.regexp_replace("line", r" \([^)]*\)$", "").alias("line"))


@query("""
    WITH asked AS (SELECT DISTINCT user_id AS q_id FROM events), hits AS (SELECT user_id AS q_id, count(*) AS n FROM events WHERE user_id % 3 > 0 AND value > 50 GROUP BY 1),
    best AS (SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey % 7 DESC, s_suppkey) AS rank FROM supplier LIMIT 2)
    SELECT q_id, n AS id, 1::BIGINT AS rank, 1.0::DOUBLE AS score FROM hits
    UNION ALL SELECT a.q_id, b.id, b.rank, 0.0 FROM asked a ANTI JOIN hits h ON a.q_id = h.q_id, best b WHERE b.rank <= 2""")
def v11_fallback(spark, sf):
    # every third user finds nothing, whatever the scale
    e = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), "value")
    found = e.filter("q_id % 3 > 0 AND value > 50").groupBy("q_id").agg(F.count(F.lit(1)).alias("id")).select("q_id", "id", F.lit(1).alias("rank"), F.lit(1.0).alias("score"))
    known = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("strategy_id"), F.lit(True).alias("is_active"), (F.col("s_suppkey") % 7).alias("success_rate"))
    got = retrieval.hybrid_fallback(found, known, e.select("q_id").distinct(), 2)
    return got.select("q_id", "id", F.col("rank").cast("long").alias("rank"), "score")


# ---- store and trajectories --------------------------------------------------------------

AT = "TIMESTAMP '2024-05-06 07:08:09'"


def _at():
    return F.lit("2024-05-06 07:08:09").cast("timestamp")


@query(f"SELECT 'app_20240506070809_' || substr(md5((user_id % 20) || chr(9) || event_id), 1, 8) AS application_id, (user_id % 20)::VARCHAR AS strategy_id, event_id::VARCHAR AS trajectory_id, value > 30 AS success, NULL::DOUBLE AS exact_match, {AT} AS applied_at FROM events")
def b05_o10_applications(spark, sf):
    runs = table(spark, sf, "events").select((F.col("user_id") % 20).cast("string").alias("strategy_id"), F.col("event_id").cast("string").alias("trajectory_id"), (F.col("value") > 30).alias("success"))
    return store.applications(runs, _at()).select("application_id", "strategy_id", "trajectory_id", "success", "exact_match", "applied_at")


@query(f"SELECT s_suppkey::VARCHAR AS strategy_id, 2 AS version, round(s_suppkey % 7, 6)::DOUBLE AS performance_before, 0.5::DOUBLE AS performance_after, round(0.5 - s_suppkey % 7, 6)::DOUBLE AS performance_delta, {AT} AS evolved_at FROM supplier WHERE s_suppkey % 2 = 0")
def b01_evolution(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("strategy_id"), F.col("s_name").alias("name"), F.lit("P").alias("pattern"), (F.col("s_suppkey") % 7).alias("success_rate"))
    known = store.typed(rows, "strategies")
    new = store.typed(rows.filter("strategy_id % 2 = 0").withColumn("success_rate", F.lit(0.5)), "strategies")
    _, history = strategies.upsert(known, new, "2024-05-06")
    return store.evolution(history, _at()).select("strategy_id", F.col("version").cast("int").alias("version"), "performance_before", "performance_after", "performance_delta", "evolved_at")


@query("SELECT s_suppkey::VARCHAR AS strategy_id, s_name AS name, 'a,b' AS steps, 0.0::DOUBLE AS success_rate, 0::BIGINT AS sample_count, 1 AS version, true AS is_active FROM supplier")
def b01_s23_round_trip(spark, sf):
    # as JSON and back: typed, with the table's defaults
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("strategy_id"), F.col("s_name").alias("name"), F.lit("P").alias("pattern"), F.array(F.lit("a"), F.lit("b")).alias("reasoning_steps"))
    text = store.typed(rows, "strategies").select(F.to_json(F.struct("*")).alias("j"))
    back = text.select(F.from_json("j", store.TABLES["strategies"]).alias("r")).select("r.*")
    return back.select("strategy_id", "name", F.array_join("reasoning_steps", ",").alias("steps"), "success_rate", "sample_count", "version", "is_active")


def _log(spark, sf):
    e = table(spark, sf, "events")
    made = {"trajectory_id": F.col("event_id").cast("string"), "question": F.col("event_type"), "database": F.lit("d"), "generated_sql": F.lit("SELECT 1"), "strategies_used": F.array((F.col("user_id") % 20).cast("string"), (F.col("user_id") % 3 + 20).cast("string")), "generation_time": F.col("value"), "timestamp": F.unix_timestamp("ts").cast("double")}
    return e.select(*[(made[n] if n in made else F.lit(None)).cast(t).alias(n) for n, t in (x.split(" ", 1) for x in store.TRAJECTORY.split(", "))])


@query("SELECT event_id::VARCHAR AS trajectory_id, CASE WHEN event_id % 5 = 0 THEN 'again' ELSE event_type END AS question, (user_id % 20) || ',' || (user_id % 3 + 20) AS used, round(value, 6) AS generation_time FROM events")
def o08_trajectories(spark, sf):
    # to JSON and back, and then a fifth of them put in anew
    log = _log(spark, sf)
    back = store.to_dicts(log).select(F.from_json("json", store.TRAJECTORY).alias("r")).select("r.*")
    got = store.added(back, back.filter("trajectory_id % 5 = 0").withColumn("question", F.lit("again")))
    return got.select("trajectory_id", "question", F.array_join("strategies_used", ",").alias("used"), F.round("generation_time", 6).alias("generation_time"))


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def j09_recent(spark, sf):
    return store.recent(table(spark, sf, "events").select("event_id", "ts"), 20, "ts", "event_id")


@query("SELECT count(*) AS total, round(avg(value), 6) AS avg_generation_time, count(*) FILTER (event_type <> 'view') AS judged, round(avg((event_type = 'click')::INT) FILTER (event_type <> 'view'), 6) AS success_rate FROM events")
def j09_log_statistics(spark, sf):
    judged = table(spark, sf, "events").filter("event_type <> 'view'").select(F.when(F.col("event_type") == "click", "COMPLETE_SUCCESS").otherwise("PARSE_FAILURE").alias("outcome"))
    return store.log_statistics(_log(spark, sf), judged)


@query("SELECT s::VARCHAR AS strategy_id, count(*) AS uses FROM (SELECT unnest([user_id % 20, 20 + user_id % 3]) AS s FROM events) JOIN supplier ON s = s_suppkey GROUP BY s")
def j13_matched_trajectories(spark, sf):
    known = _store(spark, sf).select(F.col("strategy_id").cast("string").alias("strategy_id"))
    return store.matched_uses(_log(spark, sf), known)


@query("SELECT action, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'KEEP' ELSE 'REFINE' END AS action FROM supplier) GROUP BY 1")
def j20_action_counts(spark, sf):
    history = table(spark, sf, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "KEEP").otherwise("REFINE").alias("action"), F.col("s_suppkey").alias("at"))
    return store.history_summary(history)[0]


@query("SELECT s_suppkey AS at FROM supplier ORDER BY s_suppkey DESC LIMIT 10")
def j20_last_entries(spark, sf):
    history = table(spark, sf, "supplier").select(F.lit("KEEP").alias("action"), F.col("s_suppkey").alias("at"))
    return store.history_summary(history)[1].select("at")


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'group, if one result for each group is asked for' WHEN 1 THEN 'qualify columns by their table' || CASE WHEN p_size < 25 THEN ' | the score is low: review the structure' ELSE '' END ELSE CASE WHEN p_size < 25 THEN 'the score is low: review the structure' ELSE 'nothing stands out' END END || CASE WHEN p_partkey % 3 = 0 AND p_size < 25 THEN ' | the score is low: review the structure' ELSE '' END AS feedback FROM part")
def j25_feedback(spark, sf):
    sql = pick(["SELECT COUNT(*) FROM t", "SELECT a FROM t JOIN u", "SELECT a FROM t"])
    return parts(spark, sf).select("id", store.feedback(sql, F.col("p_size") / 50).alias("feedback"))


@query("SELECT user_id AS q_id, round(max(s), 6) AS score FROM (SELECT user_id, value AS s FROM events UNION ALL SELECT user_id, 100 - value FROM events) GROUP BY 1")
def j26_hybrid_best(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("event_id").alias("candidate"), F.col("value").alias("score"))
    return store.hybrid_best(e, e.withColumn("score", 100 - F.col("score"))).select("q_id", F.round("score", 6).alias("score"))


@query("SELECT p_partkey AS id, 'SELECT ' || p_name AS sql FROM part")
def j28_fan_out(spark, sf):
    def write(frames):
        for f in frames:
            yield f.assign(sql="SELECT " + f["p_name"])[["id", "sql"]]

    return store.fan_out(parts(spark, sf).select("id", "p_name"), write, "id long, sql string")


@query("SELECT event_type AS outcome, count(*) AS n, round(avg(value), 6) AS avg_confidence, sum(user_id % 3)::BIGINT AS insights FROM events GROUP BY 1")
def o16_insight_summary(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("outcome"), F.col("value").alias("confidence"), F.array_repeat(F.lit("x"), (F.col("user_id") % 3).cast("int")).alias("insights"))
    return store.insight_summary(rows)


@query("SELECT count(DISTINCT user_id) AS questions, count(*) AS found, round(avg(value), 6) AS avg_relevance FROM events")
def o16_retrieval_statistics(spark, sf):
    return store.retrieval_statistics(table(spark, sf, "events").select(F.col("user_id").alias("q_id"), F.col("value").alias("relevance")))


# ---- questions and prompts ---------------------------------------------------------------

CONFIG = {"semantic_layer_config": {"metrics": {"count_patterns": ["the", "and"]}, "dimensions": {"temporal_patterns": ["day"]}, "entities": {"city": {"keywords": ["city", "town"]}}}}


@query("SELECT DISTINCT doc_id AS q_id, name FROM documents, (VALUES ('record_count', 'the'), ('record_count', 'and'), ('temporal', 'day'), ('city', 'city'), ('city', 'town'), ('vowel', 'io')) r(name, keyword) WHERE contains(lower(text), keyword)")
def o02_configured_rules(spark, sf):
    rules = semantic.with_rule(semantic.rules_from_config(spark, CONFIG), "entity", "vowel", "io")
    # met by a hash join on what a rule begins with, as more rules than can be broadcast are
    return semantic.rule_matches(table(spark, sf, "documents").select(F.col("doc_id").alias("q_id"), "text"), rules, "q_id", "text", most_broadcast=0)


@query("SELECT p_partkey AS id, 'Metrics: record_count' || chr(10) || 'Complexity: simple' AS hints, 'aggregate' AS approach, 'SELECT COUNT(*) FROM ' || replace(p_name, ' ', '_') AS sql, 'ask' || chr(10) || chr(10) || 'Hints:' || chr(10) || 'Metrics: record_count' || chr(10) || 'Complexity: simple' AS prompt FROM part")
def o03_o09_bundle(spark, sf):
    question, sql = F.lit("how many"), F.concat(F.lit("SELECT * FROM "), F.replace("p_name", F.lit(" "), F.lit("_")))
    rows = parts(spark, sf).select("id", semantic.bundle(question, sql).alias("b"))
    return rows.select("id", F.col("b.hints").alias("hints"), F.col("b.approach").alias("approach"), F.col("b.sql").alias("sql"), semantic.with_hints(F.lit("ask"), F.col("b.analysis")).alias("prompt"))


@query("SELECT p_partkey AS id, 'Table: t' || chr(10) || 'Columns: a, ' || p_brand || chr(10) || '1 | ' || p_size || chr(10) || '2 | x' AS shown FROM part")
def o05_table_text(spark, sf):
    rows = F.array(F.array(F.lit("1"), F.col("p_size").cast("string")), F.array(F.lit("2"), F.lit("x")))
    return parts(spark, sf).select("id", prompts.table_text(F.lit("t"), F.array(F.lit("a"), F.col("p_brand")), rows).alias("shown"))


def _composed_sql() -> str:
    head = "\n\n".join(["You are an expert SQL developer. Turn the question into one SQL query.", f"## VALIDATION RULES:\n{prompts.rules_text()}", f"## COMMON PATTERNS:\n{prompts.patterns_text()}", prompts.examples_text(2), f"## CRITICAL RULES (MUST FOLLOW):\n{prompts.critical_text()}"])
    return f"SELECT p_partkey AS id, {text(head + chr(10) * 2 + 'Database Schema:' + chr(10) + 't(a)' + chr(10) * 2 + 'Question:' + chr(10))} || p_name || {text(chr(10) * 2 + 'SQL Query:')} AS prompt FROM part"


@query(_composed_sql())
def t01_composed(spark, sf):
    return parts(spark, sf).select("id", prompts.composed(F.col("p_name"), F.lit("t(a)"), examples=2).alias("prompt"))


@query("SELECT k AS kind, p_partkey AS id, k IN ('few_shot', 'enhanced') AS examples, k IN ('rule_based', 'enhanced') AS rules, k = 'chain_of_thought' AS reasoning, k = 'step_by_step' AS steps, true AS critical, true AS asks FROM part, (SELECT unnest(['basic', 'few_shot', 'chain_of_thought', 'rule_based', 'enhanced', 'step_by_step', 'no such kind']) AS k)")
def t01_kinds(spark, sf):
    has = lambda c, s: F.col(c).contains(s)
    made = [parts(spark, sf).select(F.lit(k).alias("kind"), "id", "p_name", prompts.of_kind(k, F.col("p_name"), F.lit("t(a)")).alias("t")) for k in (*prompts.KINDS, "no such kind")]
    rows = made[0]
    for m in made[1:]:
        rows = rows.unionByName(m)
    return rows.select("kind", "id", has("t", "Example 1:").alias("examples"), has("t", "VALIDATION RULES").alias("rules"), has("t", "REASONING PROCESS").alias("reasoning"), has("t", "Step 1:").alias("steps"), has("t", "CRITICAL RULES").alias("critical"), F.col("t").contains(F.col("p_name")).alias("asks"))


@query("SELECT p_partkey AS id, 'You are an SQL debugging expert. Find the fault and mend it.' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || chr(10) || 'Schema: t(a)' || chr(10) || chr(10) || 'SQL: SELECT b FROM t' || chr(10) || chr(10) || 'Error: no b' || chr(10) || chr(10) || 'Please provide:' || chr(10) || '1. Error Analysis' || chr(10) || '2. Corrected SQL' || chr(10) || '3. Explanation' AS prompt FROM part")
def t01_special(spark, sf):
    return parts(spark, sf).select("id", prompts.special("debug", F.col("p_name"), F.lit("t(a)"), F.lit("SELECT b FROM t"), F.lit("no b")).alias("prompt"))


@query("SELECT p_partkey AS id, 'Write one SQL query that answers the question.' || chr(10) || chr(10) || 'Schema:' || chr(10) || 't(a)' || chr(10) || chr(10) || 'Question: ' || p_name || chr(10) || chr(10) || 'SQL:' AS prompt FROM part")
def t01_prompt(spark, sf):
    return parts(spark, sf).select("id", prompts.prompt("zero_shot", F.col("p_name"), F.lit("t(a)")).alias("prompt"))


# ---- sources -----------------------------------------------------------------------------


@query("SELECT p_partkey AS id, p_brand || chr(9) || replace(p_type, ' ', '-') || ' x' AS line FROM part WHERE p_partkey % 3 <> 0")
def s10_tsv_lines(spark, sf):
    brand = F.when(F.col("id") % 3 == 0, "  ").otherwise(F.col("p_brand"))
    rows = parts(spark, sf).select("id", brand.alias("a"), F.concat(F.replace("p_type", F.lit(" "), F.lit("-")), F.lit("\n\tx")).alias("b"))
    return corpora.tsv_lines(rows, "a", "b").select("id", F.col("value").alias("line"))


@query("SELECT DISTINCT p_brand AS db_id FROM part")
def s04_databases(spark, sf):
    return corpora.databases(parts(spark, sf).select(F.col("p_brand").alias("db_id")))


@query("SELECT p_partkey AS example_id FROM part ORDER BY 1 LIMIT 7")
def s04_samples(spark, sf):
    return corpora.samples(parts(spark, sf).select(F.col("id").alias("example_id")), 7)


@query("SELECT CASE WHEN source = 'web' THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY 1")
def s12_cross_domain(spark, sf):
    return corpora.cross_domain_split(table(spark, sf, "documents").withColumnRenamed("source", "db_id"), ["web"]).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS db_id, CASE WHEN ('0x' || substr(md5('7/' || p_brand), 1, 8))::BIGINT / 4294967296 < 0.75 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM part GROUP BY 1, 2")
def s12_database_split(spark, sf):
    rows = corpora.database_split(parts(spark, sf).select(F.col("p_brand").alias("db_id")), {"train": 3, "test": 1})
    return rows.groupBy("db_id", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT h AS hardness, CASE WHEN ('0x' || substr(md5('7/' || h || '/' || p_partkey), 1, 8))::BIGINT / 4294967296 < 0.75 THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM (SELECT p_partkey, ['easy', 'hard'][(p_partkey % 2 + 1)::INT] AS h FROM part) GROUP BY 1, 2")
def s12_difficulty_split(spark, sf):
    rows = corpora.difficulty_split(parts(spark, sf).select(F.col("id").alias("example_id"), pick(["easy", "hard"]).alias("hardness")), {"train": 3, "test": 1})
    return rows.groupBy("hardness", "split").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS split, CASE WHEN event_type = 'view' THEN 1 ELSE count(*) END AS expected, count(*) AS found, event_type <> 'view' OR count(*) = 1 AS ok FROM events GROUP BY 1 UNION ALL SELECT 'none', 3, 0, false")
def o06_verified_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("split"))
    expected = e.groupBy("split").agg(F.count(F.lit(1)).alias("n")).select("split", F.when(F.col("split") == "view", 1).otherwise(F.col("n")).cast("long").alias("expected"))
    return corpora.verified_counts(e, expected.unionByName(spark.createDataFrame([("none", 3)], "split string, expected long")))


@query("SELECT p_partkey AS line, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name END AS sql FROM part")
def o20_predictions(spark, sf):
    value = F.when(F.col("id") % 4 == 0, "  ").otherwise(F.concat_ws("\t", "p_name", "p_brand"))
    return corpora.predictions(parts(spark, sf).select(F.col("id").alias("line"), value.alias("value")))


@query("SELECT p_brand AS db_id, 'a,b' AS headers, p_name AS gold_sql, p_type AS pred_sql FROM part ORDER BY p_partkey LIMIT 1")
def o20_first_pair(spark, sf):
    p = parts(spark, sf)
    gold, pred = p.select(F.col("id").alias("line"), F.col("p_brand").alias("db_id"), F.col("p_name").alias("sql")), p.select(F.col("id").alias("line"), F.col("p_type").alias("sql"))
    headers = p.select(F.col("p_brand").alias("db_id"), F.array(F.lit("a"), F.lit("b")).alias("headers")).distinct()
    return corpora.first_pair(gold, pred, headers).select("db_id", F.array_join("headers", ",").alias("headers"), "gold_sql", "pred_sql")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'SELECT a FROM t' ELSE 'SELECT ' || p_name || ' FROM ' END AS sql FROM part")
def o13_prefilled(spark, sf):
    sql = F.when(F.col("id") % 2 == 0, "SELECT a FROM t").otherwise(F.concat(F.lit("SELECT "), "p_name", F.lit("  ")))
    return parts(spark, sf).select("id", corpora.prefilled(sql).alias("sql"))
