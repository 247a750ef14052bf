"""Queries on SQL text. The tables hold none, so both engines make the same statements from columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parser, prompts, quotes, semantic, sqltext, statements
from ..operators import grading, singletable
from ..sources import corpora
from .registry import query, spread, table


def made(spark, sf, *parts, name: str = "part", key: str = "p_partkey"):
    """Rows (id, sql): text parts and columns put together."""
    cols = [F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts]
    return table(spark, sf, name).select(F.col(key).alias("id"), F.concat(*cols).alias("sql"))


@query("SELECT p_partkey AS id, 'select p_name , COUNT ( * ) from part as t1 join supplier as t2 on t1.p_partkey = t2.s_suppkey where t1.p_brand = ''' || lower(p_brand) || ''' and p_size = ' || p_size || ' group by p_name' AS out FROM part")
def n01_canonical(spark, sf):
    df = made(spark, sf, "SELECT  p_name, count(*) \n FROM part AS t1 INNER  JOIN supplier AS t2 ON T1.p_partkey=t2.S_SUPPKEY WHERE t1.p_brand='", "$p_brand", "' AND p_size = '", "$p_size", "' GROUP BY p_name ;")
    return df.select("id", quotes.canonical(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT COUNT ( * ), COUNT ( * ) FROM ' || replace(p_name, ' ', '_') AS out FROM part")
def n02_fold_count(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("SELECT COUNT(DISTINCT x), count ( y ) FROM "), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("sql"))
    return df.select("id", sqltext.fold_count(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'select a from t where b = ''o''''' || p_brand || ''' and c = ''x''' AS out FROM part")
def n03_apostrophes(spark, sf):
    df = made(spark, sf, "select a from t where b = 'o'", "$p_brand", "' and c = 'x'")
    return df.select("id", quotes.repair_apostrophes(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT A FROM T WHERE B = ''' || lower(p_type) || ''' AND C = \"' || lower(p_brand) || '\"' AS out FROM part")
def n04_lower_literals(spark, sf):
    df = made(spark, sf, "SELECT A FROM T WHERE B = '", "$p_type", "' AND C = \"", "$p_brand", '"')
    return df.select("id", quotes.lower_string_literals(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'select MAX ( x ) from t inner join u on t.A = u.b where s = ''' || p_brand || '''' AS out FROM part")
def n05_older_form(spark, sf):
    df = made(spark, sf, "SELECT  max(x) FROM t INNER JOIN u ON t.A=u.b WHERE s='", "$p_brand", "';")
    return df.select("id", sqltext.older_form(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT a FROM t WHERE b = ''' || p_brand || ''' AND v = ''1.2.3'' AND d not in (SELECT 1)' AS out FROM part")
def n06_null_form(spark, sf):
    df = made(spark, sf, "SELECT a FROM t WHERE c IS NOT NULL AND b = \"", "$p_brand", "\" AND t.x is null AND v = 1.2.3 AND d NOT  IN (SELECT 1)")
    return df.select("id", quotes.repair_prediction(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT a FROM t WHERE b != ' || p_size AS out FROM part")
def n07_single_table_form(spark, sf):
    df = made(spark, sf, "SELECT a FROM t  WHERE b <> ", "$p_size", " AND lower(c) = 'x' AND d IS NULL")
    return spread(spark, df).select("id", statements.single_table_form(F.col("sql")).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT first_name FROM t WHERE last_name = ''a__b'' AND z__z = ' || p_size AS out FROM part")
def n08_underscores(spark, sf):
    df = made(spark, sf, "SELECT first__name FROM t WHERE last_name_ = 'a__b' AND z__z = ", "$p_size")
    known = F.array(F.lit("first_name"), F.lit("last_name"))
    return df.select("id", sqltext.collapse_underscores(F.col("sql"), known).alias("out"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'SELECT MAX(pick) FROM wikisql_data WHERE c = ''' || p_brand || '''' WHEN p_partkey % 3 = 1 THEN 'SELECT MIN(pick) FROM wikisql_data' ELSE 'SELECT MAX(pick) FROM wikisql_data' END AS out FROM part")
def n09_top1_to_max(spark, sf):
    k = F.col("p_partkey") % 3
    sql = F.when(k == 0, F.concat(F.lit("SELECT pick FROM `table` WHERE c = '"), "p_brand", F.lit("' ORDER BY x DESC LIMIT 1"))).when(k == 1, F.lit("SELECT pick FROM table ORDER BY pick ASC LIMIT 1")).otherwise(F.lit("SELECT SUM(pick) FROM table"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), statements.repair_single_table(sql).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT MAX(size) FROM wikisql_data WHERE brand = ''' || p_brand || ''' AND col9 = 1 AND name = 2' AS out FROM part")
def n11_gold_columns(spark, sf):
    df = made(spark, sf, "SELECT MAX(col2) FROM table WHERE col1 = ''", "$p_brand", "'' AND col9 = 1 AND col = 2")
    return df.select("id", sqltext.gold_columns(F.col("sql"), F.array(F.lit("name"), F.lit("brand"), F.lit("size"))).alias("out"))


@query("SELECT p_partkey AS id, 'SELECT a FROM t WHERE b = ''' || p_brand || '''' AS out FROM part")
def n12_quoted(spark, sf):
    df = made(spark, sf, 'SELECT "a" FROM "t" WHERE b = \'\'', "$p_brand", "''")
    return df.select("id", sqltext.strip_quoted_identifiers(sqltext.strip_doubled_quotes(F.col("sql"))).alias("out"))


@query("SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'SELECT a FROM t WHERE s = ' || p_size WHEN 1 THEN 'SELECT b FROM t' ELSE 'SELECT c FROM t' END AS out FROM part")
def n13_extract(spark, sf):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.lit("Here it is:\n```sql\nSELECT a FROM t\n WHERE s = "), F.col("p_size").cast("string"), F.lit(";\n```\nDone."))).when(k == 1, F.lit("Final SQL: SELECT b FROM `t`\n\nThis works.")).otherwise(F.lit("SELECT x FROM u\nthen\nSELECT c FROM t"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), statements.extract_sql(text).alias("out"))


@query("SELECT p_partkey AS id, p_partkey % 3 <> 2 AS valid, p_partkey % 3 = 0 AS complete FROM part")
def n14_validity(spark, sf):
    k = F.col("p_partkey") % 3
    sql = F.when(k == 0, F.lit("select a from t")).when(k == 1, F.lit(" WITH x AS (y)")).otherwise(F.lit("a from t"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), sqltext.is_valid(sql).alias("valid"), sqltext.is_complete(sql).alias("complete"))


@query("SELECT p_partkey AS id, 'SELECT name FROM t WHERE x >= ' || p_size || ' AND y <= 2020' AS out FROM part")
def n15_postprocess(spark, sf):
    df = made(spark, sf, "SELECT DISTINCT name FROM t WHERE x > = ", "$p_size", " AND y < = YEAR(CURDATE())")
    return df.select("id", sqltext.fix_year(sqltext.drop_distinct(sqltext.join_operators(F.col("sql")))).alias("out"))


@query("SELECT regexp_replace(regexp_replace('SELECT a FROM t WHERE b = ''' || p_brand || ''' AND c > ' || p_size || '.5', '''[^'']*''', '_', 'g'), '\\b\\d+(\\.\\d+)?\\b', '_', 'g') AS out, count(*) AS n FROM part GROUP BY 1")
def n16_skeleton(spark, sf):
    df = made(spark, sf, "SELECT a FROM t WHERE b = '", "$p_brand", "' AND c > ", "$p_size", ".5")
    return df.groupBy(sqltext.skeleton(F.col("sql")).alias("out")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey AS id, 'select t1 . a from t where b = VALUERARE and c = VALUERARE' AS tokens, '''' || p_brand || ''',' || p_size AS vals, 4::BIGINT AS ways FROM part")
def n17_n18_values(spark, sf):
    df = made(spark, sf, "SELECT T1.a FROM t WHERE b = '", "$p_brand", "' AND c = ", "$p_size").withColumn("s", sqltext.strip_values(F.col("sql")))
    ways = F.size(sqltext.plug_values(F.col("s.tokens"), F.col("s.values"))).cast("long")
    return df.select("id", F.array_join("s.tokens", " ").alias("tokens"), F.array_join("s.values", ",").alias("vals"), ways.alias("ways"))


@query("SELECT p_partkey AS id, p_brand AS db, 'SELECT 1 FROM t' AS clean FROM part")
def n19_suffix(spark, sf):
    df = made(spark, sf, "How many? [", "$p_brand", "]")
    return df.select("id", sqltext.database_suffix(F.col("sql")).alias("db"), F.trim(sqltext.strip_markdown(F.lit("```sql\nSELECT 1 FROM `t```"))).alias("clean"))


@query("SELECT p_partkey AS id, 'SELECT COUNT(*), COUNT(DISTINCT ' || replace(p_name, ' ', '_') || ') FROM a LEFT JOIN b JOIN c' AS out FROM part")
def n20_n21_generator(spark, sf):
    df = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("SELECT COUNT(x), COUNT(DISTINCT "), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(") FROM a LEFT OUTER JOIN b INNER JOIN c")).alias("sql"))
    return df.select("id", sqltext.join_spelling_kept(sqltext.count_star(F.col("sql"))).alias("out"))


@query("SELECT p_partkey AS id, 'part,supplier' AS tables, 'p_name,p_size' AS columns FROM part")
def n23_names(spark, sf):
    df = made(spark, sf, "SELECT t1.p_name, MAX(t1.p_size) AS m, p_name FROM part AS t1 JOIN supplier ON p_size = ", "$p_size")
    return df.select("id", F.array_join(sqltext.tables_in(F.col("sql")), ",").alias("tables"), F.array_join(sqltext.columns_in(F.col("sql")), ",").alias("columns"))


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) <= 8 THEN p_name ELSE substr(p_name, 1, 5) || '...' END AS short, p_brand AS sql, p_type AS db_id FROM part")
def n27_text_helpers(spark, sf):
    p = table(spark, sf, "part")
    pair = sqltext.tsv_pair(F.concat_ws("\t", "p_brand", "p_type"))
    return p.select(F.col("p_partkey").alias("id"), sqltext.truncate(F.col("p_name"), 8).alias("short"), pair["sql"].alias("sql"), pair["db_id"].alias("db_id"))


CATALOG = '{"part": ["p_partkey", "p_name", "p_brand", "p_size"], "supplier": ["s_suppkey", "s_name"]}'
STATEMENTS = (  # gold statements of the four levels; each has its own prediction
    "SELECT count(*) FROM part",
    "SELECT p_name, p_brand FROM part WHERE p_size > {n} GROUP BY p_name",
    "SELECT p_name FROM part WHERE p_size > (SELECT avg(p_size) FROM part) AND p_brand = '{b}' LIMIT 1",
    "SELECT t1.p_name, count(*) FROM part AS t1 JOIN supplier AS t2 ON t1.p_partkey = t2.s_suppkey WHERE t1.p_size > {n} OR t2.s_name LIKE 'S%' GROUP BY t1.p_name ORDER BY count(*) DESC LIMIT 3",
)


def _pairs(spark, sf):
    """Rows (id, gold_sql, pred_sql): every fifth prediction has another column, every seventh does not parse, every eleventh is a placeholder."""
    p = table(spark, sf, "part")
    sql = F.element_at(F.array(*map(F.lit, STATEMENTS)), (F.col("p_partkey") % 4 + 1).cast("int"))
    sql = F.replace(F.replace(sql, F.lit("{n}"), F.col("p_size").cast("string")), F.lit("{b}"), F.col("p_brand"))
    k = F.col("p_partkey")
    pred = F.when(k % 11 == 0, "SELECT 1").when(k % 7 == 0, F.concat(sql, F.lit(", nothing FROM"))).when(k % 5 == 0, F.replace(sql, F.lit("SELECT"), F.lit("SELECT p_size,"))).otherwise(F.lower(sql))
    return p.select(k.alias("id"), sql.alias("gold_sql"), pred.alias("pred_sql"))


def graded(spark, sf):
    rows = _pairs(spark, sf).withColumn("catalog", F.lit(CATALOG)).withColumn("gold_sql", F.lower("gold_sql"))
    rows = parser.parse_statements(rows, "gold_sql", "catalog", "gold")
    return grading.grade_turns(parser.parse_statements(rows, "pred_sql", "catalog", "pred"))


@query("SELECT p_partkey AS id, ['easy', 'hard', 'extra', 'extra'][(p_partkey % 4 + 1)::INT] AS hardness, [0, 0, 1, 0][(p_partkey % 4 + 1)::INT]::BIGINT AS nested, [0, 1, 2, 2][(p_partkey % 4 + 1)::INT]::BIGINT AS conditions FROM part")
def p04_m15_parse_hardness(spark, sf):
    rows = parser.parse_statements(_pairs(spark, sf).withColumn("catalog", F.lit(CATALOG)), "gold_sql", "catalog", "gold")
    n = F.size("gold.where_conds")
    return rows.select("id", grading.hardness_of(F.col("gold")).alias("hardness"), F.col("gold.n_nested").cast("long").alias("nested"), n.cast("long").alias("conditions"))


@query("SELECT p_partkey AS id, p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 AS exact_match FROM part")
def m17_grade_turns(spark, sf):
    # brands are literals: lower-cased gold and prediction agree
    return graded(spark, sf).select("id", "exact_match")


@query("""SELECT level, count(*) AS count, round(avg(e), 6) AS exact FROM (SELECT unnest([h, 'all']) AS level, e FROM (
    SELECT CASE WHEN p_partkey % 11 = 0 THEN 'unknown' ELSE 'parsed' END AS h, CASE WHEN p_partkey % 11 <> 0 AND p_partkey % 7 <> 0 AND p_partkey % 5 <> 0 THEN 1.0 ELSE 0.0 END AS e FROM part)) GROUP BY level""")
def m18_score_table(spark, sf):
    rows = graded(spark, sf).withColumn("h", F.when(F.col("hardness") == "unknown", "unknown").otherwise("parsed"))
    return grading.score_table(rows, "h", exact="exact_match")


@query()
def m19_component_table(spark, sf):
    return grading.component_table(graded(spark, sf))


@query("SELECT p_partkey AS id, 4::BIGINT AS n_tokens, 'select \"' || p_brand || '\" from t.c' AS joined FROM part")
def p01_tokens(spark, sf):
    from ..shipping import ship

    ship(spark)
    df = made(spark, sf, "SELECT '", "$p_brand", "' FROM T . C")
    toks = parser.lexed(F.col("sql"))
    return df.select("id", F.size(toks).cast("long").alias("n_tokens"), F.array_join(toks, " ").alias("joined"))


@query("SELECT p_partkey AS id, unnest(CASE WHEN p_partkey % 4 = 2 THEN ['root', 'where'] ELSE ['root'] END) AS role FROM part")
def d11_node_rows(spark, sf):
    rows = parser.parse_statements(_pairs(spark, sf).withColumn("catalog", F.lit(CATALOG)), "gold_sql", "catalog", "gold")
    return parser.node_rows(rows.select("id", F.col("gold.tree").alias("tree")), "id", "tree").select("id", "role")


@query("SELECT p_partkey AS id, ['easy', 'easy', 'medium', 'hard'][(p_partkey % 4 + 1)::INT] AS level FROM part")
def m16_simple_difficulty(spark, sf):
    sqls = ("SELECT a FROM t", "SELECT a FROM t WHERE b = 1", "SELECT COUNT(a) FROM t WHERE b = 1 AND c = 2", "SELECT COUNT(a) FROM t WHERE b = 1 AND c = 2 OR d = 3")
    sql = F.element_at(F.array(*map(F.lit, sqls)), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), grading.simple_difficulty(sql).alias("level"))


# ---- single-table gold -------------------------------------------------------------------

HEADERS = ("Part Name", "Brand", "Size (cm)", "School/Club Team")


def _headers():
    return F.array(*map(F.lit, HEADERS))


@query("SELECT p_partkey AS id, 'SELECT MAX(col2) FROM table WHERE col1 = ''' || p_brand || ''' AND col2 > ' || p_size AS sql FROM part")
def s07_render_gold(spark, sf):
    # text is quoted, numbers are not
    cond = lambda c, o, v, text: F.struct(F.lit(c).alias("col"), F.lit(o).alias("op"), v.alias("val"), F.lit(text).alias("is_text"))
    conds = F.array(cond(1, 0, F.col("p_brand"), True), cond(2, 1, F.col("p_size").cast("string"), False))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), corpora.render_gold(F.lit(1), F.lit(2), conds).alias("sql"))


@query("SELECT p_partkey AS id, 1::BIGINT AS agg, 2::BIGINT AS sel, 1::BIGINT AS col, 0::BIGINT AS op, lower(p_brand) AS val, 2::BIGINT AS n FROM part")
def p09_parse_single(spark, sf):
    df = made(spark, sf, "SELECT MAX(size cm) FROM t WHERE brand = '", "$p_brand", "' AND school_club_team > ", "$p_size", " AND nothing = 3")
    x = df.select("id", singletable.parse_single(F.col("sql"), _headers()).alias("p"))
    c = F.col("p.conds")[0]
    return x.select("id", F.col("p.agg").cast("long").alias("agg"), F.col("p.sel").cast("long").alias("sel"), c["col"].cast("long").alias("col"), c["op"].cast("long").alias("op"), c["val"]["str"].alias("val"), F.size("p.conds").cast("long").alias("n"))


@query("SELECT p_partkey AS id, [0, 1, 2, 3, 2, NULL][(p_partkey % 6 + 1)::INT]::BIGINT AS idx FROM part")
def e01_resolve_column(spark, sf):
    names = ("part_name", "MAX(Brand)", "size", "school club", "col2", "col9")
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), singletable.resolve_column(name, _headers()).cast("long").alias("idx"))


@query("SELECT p_partkey AS id, regexp_replace(lower(p_brand), '#', ' ') AS norm FROM part")
def e02_column_name(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), singletable.column_name(F.col("p_brand")).alias("norm"))


@query("""SELECT p_partkey AS id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard
    FROM (SELECT p_partkey, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type || ' widget'), ' ')) AS b FROM part)""")
def e03_jaccard(spark, sf):
    from ..functions.arrays import jaccard

    a, b = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat("p_type", F.lit(" widget"))), " ")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.round(jaccard(a, b), 6).alias("jaccard"))


@query("SELECT p_partkey AS id, [NULL, 22.77, 30262610, NULL, -5, 12][(p_partkey % 6 + 1)::INT]::DOUBLE AS num, ['1999-03-04', NULL, NULL, 'beatles', NULL, NULL][(p_partkey % 6 + 1)::INT] AS str FROM part")
def e05_e06_e07_value(spark, sf):
    raw = ("March 4, 1999", "22,77", "30,262,610", 'The "Beatles"', "−5", " 12% ")
    v = singletable.value(F.regexp_replace(F.element_at(F.array(*map(F.lit, raw)), (F.col("p_partkey") % 6 + 1).cast("int")), '"', ""))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), v["num"].alias("num"), v["str"].alias("str"))


@query("SELECT p_partkey AS id, p_partkey % 4 <> 3 AS relaxed, p_partkey % 4 IN (0, 2) AS strict FROM part")
def e08_e09_values_match(spark, sf):
    a = ("manchester united", "man", "1,200", "x")
    b = ("manchester unite", "manchester", "1200", "y")
    pick = lambda t: F.element_at(F.array(*map(F.lit, t)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = spread(spark, table(spark, sf, "part")).select(F.col("p_partkey").alias("id"), singletable.value(pick(a)).alias("x"), singletable.value(pick(b)).alias("y"))
    x, y = F.col("x"), F.col("y")
    return rows.select("id", singletable.values_match(x, y).alias("relaxed"), singletable.values_match_strict(x, y).alias("strict"))


def _structural(spark, sf):
    """Gold MAX(size) with two conditions; predictions in another order, with another operator, value, column, or short of one."""
    k = F.col("p_partkey") % 5
    gold = F.concat(F.lit("SELECT MAX(col2) FROM t WHERE col1 = '"), "p_brand", F.lit("' AND col2 > "), F.col("p_size").cast("string"))
    pred = (
        F.when(k == 0, F.concat(F.lit("SELECT MAX(size) FROM t WHERE size > "), F.col("p_size").cast("string"), F.lit(" AND brand = '"), "p_brand", F.lit("'")))
        .when(k == 1, F.concat(F.lit("SELECT size FROM t WHERE brand = '"), "p_brand", F.lit("' AND size > "), F.col("p_size").cast("string")))
        .when(k == 2, F.concat(F.lit("SELECT MIN(size) FROM t WHERE brand = '"), "p_brand", F.lit("' AND size > "), F.col("p_size").cast("string")))
        .when(k == 3, F.concat(F.lit("SELECT MAX(brand) FROM t WHERE brand = 'none' AND size > "), F.col("p_size").cast("string")))
        .otherwise(F.lit("SELECT MAX(nothing) FROM t WHERE brand = 'x'"))
    )
    h = F.array(F.lit("Part Name"), F.lit("Brand"), F.lit("Size"))
    rows = spread(spark, table(spark, sf, "part")).select(F.col("p_partkey").alias("id"), singletable.parse_single(gold, h).alias("gold"), singletable.parse_single(pred, h).alias("pred"), h.alias("headers"))
    rows = rows.withColumn("s", singletable.structural(F.col("pred"), F.col("gold")))
    ok = lambda c: F.coalesce(F.col(f"s.{c}"), F.lit(False)).alias(c)
    return rows.select("id", "pred", "gold", "headers", F.col("gold").isNotNull().alias("gold_ok"), F.col("pred").isNotNull().alias("pred_ok"), ok("agg_ok"), ok("sel_ok"), ok("cond_ok"), ok("em"))


@query("SELECT p_partkey AS id, p_partkey % 5 IN (0, 1) AS em, ['ok', 'ok', 'agg', 'sel+cond', 'parse'][(p_partkey % 5 + 1)::INT] AS category FROM part")
def e11_structural_match(spark, sf):
    rows = _structural(spark, sf)
    cat = singletable.failure_category(F.col("gold_ok"), F.col("pred_ok"), F.col("agg_ok"), F.col("sel_ok"), F.col("cond_ok"))
    return rows.select("id", "em", cat.alias("category"))


@query("""SELECT count(*) AS total, sum(CASE WHEN k = 4 THEN 1 ELSE 0 END)::BIGINT AS parse_failures, round(avg(CASE WHEN k < 4 THEN 1.0 ELSE 0 END), 6) AS parse_rate,
    round(sum(CASE WHEN k IN (0, 1, 3) THEN 1.0 ELSE 0 END) / sum(CASE WHEN k < 4 THEN 1 ELSE 0 END), 6) AS agg_accuracy, round(sum(CASE WHEN k IN (0, 1, 2) THEN 1.0 ELSE 0 END) / sum(CASE WHEN k < 4 THEN 1 ELSE 0 END), 6) AS sel_accuracy,
    round(sum(CASE WHEN k IN (0, 1, 2) THEN 1.0 ELSE 0 END) / sum(CASE WHEN k < 4 THEN 1 ELSE 0 END), 6) AS cond_accuracy, round(avg(CASE WHEN k < 2 THEN 1.0 ELSE 0 END), 6) AS em FROM (SELECT p_partkey % 5 AS k FROM part)""")
def e13_accuracy(spark, sf):
    return singletable.accuracy(_structural(spark, sf))


@query("SELECT p_partkey AS id, 'wrong_val(Brand) | op_mismatch(Size)' AS reason FROM part WHERE p_partkey % 5 = 3")
def e15_condition_failure(spark, sf):
    # a row fails by the structural match's own verdict
    rows = _structural(spark, sf).filter("gold_ok AND pred_ok AND NOT cond_ok")
    return rows.select("id", singletable.condition_failure(F.col("pred.conds"), F.col("gold.conds"), F.col("headers")).alias("reason"))


@query("""SELECT category, count(*) AS count, round(100 * count(*) / sum(count(*)) OVER (), 4) AS pct_total, CASE WHEN category <> 'ok' THEN round(100 * count(*) / sum(CASE WHEN category <> 'ok' THEN count(*) END) OVER (), 4) END AS pct_failures
    FROM (SELECT ['ok', 'ok', 'agg', 'sel+cond', 'parse'][(p_partkey % 5 + 1)::INT] AS category FROM part) GROUP BY category""")
def e16_failure_report(spark, sf):
    return singletable.failure_report(e11_structural_match(spark, sf))


@query("SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY id)::BIGINT AS rank FROM (SELECT p_partkey AS id, ['ok', 'ok', 'agg', 'sel+cond', 'parse'][(p_partkey % 5 + 1)::INT] AS category FROM part) QUALIFY rank <= 15")
def e16_failure_examples(spark, sf):
    return singletable.examples(e11_structural_match(spark, sf), "category", "id").select("category", "id", F.col("rank").cast("long").alias("rank"))


@query("""SELECT p_brand AS query_id, count(*) AS n_rows, round(max(p_retailprice), 6) AS result FROM part WHERE p_size > 25 GROUP BY p_brand""")
def run_single_table_batch(spark, sf):
    p = spread(spark, table(spark, sf, "part"))
    cells = p.select(F.lit("part").alias("db_id"), F.col("p_partkey").alias("row_id"), F.posexplode(F.array("p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"))).alias("col", "value"))
    queries = p.select(F.col("p_brand").alias("query_id")).distinct().withColumn("db_id", F.lit("part"))
    cond = lambda c, o, v: F.struct(F.lit(c).alias("col"), F.lit(o).alias("op"), singletable.value(v).alias("val"))
    queries = queries.select("query_id", "db_id", F.lit(1).alias("agg"), F.lit(2).alias("sel"), F.array(cond(0, 0, F.col("query_id")), cond(1, 1, F.lit("25"))).alias("conds"))
    return singletable.run_single(queries, cells).select("query_id", "n_rows", "result")


#: Conditions on size (column 1), brand (column 0) or price, as SQL and as (column, operator, value); the last finds nothing.
CONDITIONS = (
    ("p_size >= 25", (1, ">=", "25")), ("p_size <= 25", (1, "<=", "25")), ("p_size <> 25", (1, "!=", "25")), ("p_size > 25", (1, ">", "25")), ("p_size < 25", (1, "<", "25")), ("p_size = 25", (1, "=", "25")),
    ("p_brand <> 'Brand#11'", (0, "!=", "Brand#11")), ("p_brand ILIKE 'bRAND#1%'", (0, "like", "bRAND#1%")), ("p_brand NOT ILIKE '%3'", (0, "not like", "%3")), ("p_brand > 'Brand#3'", (0, ">", "Brand#3")), ("p_size > 1000", (1, ">", "1000")),
)
SINGLE = ("NULL", "max(p_retailprice)", "min(p_retailprice)", "count(*)", "sum(p_retailprice)", "avg(p_retailprice)")


@query(" UNION ALL ".join(
    f"SELECT {10 * k + a}::BIGINT AS query_id, count(*) AS n_rows, round({x}::DOUBLE, 6) AS result, {"coalesce(string_agg(p_retailprice::VARCHAR, ' ' ORDER BY p_retailprice::VARCHAR), '')" if not a else 'NULL::VARCHAR'} AS values FROM part WHERE {sql} AND p_partkey > 0"
    for k, (sql, _) in enumerate(CONDITIONS) for a, x in enumerate(SINGLE)))
def run_single_operators(spark, sf):
    # every operator with every aggregate, and a second condition that always holds
    p = spread(spark, table(spark, sf, "part"))
    cells = p.select(F.lit("part").alias("db_id"), F.col("p_partkey").alias("row_id"), F.posexplode(F.array("p_brand", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), F.col("p_partkey").cast("string"))).alias("col", "value"))
    asked = [(10 * k + a, "part", a, 2, [c, (3, ">", "0")]) for k, (_, c) in enumerate(CONDITIONS) for a in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, db_id string, agg int, sel int, conds array<struct<col:int,op:string,val:string>>")
    conds = F.transform("conds", lambda c: F.struct(c["col"].alias("col"), c["op"].alias("op"), singletable.value(c["val"]).alias("val"), c["val"].alias("text")))
    return singletable.run_single(queries.withColumn("conds", conds), cells).withColumn("values", F.array_join("values", " "))


# ---- questions ---------------------------------------------------------------------------


@query("""SELECT conv_id, turn, contains(lower(text), 'how many') OR contains(lower(text), 'count') OR contains(lower(text), 'number of') OR contains(lower(text), 'total') AS record_count,
    contains(lower(text), 'maximum') OR contains(lower(text), 'max') OR contains(lower(text), 'highest') OR contains(lower(text), 'largest') OR contains(lower(text), 'top') AS max_value FROM conversations""")
def l01_rule_match(spark, sf):
    m = semantic.matched(F.col("text"), semantic.METRICS)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.array_contains(m, "record_count"), F.lit(False)).alias("record_count"), F.coalesce(F.array_contains(m, "max_value"), F.lit(False)).alias("max_value"))


@query("SELECT doc_id, contains(lower(text), 'by') OR contains(lower(text), 'per') OR contains(lower(text), 'group') OR contains(lower(text), 'each') OR contains(lower(text), 'every') AS grouping, contains(lower(text), 'greater') OR contains(lower(text), 'less') OR contains(lower(text), 'more') OR contains(lower(text), 'fewer') OR contains(lower(text), 'above') OR contains(lower(text), 'below') AS comparison FROM documents")
def l03_intents(spark, sf):
    i = semantic.matched(F.col("text"), semantic.INTENTS)
    return table(spark, sf, "documents").select("doc_id", F.array_contains(i, "grouping").alias("grouping"), F.array_contains(i, "comparison").alias("comparison"))


#: Questions (p is a part's name) and what they give. Words that stand inside others ask for nothing.
ASKED = (
    ("How many size are there", "COUNT", "SELECT COUNT(p_size) FROM part"), ("highest size", "MAX", "SELECT MAX(p_size) FROM part"), ("the average of all", "AVG", "SELECT AVG(p_name) FROM part"),
    ("which p name is {p}", "NONE", "SELECT p_name FROM part WHERE p_name = '{p}'"), ("Who almost won in summer?", "NONE", "SELECT * FROM part"), ("Which p_size has a discounted {p} flag?", "NONE", "SELECT p_size FROM part"),
    ("What p size was '{p}', recounted?", "NONE", "SELECT p_size FROM part WHERE p_size = '{p}'"), ("the meaning of foremost totals", "NONE", "SELECT * FROM part"),
)


def _filled(k: str, texts, quote: str) -> str:
    """SQL for the text of number k, with a part's name, in lower case, in it."""
    lines = " ".join(f"WHEN {n} THEN replace('{t.replace(chr(39), quote)}', '{{p}}', lower(p))" for n, t in enumerate(texts))
    return f"CASE {k} {lines} END"


@query(f"WITH q AS (SELECT p_partkey AS id, p_name AS p FROM part) SELECT id, {_filled('id % 8', [h for _, h, _ in ASKED], chr(39) * 2)} AS hint, {_filled('id % 8', [s for *_, s in ASKED], chr(39) * 2)} AS sql FROM q")
def l11_l12_generator(spark, sf):
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("p"))
    q, cols = F.expr(_filled("id % 8", [t for t, *_ in ASKED], "\\'")), F.array(F.lit("p_name"), F.lit("p_size"))
    return asked.select("id", semantic.aggregate_hint(q).alias("hint"), semantic.generate(q, F.lit("part"), cols).alias("sql"))


@query("SELECT 'tpch' AS db_id, 'nation(n_nationkey, n_name, n_regionkey)' || chr(10) || 'region(r_regionkey, r_name)' AS schema")
def t03_schema_text(spark, sf):
    for n in ("nation", "region"):
        table(spark, sf, n).createOrReplaceTempView(n)
    return prompts.schema_text(corpora.introspect(spark, ["nation", "region"]).withColumn("db_id", F.lit("tpch")))


@query("SELECT p_partkey AS id, CASE WHEN length(p_name) <= 12 THEN 'ask' || chr(10) || chr(10) || p_name ELSE 'ask' END AS prompt FROM part")
def t02_budget(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), prompts.assemble(F.lit("ask"), F.array(F.col("p_name"), F.lit("x" * 80)), 4).alias("prompt"))
