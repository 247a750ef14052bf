"""Statements with SQLite's meaning, run on Spark, beside DuckDB SQL that says each meaning outright."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sqlite
from ..operators import execute
from .registry import query, table

#: For each statement, how many columns it gives, and the same said in DuckDB's dialect.
STATEMENTS = (
    # whole-number division, also of what was divided before; by zero; in an aggregate's argument
    ("SELECT p_partkey, p_size / 2, p_size / 7 / 2 FROM part", 3, "SELECT p_partkey, p_size // 2, p_size // 7 // 2 FROM part"),
    ("SELECT p_partkey, 10 / (p_size - 25), p_size % (p_size - 25) FROM part", 3, "SELECT p_partkey, 10 // nullif(p_size - 25, 0), p_size % nullif(p_size - 25, 0) FROM part"),
    ("SELECT sum(p_size / 10), sum(p_size) / count(*), sum(p_size) * 1.0 / 4 FROM part", 3, "SELECT sum(p_size // 10), sum(p_size) // count(*), sum(p_size)::DOUBLE / 4 FROM part"),
    ("SELECT p_brand, max(p_size) / min(p_size) FROM part GROUP BY p_brand", 2, "SELECT p_brand, max(p_size) // min(p_size) FROM part GROUP BY p_brand"),
    ("SELECT -7 / 2, -7 % 3, 7 / 2.0, 5 / 0, 5.0 / 0", 5, "SELECT -3, -1, 3.5, NULL, NULL"),
    # LIKE knows no case, NOT LIKE neither; no character escapes without ESCAPE
    ("SELECT p_partkey FROM part WHERE p_name LIKE '%WIDGET'", 1, "SELECT p_partkey FROM part WHERE p_name ILIKE '%WIDGET'"),
    ("SELECT count(*) FROM part WHERE p_name NOT LIKE 'B_UE%' AND p_brand like 'BRAND#1%'", 1, "SELECT count(*) FROM part WHERE NOT p_name ILIKE 'B_UE%' AND p_brand ILIKE 'BRAND#1%'"),
    ("SELECT count(*) FROM part WHERE p_size LIKE '1_' OR 'a\\b' LIKE 'A\\B' AND p_size = 2", 1, "SELECT count(*) FROM part WHERE p_size BETWEEN 10 AND 19 OR p_size = 2"),
    # columns beside GROUP BY: of the row with the greatest or least value, if that is asked for
    ("SELECT p_brand, p_name, p_partkey, max(p_partkey) FROM part GROUP BY p_brand", 4, "SELECT p_brand, arg_max(p_name, p_partkey), max(p_partkey), max(p_partkey) FROM part GROUP BY p_brand"),
    ("SELECT p_name, p_partkey FROM part GROUP BY p_brand HAVING min(p_partkey) >= 0", 2, "SELECT arg_min(p_name, p_partkey), min(p_partkey) FROM part GROUP BY p_brand"),
    ("SELECT r_name, n_name, min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey", 3, "SELECT any_value(r_name), arg_min(n_name, n_nationkey), min(n_nationkey) FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey"),
    ("SELECT c_name, max(c_custkey) FROM customer", 2, "SELECT arg_max(c_name, c_custkey), max(c_custkey) FROM customer"),
    ("SELECT p_brand AS b, count(*) FROM part GROUP BY b ORDER BY count(*) DESC, b LIMIT 3", 2, "SELECT p_brand, count(*) FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    # affinity: a column of numbers makes numbers of text, one of text makes text of numbers; else numbers come first
    ("SELECT count(*) FROM part WHERE p_size = '25'", 1, "SELECT count(*) FROM part WHERE p_size = 25"),
    ("SELECT count(*), sum(p_size) FROM part WHERE p_size < 'abc'", 2, "SELECT count(*), sum(p_size) FROM part"),
    ("SELECT count(*) FROM part WHERE p_size > 'abc' OR p_name > 3", 1, "SELECT count(*) FROM part WHERE p_name > '3'"),
    ("SELECT count(*) FROM orders WHERE o_orderpriority < 4", 1, "SELECT count(*) FROM orders WHERE o_orderpriority < '4'"),
    ("SELECT count(*) FROM part WHERE p_size IN ('1', '2', 3, 'x')", 1, "SELECT count(*) FROM part WHERE p_size IN (1, 2, 3)"),
    ("SELECT count(*) FROM part WHERE p_size BETWEEN '10' AND '20'", 1, "SELECT count(*) FROM part WHERE p_size BETWEEN 10 AND 20"),
    ("SELECT 5 < 'abc', 5 = '5', count(*) > '0' FROM part", 3, "SELECT 1, 0, 0 FROM part LIMIT 1"),
    # text in arithmetic is the number that it begins with
    ("SELECT o_orderkey, o_orderpriority + 1, o_orderpriority * 2 FROM orders", 3, "SELECT o_orderkey, o_orderpriority[1]::INT + 1, o_orderpriority[1]::INT * 2 FROM orders"),
    ("SELECT sum(o_orderpriority), avg(p) FROM orders, (SELECT 'x' AS p)", 2, "SELECT sum(o_orderpriority[1]::INT), 0 FROM orders"),
    # conditions are numbers, numbers conditions
    ("SELECT p_size > 25, p_size > 25 AND p_size < 30, NOT p_size FROM part", 3, "SELECT (p_size > 25)::INT, (p_size > 25 AND p_size < 30)::INT, (p_size = 0)::INT FROM part"),
    ("SELECT sum(p_size > 25), sum(p_name LIKE 'b%') FROM part WHERE p_size - 1", 2, "SELECT sum((p_size > 25)::INT), sum((p_name ILIKE 'b%')::INT) FROM part WHERE p_size <> 1"),
    # set operations from left to right
    ("SELECT n_nationkey FROM nation UNION SELECT 100 INTERSECT SELECT r_regionkey FROM region", 1, "(SELECT n_nationkey FROM nation UNION SELECT 100) INTERSECT SELECT r_regionkey FROM region"),
    ("SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region UNION SELECT 1 ORDER BY 1 DESC LIMIT 2, 3", 1, "SELECT * FROM ((SELECT n_nationkey FROM nation EXCEPT SELECT r_regionkey FROM region) UNION SELECT 1) t(k) ORDER BY k DESC LIMIT 3 OFFSET 2"),
    # double quotes: a column if there is one, else a string; dates are text
    ('SELECT "p_partkey", "nothing" FROM part WHERE "p_brand" = "Brand#1"', 2, "SELECT p_partkey, 'nothing' FROM part WHERE p_brand = 'Brand#1'"),
    ("SELECT strftime('%Y', o_orderdate), count(*) FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate LIKE '%-01-%' GROUP BY strftime('%Y', o_orderdate)", 2, "SELECT year(o_orderdate)::VARCHAR, count(*) FROM orders WHERE o_orderdate >= '1997-01-01' AND month(o_orderdate) = 1 GROUP BY 1"),
    # nulls first, IS between values, nested queries and CASE
    ("SELECT c_custkey, o_orderkey IS NULL, o_orderkey IS c_custkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey < 100", 3, "SELECT c_custkey, (o_orderkey IS NULL)::INT, (o_orderkey IS NOT DISTINCT FROM c_custkey)::INT FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey < 100"),
    ("SELECT n_name, CASE WHEN n_regionkey THEN n_regionkey / 2 ELSE 'none' END FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey <= n_nationkey / 3) AND EXISTS (SELECT * FROM customer WHERE c_nationkey = n_nationkey)", 2, "SELECT n_name, CASE WHEN n_regionkey <> 0 THEN (n_regionkey // 2)::VARCHAR ELSE 'none' END FROM nation WHERE n_regionkey <= n_nationkey // 3 AND n_regionkey <= 4 AND n_nationkey IN (SELECT c_nationkey FROM customer)"),
    ("SELECT min(p_size, 10), max(p_size, NULL), ifnull(NULL, p_brand) || '/' || p_size FROM part", 3, "SELECT least(p_size, 10), NULL, p_brand || '/' || p_size FROM part"),
    ("WITH big AS (SELECT p_brand AS b, avg(p_size) AS mean FROM part GROUP BY p_brand) SELECT count(*) FROM big AS x JOIN part AS y ON x.b = y.p_brand WHERE y.p_size > x.mean", 1, "SELECT count(*) FROM (SELECT p_size, avg(p_size) OVER (PARTITION BY p_brand) AS m FROM part) WHERE p_size > m"),
)


def _shown(c: str) -> str:
    """A DuckDB cell as results are compared."""
    number = f"round(try_cast({c}::VARCHAR AS DOUBLE), 10)"
    return f"CASE WHEN {c} IS NULL THEN '∅' WHEN {number} IS NULL THEN 's:' || trim({c}::VARCHAR) WHEN {number} = floor({number}) THEN 'n:' || {number}::BIGINT ELSE 'n:' || {number} END"


def _oracle() -> str:
    parts = []
    for k, (_, width, sql) in enumerate(STATEMENTS):
        names = [f"c{i}" for i in range(width)]
        parts.append(f"SELECT {k}::BIGINT AS id, {' || chr(124) || '.join(map(_shown, names))} AS row FROM ({sql}) AS t({', '.join(names)})")
    return f"SELECT id, row, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


@query(_oracle())
def x09_sqlite_meaning(spark, sf):
    for name in "region nation customer part orders".split():
        table(spark, sf, name).createOrReplaceTempView(name)
    statements = [(k, 1, sql) for k, (sql, *_) in enumerate(STATEMENTS)]
    rows, outcomes = execute.run_statements(spark, statements, sqlite.translator(spark))
    failed = outcomes.filter(F.col("status") != "result").select(F.col("query_id").alias("id"), F.col("error").alias("row"))
    return rows.select(F.col("query_id").alias("id"), F.array_join("cells", "|").alias("row")).unionByName(failed).groupBy("id", "row").agg(F.count(F.lit(1)).alias("n"))
