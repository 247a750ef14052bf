"""Statements in SQLite's dialect, on Spark, against SQLite itself on the same rows."""

import random
import sqlite3
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sqlassay.functions import sqlite
from sqlassay.operators import evaluate, execute
from sqlassay.plans.dialects import STATEMENTS

TABLES = "region nation customer part orders".split()


def shown(v):
    """A cell as results are compared."""
    try:
        x = round(float(v), 10)
        return f"n:{x:.0f}" if x == int(x) else f"n:{x}"
    except (TypeError, ValueError):
        return "∅" if v is None else f"s:{v.strip()}"


@pytest.fixture(scope="module")
def lite(spark, small):
    con = sqlite3.connect(":memory:")
    for t in TABLES:
        df = spark.read.parquet(f"{small}/{t}.parquet")
        df.createOrReplaceTempView(t)
        kinds = [f"{n} {'INTEGER' if k in ('int', 'bigint') else 'REAL' if k == 'double' else 'TEXT'}" for n, k in df.dtypes]
        con.execute(f"CREATE TABLE {t} ({', '.join(kinds)})")
        rows = [tuple(r) for r in df.select(*[F.col(n).cast("string") if k.startswith(("date", "timestamp")) else F.col(n) for n, k in df.dtypes]).collect()]
        con.executemany(f"INSERT INTO {t} VALUES ({', '.join('?' * len(kinds))})", rows)
    # text that reads as a number, null and mixed text
    odd = [(1, "5", 2.5, None), (2, "5x", -1.5, "a"), (3, " 7 ", 0.0, "B"), (4, "abc", None, "b"), (None, None, 4.0, "A%"), (6, "", 3.0, "a_c"), (7, "1e2", 7.0, "abc"), (2, "10", 1.0, "ABC")]
    con.execute("CREATE TABLE odd (i INTEGER, t TEXT, r REAL, s TEXT)")
    con.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", odd)
    spark.createDataFrame(odd, "i int, t string, r double, s string").createOrReplaceTempView("odd")
    return con


def compare(spark, lite, statements):
    rows, outcomes = execute.run_statements(spark, [(k, 1, s) for k, s in enumerate(statements)], sqlite.translator(spark))
    bad = {r["query_id"]: r["error"] for r in outcomes.filter("status <> 'result'").collect()}
    assert not bad, {statements[k]: e for k, e in bad.items()}
    got = {k: Counter() for k in range(len(statements))}
    for r in rows.collect():
        got[r["query_id"]][tuple(r["cells"])] += 1
    for k, s in enumerate(statements):
        want = Counter(tuple(map(shown, r)) for r in lite.execute(s).fetchall())
        assert got[k] == want, (s, sqlite.translator(spark)(s))


def test_statements_of_the_query(spark, lite):
    compare(spark, lite, [s for s, *_ in STATEMENTS])


def test_odd_values(spark, lite):
    compare(spark, lite, [
        "SELECT i / 2, i % 2, -i / 2, i / r, t + 1, t * i, t / 2, 'x' || t || i FROM odd", "SELECT i FROM odd WHERE t = 5", "SELECT i FROM odd WHERE t > 4 AND NOT t IS NULL", "SELECT t FROM odd WHERE i < t", "SELECT t FROM odd WHERE r >= t OR i = t",
        "SELECT s FROM odd WHERE s LIKE 'a%'", "SELECT s FROM odd WHERE s LIKE 'A\\_C' ESCAPE '\\' OR s LIKE 'a#%' ESCAPE '#'", "SELECT s FROM odd WHERE s NOT LIKE '%b%'", "SELECT i, t FROM odd WHERE t", "SELECT i FROM odd WHERE NOT t", "SELECT i FROM odd WHERE r AND i",
        "SELECT sum(t), avg(t), total(i), count(t), min(t), max(t) FROM odd", "SELECT i IS 2, i IS NOT 2, i IS NULL, t NOTNULL FROM odd", "SELECT i FROM odd WHERE i IN ('2', '7', 'x')", "SELECT i FROM odd WHERE i NOT IN (2, '3')", "SELECT t FROM odd WHERE t IN (5, 10)",
        "SELECT i, max(r), s FROM odd", "SELECT s, min(i) FROM odd WHERE i > 2", "SELECT CASE i WHEN '2' THEN 'two' WHEN 3 THEN 3 END FROM odd", "SELECT CASE WHEN i > 2 THEN r ELSE i END FROM odd", "SELECT CAST(t AS INTEGER), CAST(r AS INTEGER), CAST(i AS TEXT), CAST(t AS REAL) FROM odd",
        "SELECT count(DISTINCT i), sum(DISTINCT i) FROM odd", "SELECT abs(i - 4), round(r), round(r / 3, 2), length(t), upper(s), substr(s, 1, 1) FROM odd", "SELECT i FROM odd ORDER BY i LIMIT 3", "SELECT i FROM odd ORDER BY i DESC LIMIT 3", "SELECT * FROM odd AS o WHERE o.i == 2",
        "SELECT a.i, b.i FROM odd a JOIN odd b ON a.i < b.i AND a.r <> b.r", "SELECT o.*, 1 FROM odd o LEFT JOIN nation ON n_nationkey = i WHERE n_name IS NULL", "SELECT (SELECT max(i) FROM odd) - i FROM odd", "SELECT i FROM odd x WHERE r = (SELECT max(r) FROM odd y WHERE y.i = x.i)",
        "SELECT i FROM odd UNION ALL SELECT 1 EXCEPT SELECT 2", "SELECT d.k FROM (SELECT i + 1 AS k FROM odd) AS d WHERE d.k / 2 = 1", "SELECT nullif(i, 2), coalesce(i, 'none'), iif(i > 2, 'big', 'small') FROM odd", "SELECT i FROM odd WHERE t BETWEEN 1 AND 6 OR r BETWEEN '0' AND '2'",
        "SELECT s FROM odd GROUP BY s HAVING count(*) > 0 ORDER BY max(i)", "SELECT lower(s) AS k, sum(i) FROM odd GROUP BY k", "SELECT lower(s), sum(i) / count(*) FROM odd GROUP BY 1", "SELECT i FROM odd WHERE EXISTS (SELECT 1 FROM odd o2 WHERE o2.i = odd.i + 1)", "SELECT [i], `t` FROM odd WHERE s COLLATE NOCASE = 'ABC'",
    ])


def test_random_conditions(spark, lite):
    rng = random.Random(4)
    operand = lambda: rng.choice(["i", "t", "r", "s", "2", "'5'", "'abc'", "2.5", "i + 1", "i / 2", "NULL", "t || ''", "-r", "'7'"])

    def condition(depth):
        if depth and rng.random() < 0.5:
            return f"({condition(depth - 1)} {rng.choice(['AND', 'OR'])} {condition(depth - 1)})"
        a, b, c = operand(), operand(), operand()
        return rng.choice([f"{a} {rng.choice(['=', '<', '>', '<=', '>=', '!=', '<>', '=='])} {b}", f"NOT {a} = {b}", f"{a} BETWEEN {b} AND {c}", f"{a} IN (1, '5', 'abc', 2)", f"{a} IS NULL", f"{a} LIKE 'A%'", f"{a} IS NOT {b}"])

    compare(spark, lite, [f"SELECT i, t, r, s FROM odd WHERE {condition(2)}" for _ in range(60)])


@pytest.mark.parametrize("sql", ["", "SELECT", "SELECT a FROM", "DROP TABLE odd", "SELECT a FROM t WHERE", "SELECT (a FROM t", "SELECT a b c FROM t", "SELECT a FROM t GLOB 3 3"])
def test_what_is_no_statement_is_refused(sql):
    with pytest.raises(sqlite.Unsupported):
        sqlite.spark_sql(sql, lambda t: {"a": "int"})


def test_verdicts_with_sqlite_meaning(spark, lite):
    pairs = [(0, "SELECT count(*) FROM odd WHERE s LIKE 'a%'", "SELECT count(*) FROM odd WHERE s LIKE 'A%'"), (1, "SELECT i / 2 FROM odd", "SELECT i * 1.0 / 2 FROM odd"), (2, "SELECT i FROM odd", "nonsense")]
    got = {r["line"]: r["equal"] for r in evaluate.execution_verdicts(spark, pairs, prepare=sqlite.translator(spark)).collect()}
    assert got == {0: True, 1: False, 2: False}
