"""Execution of many statements apart from each other, and equality of their results, against plain Python."""

import random
import time
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import evaluate, execute, results

ENDLESS = "SELECT count(*) FROM range(1000000000000000) WHERE id % 3 = 4"


def test_outcomes_stay_apart(spark):
    spark.range(50).createOrReplaceTempView("numbers")
    statements = [(k, side, f"SELECT id + {k} FROM numbers") for k in range(60) for side in (-1, 1)]
    statements += [(100 + k, 1, f"SELECT raise_error(concat('no ', id, {k})) FROM numbers") for k in range(5)] + [(200, 1, ENDLESS), (201, 1, "SELECT x FROM numbers"), (202, 1, "DROP VIEW numbers"), (203, 1, ""), (204, 1, "SELECT 1 WHERE false")]
    began = time.time()
    rows, outcomes = execute.run_statements(spark, statements, seconds=4, workers=6)
    got = {(r["query_id"], r["side"]): (r["status"], r["error"]) for r in outcomes.collect()}
    assert len(got) == len(statements) and time.time() - began < 60
    assert Counter(s for s, _ in got.values()) == {"result": 121, "exception": 8, "timeout": 1}
    assert got[200, 1][0] == "timeout" and got[202, 1][1] == "not a query" and all(e for s, e in got.values() if s != "result")
    counts = {(r["query_id"], r["side"]): r["count"] for r in rows.groupBy("query_id", "side").count().collect()}
    assert counts == {(k, side): 50 for k in range(60) for side in (-1, 1)}
    assert {r["cells"][0] for r in rows.filter("query_id = 3 AND side = 1").collect()} == {f"n:{k + 3}" for k in range(50)}


def test_statements_that_wait_keep_their_time(spark):
    # one that holds every core until it is stopped takes nothing of the others' three seconds
    statements = [("endless", 1, ENDLESS)] + [(f"q{k}", 1, f"SELECT count(*) + {k} FROM range(1000)") for k in range(12)]
    _, outcomes = execute.run_statements(spark, statements, seconds=3, workers=13)
    assert {r["query_id"]: r["status"] for r in outcomes.collect()} == {"endless": "timeout"} | {f"q{k}": "result" for k in range(12)}


def test_rows_of_a_statement_stay_dealt_out(spark):
    # no task gets all rows of a statement, however few statements there are
    spark.range(0, 80_000, 1, 4).createOrReplaceTempView("dealt")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = execute.run_statements(spark, [(0, 1, "SELECT id FROM dealt"), (1, 1, "SELECT id FROM dealt"), (2, 1, "SELECT x FROM dealt")])
        per = rows.groupBy("query_id", F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert Counter(r["query_id"] for r in per for _ in range(r["count"])) == {0: 80_000, 1: 80_000}
    assert max(r["count"] for r in per) <= 40_000


def test_a_failing_pair_costs_no_other(spark):
    spark.createDataFrame([(k, k % 7) for k in range(200)], "k int, v int").createOrReplaceTempView("o")
    pairs = [(0, "SELECT k FROM o", "SELECT DISTINCT k FROM o"), (1, "SELECT k FROM o", "SELECT k / (v - 3) FROM o"), (2, "SELECT 'a distinct b'", "SELECT 'a  b'"), (3, "SELECT nothing FROM o", "SELECT k / (v - 3) FROM o"), (4, "SELECT v FROM o", "SELECT v FROM o WHERE k > = 0")]
    got = {r["line"]: (r["equal"], r["status"]) for r in evaluate.execution_verdicts(spark, pairs).collect()}
    assert got == {0: (True, "result"), 1: (False, "exception"), 2: (False, "result"), 3: (False, "exception"), 4: (True, "result")}
    kept = evaluate.execution_verdicts(spark, [(0, "SELECT v FROM o", "SELECT DISTINCT v FROM o")], keep_distinct=True).first()
    assert kept["equal"] is False
    assert evaluate.executable("SELECT DISTINCT a, 'distinct ''x distinct' FROM `distinct t` WHERE YEAR(CURDATE()) > = 1") == "SELECT  a, 'distinct ''x distinct' FROM `distinct t` WHERE 2020>= 1"


def test_order_does_not_depend_on_partitions(spark):
    spark.range(200_000).selectExpr("id AS k").createOrReplaceTempView("many")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = [(0, "SELECT k FROM many ORDER BY k", "SELECT k FROM (SELECT k, count(*) AS c FROM many GROUP BY k) ORDER BY k"), (1, "SELECT k FROM many ORDER BY k", "SELECT k FROM many ORDER BY k DESC")]
        got = {r["line"]: r["equal"] for r in evaluate.execution_verdicts(spark, pairs).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert got == {0: True, 1: False}


@pytest.mark.parametrize("sql, reads", [("select 1", True), (" ( SELECT 1)", True), ("WITH a AS (SELECT 'insert') SELECT * FROM a", True), ("with a as (select 1) insert into t select * from a", False), ("drop table t", False), ("", False), ("from t insert into u select 1", False)])
def test_only_queries_run(sql, reads):
    assert execute.reads_only(sql) is reads


def plainly_equal(gold, pred, ordered):
    if not gold and not pred:
        return True
    if len(gold) != len(pred) or len(gold[0]) != len(pred[0]):
        return False
    for order in permutations(range(len(gold[0]))):
        put = [tuple(r[k] for k in order) for r in pred]
        if put == gold if ordered else Counter(put) == Counter(gold):
            return True
    return False


def verdicts(spark, cases):
    rows = [(k, side, i, list(r)) for k, (gold, pred, _) in enumerate(cases) for side, some in ((-1, gold), (1, pred)) for i, r in enumerate(some)]
    queries = spark.createDataFrame([(k, o) for k, (_, _, o) in enumerate(cases)], "query_id long, ordered boolean")
    found = results.results_equal(queries, spark.createDataFrame(rows, "query_id long, side int, row_id long, cells array<string>"))
    return [r["equal"] for r in found.orderBy("query_id").collect()]


def test_column_orders_against_all_permutations(spark):
    rng, cases = random.Random(8), []
    for _ in range(250):
        width, height, values = rng.randrange(1, 6), rng.randrange(0, 6), rng.randrange(1, 4)
        gold = [tuple(str(rng.randrange(values)) for _ in range(width)) for _ in range(height)]
        order = rng.sample(range(width), width)
        pred = [tuple(r[k] for k in order) for r in gold]
        if rng.random() < 0.5:
            rng.shuffle(pred)
        if pred and rng.random() < 0.5:
            r, c = rng.randrange(height), rng.randrange(width)
            pred[r] = pred[r][:c] + (str(rng.randrange(values)),) + pred[r][c + 1 :]
        cases.append((gold, pred, rng.random() < 0.3))
    assert verdicts(spark, cases) == [plainly_equal(*c) for c in cases]


def edges(*cycles, width):
    """Rows of 0 and 1: an edge of a cycle has two ones."""
    return [tuple("1" if k in (c[i], c[(i + 1) % len(c)]) else "0" for k in range(width)) for c in cycles for i in range(len(c))]


def test_column_orders_that_colours_cannot_tell(spark):
    six, threes = edges(range(6), width=6), edges(range(3), range(3, 6), width=6)
    moved = edges([3, 0, 5, 1, 4, 2], width=6)
    unit = [tuple("1" if i == k else "0" for k in range(9)) for i in range(9)]
    twelve = [tuple([str(i)] * 12) for i in range(5)]
    cases = [(six, moved, False), (six, threes, False), (threes, edges([0, 2, 4], [1, 3, 5], width=6), False), (unit, unit[::-1], False), (twelve, twelve[::-1], False), (twelve, twelve, True), (twelve, twelve[::-1], True)]
    assert verdicts(spark, cases) == [True, False, True, True, True, True, False]


@pytest.mark.parametrize("small", [results.SMALL, 0])
def test_column_orders_of_ordered_rows_that_share_a_place(spark, monkeypatch, small):
    """Rows of one place count as a multiset, compared whole or by colours."""
    monkeypatch.setattr(results, "SMALL", small)
    rng, cases = random.Random(5), []
    for _ in range(120):
        width, height = rng.randrange(1, 5), rng.randrange(1, 7)
        gold = [(rng.randrange(3), tuple(rng.choice("abc") for _ in range(width))) for _ in range(height)]
        order = rng.sample(range(width), width)
        pred = [(p, tuple(r[k] for k in order)) for p, r in rng.sample(gold, height)]
        if rng.random() < 0.5:
            k = rng.randrange(height)
            pred[k] = (rng.randrange(3), pred[k][1]) if rng.random() < 0.5 else (pred[k][0], tuple(rng.choice("abc") for _ in range(width)))
        cases.append((gold, pred, rng.random() < 0.8))
    rows = [(n, side, p, list(r)) for n, (gold, pred, _) in enumerate(cases) for side, some in ((-1, gold), (1, pred)) for p, r in some]
    queries = spark.createDataFrame([(n, o) for n, (_, _, o) in enumerate(cases)], "query_id long, ordered boolean")
    got = results.results_equal(queries, spark.createDataFrame(rows, "query_id long, side int, row_id long, cells array<string>"))
    def equal(gold, pred, ordered):
        kept = [Counter((p if ordered else 0, tuple(r[k] for k in order)) for p, r in pred) for order in permutations(range(len(gold[0][1])))]
        return Counter((p if ordered else 0, r) for p, r in gold) in kept
    assert [r["equal"] for r in got.orderBy("query_id").collect()] == [equal(*c) for c in cases]


def test_a_statement_late_beside_others_has_its_time_alone(spark, monkeypatch):
    """A busy driver takes nothing of a statement's time, and one that was late among others is run again alone."""
    import time

    def slow(sql):
        time.sleep(3.5)  # longer than the limit, without a task
        return sql

    rows, outcomes = execute.run_statements(spark, [("a", 1, "SELECT 1 AS x"), ("b", 1, "SELECT 2 AS x")], slow, seconds=2)
    assert {r["status"] for r in outcomes.collect()} == {"result"} and rows.count() == 2
    first, own = [], execute.Clock.run

    def late(clock, work):
        first.append(1)
        return (execute.TIMEOUT, "late") if len(first) == 1 else own(clock, work)

    monkeypatch.setattr(execute.Clock, "run", late)
    rows, outcomes = execute.run_statements(spark, [("a", 1, "SELECT 1 AS x"), ("b", 1, "SELECT 2 AS x")])
    assert {r["status"] for r in outcomes.collect()} == {"result"} and sorted(r["cells"] for r in rows.collect()) == [["n:1"], ["n:2"]]
