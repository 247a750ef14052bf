"""Grading files end to end, the store on disk, collections, conversion and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sqlassay import __main__ as cli
from sqlassay.functions import prompts, statements, strict
from sqlassay.operators import evaluate, execute, retrieval, store
from sqlassay.sources import corpora

CATALOG = [{"db_id": "shop", "table_names_original": ["item", "sale"], "column_names_original": [[-1, "*"], [0, "Id"], [0, "Name"], [1, "Item_id"], [1, "Price"]], "column_types": ["text"] * 5, "primary_keys": [1], "foreign_keys": [[3, 1]]}]
LINES = [  # gold, prediction, exact, difficulty
    ("SELECT count(*) FROM item", "select COUNT ( * )  from item ;", True, "easy"),
    ("SELECT name FROM item WHERE id > 3", "SELECT name FROM item WHERE id >= 3", False, "medium"),
    ("SELECT T1.name FROM item AS T1 JOIN sale AS T2 ON T1.id = T2.item_id", "SELECT T1.name FROM item AS T1 INNER JOIN sale AS T2 ON T1.id = T2.item_id", True, "medium"),
    ("SELECT name FROM item", "SELECT 1", False, "unknown"),
    ("SELECT name FROM nowhere", "SELECT name FROM item", False, None),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    (d / "gold.txt").write_text("\n".join(f"{g}\tshop" + "\n" * (k == 2) for k, (g, *_) in enumerate(LINES)) + "\n")
    (d / "pred.txt").write_text("\n".join(f"{p}\tshop" + "\n" * (k == 2) for k, (_, p, *_) in enumerate(LINES)) + "\n")
    (d / "tables.json").write_text(json.dumps(CATALOG))
    return d


def test_grade_files(spark, files):
    graded, scores = evaluate.grade_files(spark, str(files / "gold.txt"), str(files / "pred.txt"), str(files / "tables.json"))
    rows = graded.orderBy("line").collect()
    assert [r["exact_match"] for r in rows] == [x for _, _, x, _ in LINES] and [r["hardness"] for r in rows] == [h for *_, h in LINES]
    assert [r["turn"] for r in rows] == [1, 2, 3, 1, 2] and [r["counted"] for r in rows] == [True] * 4 + [False]
    by = {r["level"]: r for r in scores.collect()}
    assert by["all"]["count"] == 4 and by["all"]["exact"] == 0.5 and by["joint_all"]["count"] == 2 and by["turn 1"]["count"] == 2
    text = evaluate.summary_text(scores, "SHOP", {"rules": {"used": 2}})
    assert text.splitlines()[:2] == ["SHOP EVALUATION SUMMARY", "MAIN METRICS"] and "Exact Match Accuracy : 50.00%" in text and "  used: 2" in text and "  easy     | count=1     | EM=100.00%" in text


def test_execution(spark, files):
    spark.createDataFrame([(1, "a"), (2, "b"), (4, "c")], "id int, name string").createOrReplaceTempView("item")
    spark.createDataFrame([(1, 2.0), (1, 3.0)], "item_id int, price double").createOrReplaceTempView("sale")
    pairs = [(k, g, p) for k, (g, p, *_) in enumerate(LINES)]
    got = {r["line"]: (r["equal"], r["error"]) for r in evaluate.execution_verdicts(spark, pairs).collect()}
    assert [got[k][0] for k in range(5)] == [True, True, True, False, False] and got[4][1]
    assert execute.try_sql(spark, "SELECT id FROM range(2000)")[1].count() == 2000
    assert execute.try_sql(spark, "SELECT id FROM range(3)") == ("result", [(0,), (1,), (2,)]) and execute.try_sql(spark, "SELECT x")[0] == "exception"


def test_structural_command(spark, tmp_path):
    (tmp_path / "gold.json").write_text(json.dumps([{"db_id": "t", "question": "q", "sql": s} for s in ("SELECT MAX(a b) FROM t WHERE c = 'x'", json.dumps({"agg": 3, "sel": 0, "conds": [[1, 1, 3], [1]]}), "nonsense")]))
    (tmp_path / "pred.tsv").write_text("SELECT MAX(a_b) FROM t WHERE c = 'X'\tt\nSELECT COUNT(*) FROM t WHERE c >= 3\tt\n\n")
    (tmp_path / "tables.jsonl").write_text(json.dumps({"id": "t", "header": ["a b", "c"], "types": ["text"] * 2, "rows": []}))
    text = cli.main(["structural", str(tmp_path / "gold.json"), str(tmp_path / "pred.tsv"), str(tmp_path / "tables.jsonl")], spark)
    assert "Structural EM   : 66.67%" in text and "Parse failures  : 1" in text and "gold_parse" in text


def test_strict_parts():
    assert strict.parts("SELECT a, b FROM t") is None and strict.parts("") is None and strict.parts("DROP t") is None
    assert strict.parts("select avg(distinct `p q`) from t where x_in_y not like 'a''b' and z=-1.5e3 and w in ('p', 'q')") == (5, "p q", False, [("z", "=", "-1.5e3"), ("x_in_y", "not like", "'a''b'"), ("w", "in", "('p', 'q')")])


@pytest.mark.parametrize("answer, sql", [
    ("```sql\nSELECT a\nFROM t;\n```", "SELECT a FROM t"), ("Answer: SELECT a FROM t\n\nBecause.", "SELECT a FROM t"), ("I can not answer this.", ""), ("SELECT 5 This is it", ""),
    ("SELECT a FROM t WHERE b = 'So; But' However no", "SELECT a FROM t WHERE b = 'So; But'"), (None, ""), ("first SELECT x FROM u\n SELECT y FROM `v`", "SELECT y FROM v"),
])
def test_extraction(answer, sql):
    assert statements.extracted(answer) == sql


def test_nested_backticks(spark):
    df = spark.createDataFrame([(("`a`", ["`b`", None], {"k": "`c`"}), 3)], "s struct<x:string,y:array<string>,z:map<string,string>>, n int")
    got = df.select(*[statements.clean_backticks(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]).first()
    assert got["s"].asDict() == {"x": "a", "y": ["b", None], "z": {"k": "c"}} and got["n"] == 3


def test_store(spark, tmp_path):
    with store.StrategyStore(spark, str(tmp_path / "store")) as s:
        assert all(s.table(t).isEmpty() for t in store.TABLES)
        first = spark.createDataFrame([("a", "A", "P", 0.2), ("b", "B", "P", 0.4)], "strategy_id string, name string, pattern string, success_rate double")
        s.put(first, "2024-01-01")
        s.put(first.filter("strategy_id = 'a'").withColumn("success_rate", F.lit(0.6)), "2024-02-01")
        rows = {r["strategy_id"]: r for r in s.table("strategies").collect()}
        assert rows["a"]["success_rate"] == 0.6 and rows["a"]["version"] == 2 and rows["b"]["version"] == 1
        assert str(rows["a"]["created_at"]).startswith("2024-01-01") and str(rows["a"]["last_updated"]).startswith("2024-02-01")
        changed = s.table("strategy_evolution").collect()
        assert [(r["strategy_id"], r["performance_before"], r["performance_after"]) for r in changed] == [("a", 0.2, 0.6)]
        s.record(spark.createDataFrame([("a", "t1", True)], "strategy_id string, trajectory_id string, success boolean"), "2024-02-02")
        s.record(spark.createDataFrame([("a", "t2", False)], "strategy_id string, trajectory_id string, success boolean"), "2024-02-03")
        assert sorted((r["trajectory_id"], r["success"]) for r in s.table("strategy_applications").collect()) == [("t1", True), ("t2", False)]
        assert s.export(str(tmp_path / "out")) == 2
    with store.StrategyStore(spark, str(tmp_path / "other")) as o:
        assert o.load(str(tmp_path / "none.json"), "2024-03-01") == 0 and o.load(str(tmp_path / "out"), "2024-03-01") == 2
        assert {r["strategy_id"]: r["success_rate"] for r in o.table("strategies").collect()} == {"a": 0.6, "b": 0.4}


def test_trajectories(spark):
    log = store.trajectories(spark, [{"trajectory_id": "t1", "question": "q", "database": "d", "generated_sql": "s", "metadata": {"k": "v"}, "no such": 1}, {"trajectory_id": "t2", "question": "r", "database": "d", "generated_sql": "s", "generation_time": 2.0}])
    rows = {r["trajectory_id"]: json.loads(r["json"]) for r in store.to_dicts(log).collect()}
    assert rows["t1"]["metadata"] == {"k": "v"} and rows["t1"]["strategies_used"] == [] and store.get(log, "t2").first()["generation_time"] == 2.0
    again = store.trajectories(spark, [rows["t1"] | {"question": "other"}])
    assert {r["trajectory_id"]: r["question"] for r in store.added(log, again).collect()} == {"t1": "other", "t2": "r"} and store.cleared(log).isEmpty()


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "id string, document string")
    where = str(tmp_path)
    assert corpora.read_collection(spark, where, "questions", "one") is None and not corpora.delete_collection(spark, where, "questions", "one")
    corpora.write_collection(rows, where, "questions", dataset="one")
    corpora.write_collection(rows.filter("id = 'b'").withColumn("id", F.lit("c")), where, "questions", reset=False, dataset="one")
    assert sorted(r["id"] for r in corpora.read_collection(spark, where, "questions", "one").collect()) == ["a", "b", "c"]
    assert corpora.delete_collection(spark, where, "questions", "one") and corpora.read_collection(spark, where, "questions", "one") is None
    assert corpora.first_readable(lambda: spark.read.parquet(where + "/none"), lambda: None, lambda: rows).count() == 3


def test_unreadable_json(spark, tmp_path):
    (tmp_path / "bad.json").write_text("[{]")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a"\n')
    assert corpora.read_json(spark, str(tmp_path / "bad.json"), "a int").isEmpty() and corpora.read_json(spark, str(tmp_path / "none.json"), "a int").isEmpty()
    with pytest.raises(ValueError):
        corpora.read_json(spark, str(tmp_path / "bad.jsonl"), "a int")


def test_convert_index_search(spark, tmp_path):
    rows = [{"db_id": "d", "question": "How many cats are there?", "query": "SELECT count(*) FROM cat"}, {"db_id": "d", "question": "Name the dogs", "query": "SELECT name FROM dog"}, {"db_id": "d", "question": "no statement"}]
    (tmp_path / "dev.json").write_text(json.dumps(rows))
    assert cli.main(["convert", str(tmp_path), "dev", str(tmp_path / "out")], spark) == "sql: 2 lines\nquestions: 3 lines\nfull: 2 lines"
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "dev_sql")).collect()) == ["SELECT count(*) FROM cat\td", "SELECT name FROM dog\td"]
    cli.main(["index", str(tmp_path), "dev", str(tmp_path / "vectors")], spark)
    found = cli.main(["search", str(tmp_path / "vectors"), "how many cats", "--most", "1"], spark)
    assert found.startswith("1. Database: d\nQuestion: How many cats")
    assert cli.main(["search", str(tmp_path / "vectors"), "sql count from cat", "--most", "1"], spark).startswith("1. SELECT count(*) FROM cat")
    (tmp_path / "pred.tsv").write_text("SELECT 1\td\nSELECT a FROM t\td\n")
    assert cli.main(["failed", str(tmp_path / "pred.tsv"), str(tmp_path / "again")], spark) == "1 lines"


def test_prompt_parts():
    assert "Example 3:" in prompts.examples_text(3) and "Example 4:" not in prompts.examples_text(3) and "Explanation:" not in prompts.examples_text(2, False)
    assert "Schema Compliance" in prompts.rules_text() and "single table" in prompts.critical_text() and "How many" in prompts.patterns_text()
    assert set(prompts.SPECIAL) == {"debug", "optimise", "explain"}


def test_unknown_grader():
    assert evaluate.grader("multi") is evaluate.grade
    with pytest.raises(ValueError):
        evaluate.grader("other")
    assert retrieval.LEAVING == ("quit", "exit", "q")


@pytest.mark.parametrize("sql, form", [
    ("SELECT a FROM t WHERE c IS NOT NULL AND t.x is null AND b = 1", "SELECT a FROM t WHERE b = 1"), ("SELECT a FROM t WHERE c IS NULL AND b IS NULL", "SELECT a FROM t"), ("SELECT a FROM t WHERE 1=1 AND 1=1 ORDER BY a", "SELECT a FROM t ORDER BY a"),
    ("SELECT a FROM t WHERE b = 2 AND lower(c) = 'x y' AND d > 3", "SELECT a FROM t WHERE b = 2 AND d > 3"), ("SELECT a FROM t WHERE lower(c) = 'x'", "SELECT a FROM t WHERE lower(c) = 'x'"), ("SELECT a FROM t WHERE v = 1.5E AND w>=1.2.3 AND x = 1.5", "SELECT a FROM t WHERE v = '1.5E' AND w>='1.2.3' AND x = 1.5"),
    ('SELECT a FROM t WHERE b="it\'s" AND c != "q"', "SELECT a FROM t WHERE b= 'it''s' AND c != 'q'"), ("SELECT a FROM t WHERE b NOT  IN (1) AND c Not Like 'x' AND NOT BETWEEN", "SELECT a FROM t WHERE b not in (1) AND c not like 'x' AND not between"), ("SELECT 'p AND q IS NULL r' FROM t", "SELECT 'p AND q IS NULL r' FROM t"),
])
def test_conditions_that_are_not_compared(sql, form):
    assert statements.normal_nulls(sql) == form


def test_statements_are_normalised_once(spark, small):
    # graded rows come from what was normalised on disk, for the texts and for each side
    from sqlassay.plans import wider

    assert any("/normalised-" in f for f in wider._graded(spark, small).inputFiles())
