import json

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import retrieval, strategies
from sqlassay.sources import corpora
from sqlassay.streaming import grades

TABLES = [{"db_id": "shop", "table_names": ["item"], "table_names_original": ["Item", "Sale"], "column_names": [], "column_names_original": [[-1, "*"], [0, "Id"], [0, "Name"], [1, "Item_Id"]], "column_types": ["text", "number", "text", "number"], "primary_keys": [1], "foreign_keys": [[3, 1]]}]


def test_missing_file_is_empty(spark, tmp_path):
    assert corpora.read_json(spark, str(tmp_path / "no.json"), corpora.EXAMPLES).count() == 0
    with pytest.raises(ValueError):
        corpora.load_split(spark, str(tmp_path), "nosuch")


def test_splits_and_catalog(spark, tmp_path):
    (tmp_path / "dev.json").write_text(json.dumps([{"db_id": "shop", "question": f"q{i}", "query": "SELECT 1"} for i in range(5)]))
    (tmp_path / "tables.json").write_text(json.dumps(TABLES))
    rows = corpora.load_split(spark, str(tmp_path), "dev")
    assert [r["example_id"] for r in rows.orderBy("example_id").collect()] == list(range(5))
    t = corpora.read_json(spark, str(tmp_path / "tables.json"), corpora.CATALOG)
    cat = corpora.catalog_rows(t)
    assert {(r["table"], r["column"], r["is_pk"]) for r in cat.collect()} == {("item", "id", True), ("item", "name", False), ("sale", "item_id", False)}
    assert json.loads(corpora.catalog_json(cat).first()["catalog"]) == {"item": ["id", "name"], "sale": ["item_id"]}
    assert corpora.foreign_keys(t).first()["to_column"] == "id"
    assert {(r["col_idx"], r["canonical"]) for r in corpora.canonical_keys(t).collect()} == {(1, 1), (3, 1)}


def test_sessions_and_tsv(spark, tmp_path):
    path = str(tmp_path / "pred.tsv")
    (tmp_path / "pred.tsv").write_text("select a\tx\nselect b\ty\n\nselect c\tz\n")
    got = [(r["session"], r["sql"], r["db_id"]) for r in corpora.read_sessions(spark, path).orderBy("line").collect()]
    assert got == [(0, "select a", "x"), (0, "select b", "y"), (1, "select c", "z")]
    df = spark.createDataFrame([("s", "d"), (None, "d"), ("", "d")], "sql string, db string")
    corpora.export_tsv(df, str(tmp_path / "out"), "sql", "db")
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["s\td"]


def test_failed_predictions_are_replaced(spark):
    p = spark.createDataFrame([(0, "SELECT 1"), (1, "select a from t"), (2, None)], "line int, sql string")
    bad = corpora.failed(p)
    assert {r["line"] for r in bad.collect()} == {0, 2}
    new = corpora.replace_failed(p, bad.select("line", F.lit("select b").alias("sql")))
    assert [r["sql"] for r in new.orderBy("line").collect()] == ["select b", "select a from t", "select b"]


def test_first_table_stays_and_rows_are_cut(spark):
    q = spark.createDataFrame([(1, "t1"), (2, "t9")], "question_id long, table_id string")
    t = spark.createDataFrame([("t1", ["a"], [["1"]] * 7, None, ["text"]), ("t1", ["b"], [["2"]], None, ["text"])], "id string, header array<string>, rows array<array<string>>, name string, types array<string>").coalesce(1)
    got = {r["question_id"]: r["table"] for r in corpora.single_examples(q, t).collect()}
    assert got[1]["header"] == ["a"] and len(got[1]["rows"]) == 5 and got[2] is None


def test_collections(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "id string, document string")
    rows = rows.withColumn("embedding", retrieval.hashed_embedding(F.col("document"), 8))
    corpora.write_collection(rows, str(tmp_path), "questions")
    back = corpora.read_collections(spark, str(tmp_path))
    assert back.groupBy("collection").count().first()["count"] == 2
    assert abs(back.select(retrieval.norm(F.col("embedding"))).first()[0] - 1) < 1e-9


def test_config(tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    assert corpora.load_config(str(tmp_path / "a.json")) == {"x": 1}
    with pytest.raises(ValueError):
        corpora.load_config(__file__)


def test_stream_resumes(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.filter("event_id % 2 = 0").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    seen = []
    for part in (None, "event_id % 2 = 1"):
        if part:
            events.filter(part).write.mode("append").parquet(str(tmp_path / "in"))
        q = grades.run_available(stream, "", str(tmp_path / "cp"), lambda df, _: seen.append(df.count()))
        q.awaitTermination()
    assert sum(seen) == events.count()


def test_refinement_keeps_the_best(spark):
    q = spark.createDataFrame([(1,), (2,)], "q_id int")
    got = strategies.refine_loop(q, lambda df, k: df.withColumn("sql", F.lit(f"try {k}")), lambda df: df.withColumn("score", F.when(F.col("q_id") == 1, 1.0).when(F.col("sql") == "try 1", 0.5).otherwise(0.1)))
    assert {r["q_id"]: r["sql"] for r in got.collect()} == {1: "try 0", 2: "try 1"}
