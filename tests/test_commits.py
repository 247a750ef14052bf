"""Tables that change together: writers that race, die and come back."""

import threading

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import store, vector_index
from sqlassay.sources import commits, corpora

TABLES = {"numbers": "k long, v string", "notes": "k long"}


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), TABLES["numbers"])


def content(log, table="numbers", version=None):
    return sorted(map(tuple, log.read(table, version).collect()))


def test_tables_change_together(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    assert log.version() == -1 and content(log) == []
    assert log.update(lambda read: {"numbers": (commits.APPEND, rows(spark, (1, "a"))), "notes": (commits.APPEND, spark.range(2).toDF("k"))}) == 0
    assert log.update(lambda read: {"numbers": (commits.REPLACE, read("numbers").withColumn("v", F.lit("b")))}) == 1
    assert content(log) == [(1, "b")] and content(log, version=0) == [(1, "a")] and content(log, "notes") == [(0,), (1,)]


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    log.update(lambda read: {"numbers": (commits.APPEND, rows(spark, (1, "a")))})

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "_create", die)  # all data written, the commit not
        with pytest.raises(KeyboardInterrupt):
            log.update(lambda read: {"numbers": (commits.REPLACE, rows(spark, (2, "b"))), "notes": (commits.APPEND, spark.range(5).toDF("k"))})
    assert content(log) == [(1, "a")] and content(log, "notes") == [] and log.version() == 0
    with monkeypatch.context() as m:
        m.setattr(commits.CommitLog, "_write", die)  # the second table not even written
        with pytest.raises(KeyboardInterrupt):
            log.update(lambda read: {"numbers": (commits.APPEND, rows(spark, (3, "c")))})
    assert log.vacuum() == 0 and log.vacuum(0) == 2 and content(log) == [(1, "a")]
    assert log.update(lambda read: {"numbers": (commits.APPEND, rows(spark, (4, "d")))}) == 1 and content(log) == [(1, "a"), (4, "d")]


def test_a_commit_is_created_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    won, lost, start = [], [], threading.Barrier(8)

    def create(k):
        start.wait()
        try:
            log._create(0, f'{{"by": {k}}}')
            won.append(k)
        except commits.Conflict:
            lost.append(k)

    threads = [threading.Thread(target=create, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 7 and log.snapshot(0) == {"by": won[0]}


def test_writers_lose_nothing(spark, tmp_path):
    errors = []

    def work(k):
        try:
            log = commits.CommitLog(spark, str(tmp_path), TABLES)
            for i in range(3):
                log.update(lambda read: {"notes": (commits.APPEND, spark.range(1).select(F.lit(10 * k + i).cast("long").alias("k")))})
                log.update(lambda read: {"numbers": (commits.REPLACE, read("numbers").unionByName(rows(spark, (10 * k + i, "x"))))})
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    want = sorted(10 * k + i for k in range(3) for i in range(3))
    assert not errors and [k for k, _ in content(log)] == want and [k for k, in content(log, "notes")] == want and log.version() == 17


def test_a_batch_is_taken_once(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path), TABLES)
    put = lambda k, batch: log.update(lambda read: {"numbers": (commits.APPEND, rows(spark, (k, "x")))}, batch)
    assert [put(1, ("s", 0)), put(1, ("s", 0)), put(2, ("s", 1)), put(1, ("s", 0)), put(3, ("t", 0))] == [0, 0, 1, 1, 2]
    assert [k for k, _ in content(log)] == [1, 2, 3]


def test_store_survives_a_race_of_puts(spark, tmp_path):
    s = store.StrategyStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "A", 0.2), ("b", "B", 0.4)], "strategy_id string, name string, success_rate double")
    s.put(rows, "2024-01-01")
    puts = [rows.filter(f"strategy_id = '{i}'").withColumn("success_rate", F.lit(rate)) for i, rate in (("a", 0.9), ("b", 0.8))]
    threads = [threading.Thread(target=store.StrategyStore(spark, str(tmp_path)).put, args=(p, "2024-01-02")) for p in puts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert {r["strategy_id"]: r["success_rate"] for r in s.table("strategies").collect()} == {"a": 0.9, "b": 0.8}
    assert {(r["strategy_id"], r["performance_after"]) for r in s.table("strategy_evolution").collect()} == {("a", 0.9), ("b", 0.8)}
    s.delete(rows.filter("strategy_id = 'a'"))
    assert [r["strategy_id"] for r in s.table("strategies").collect()] == ["b"] and s.table("strategy_evolution").count() == 1


def test_a_cut_export_is_refused(spark, tmp_path):
    (tmp_path / "cut.json").write_text('{"strategies": [{"strategy_id": "a", "name": "A"}, {"strategy_id"')
    (tmp_path / "whole.json").write_text('{"exported_at": "x", "strategies": [{"strategy_id": "a", "name": "A", "success_rate": 0.5}]}')
    s = store.StrategyStore(spark, str(tmp_path / "store"))
    with pytest.raises(Exception):
        s.load(str(tmp_path / "cut.json"), "2024-01-01")
    assert s.table("strategies").isEmpty() and s.load(str(tmp_path / "none.json"), "2024-01-01") == 0
    assert s.load(str(tmp_path / "whole.json"), "2024-01-01") == 1 and s.table("strategies").first()["success_rate"] == 0.5


def test_collections_are_upserted(spark, tmp_path):
    put = lambda some, reset: corpora.write_collection(spark.createDataFrame(some, "id string, document string"), str(tmp_path), "c", reset)
    assert put([("a", "x"), ("b", "y")], True) == 0 and put([("b", "z"), ("c", "w"), ("c", "w")], False) == 1
    assert sorted(map(tuple, corpora.read_collection(spark, str(tmp_path), "c").collect())) == [("a", "x"), ("b", "z"), ("c", "w")]
    put([("d", "only")], True)
    assert [tuple(r) for r in corpora.read_collections(spark, str(tmp_path)).collect()] == [("d", "only", "c")]


@pytest.mark.parametrize("n, cells", [(1, None), (5, 3), (400, 12)])
def test_vector_index(spark, tmp_path, n, cells):
    items = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda k: F.sin(F.col("id") * k).cast("float")).alias("vec"), F.lit("x").alias("note"))
    vector_index.build(items, str(tmp_path), cells)
    asked = items.filter("id % 7 = 0").select(F.col("id").alias("q_id"), "vec")
    exact = vector_index.search(asked, str(tmp_path), 4, probes=n)
    by_hand = vector_index.retrieval.with_unit_vectors(items, "vec")
    pairs = vector_index.retrieval.scored(by_hand.filter("id % 7 = 0").select(F.col("id").alias("q_id"), F.col("vec").alias("q_vec")), by_hand.drop("note"))
    want = vector_index.ranked(pairs.withColumn("similarity", F.round("similarity", 12)), 4)
    assert sorted((r["q_id"], r["rank"], r["id"]) for r in exact.collect()) == sorted((r["q_id"], r["rank"], r["id"]) for r in want.collect())
    got = vector_index.recall(vector_index.search(asked, str(tmp_path), 4), exact).first()
    assert got["found"] >= 0.9 * got["pairs"] and exact.columns == ["q_id", "id", "note", "rank", "similarity"]
    if cells == 12:
        assert len(vector_index.files_read(asked.limit(1), str(tmp_path), probes=2)) < vector_index.files(spark, str(tmp_path))
