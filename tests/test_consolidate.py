"""Merging, refining and trying again, against plain Python; the stream of uses with replays and late rows."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sqlassay.operators import consolidate, store
from sqlassay.streaming import strategies as stream

STORE = "strategy_id string, name string, pattern string, keywords array<string>, steps array<string>, success_rate double, sample_count long, version int, common_pitfalls array<struct<mistake:string,consequence:string,fix:string,frequency:double>>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def similarity(x, y):
    return round(0.5 * jaccard(x[2].split("_"), y[2].split("_")) + 0.3 * jaccard(x[3], y[3]) + 0.2 * jaccard(x[4], y[4]), 9)


def greedy(rows, over):
    """Each in turn, the most successful first, takes in all later ones like it that are left."""
    rows, taken = sorted(rows, key=lambda r: (-r[5], r[0])), {}
    for i, x in enumerate(rows):
        if x[0] not in taken:
            for y in rows[i + 1 :]:
                if y[0] not in taken and similarity(x, y) > over:
                    taken[y[0]] = x[0]
    return taken


def some_store(rng, n):
    rows = []
    for k in range(n):
        base = rng.randrange(max(2, n // 6))
        own = random.Random(base)
        words = [f"w{own.randrange(40)}" for _ in range(6)] + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(2))]
        steps = [f"s{own.randrange(8)}" for _ in range(4)] + ["s9"] * rng.randrange(2)
        rows.append((f"id{k:03d}", f"n{k}", rng.choice(["A_B_C", "A_B_C", "A_B", "D_E"]), rng.choice([words, words, []]) if rng.random() < 0.9 else words, steps if rng.random() < 0.95 else [], rng.choice([0.1, 0.5, 0.5, 0.9]), rng.randrange(5), 1, [("m" + str(k % 4), "c", "f", 0.5)] * (k % 3)))
    return rows


@pytest.mark.parametrize("over", [0.5, 0.72, 0.85, 0.9])
def test_merging_equals_the_sequential_greedy_one(spark, over):
    rows = some_store(random.Random(int(over * 100)), 150)
    rows += [(f"copy{k}", "c", "A_B_C", ["k1", "k2"], ["s1"], 0.5, 1, 1, []) for k in range(40)] + [(f"bare{k}", "b", "A_B_C", [], [], 0.5, 1, 1, []) for k in range(10)]
    df = spark.createDataFrame(rows, STORE)
    got = {r["secondary"]: r["primary"] for r in consolidate.merge_plan(df, over).collect()}
    assert got == greedy(rows, over) and got
    merged, log = consolidate.merge_similar(df, over)
    members = defaultdict(list)
    by_id = {r[0]: r for r in rows}
    for secondary, primary in got.items():
        members[primary].append(secondary)
    out = {r["strategy_id"]: r for r in merged.collect()}
    assert set(out) == set(by_id) - set(got) and log.count() == len(got)
    for k, r in out.items():
        every = [by_id[k], *(by_id[m] for m in sorted(members[k]))]
        n = sum(x[6] for x in every)
        rate = by_id[k][5] if len(every) == 1 else sum(x[5] * x[6] for x in every) / n if n else sum(x[5] for x in every) / len(every)
        assert r["sample_count"] == n and r["success_rate"] == pytest.approx(rate) and r["version"] == len(every) and set(r["keywords"]) == {w for x in every for w in x[3]}
        if len(every) > 1:
            assert [p["mistake"] for p in r["common_pitfalls"]] == list(dict.fromkeys(p[0] for x in every for p in x[8]))
    assert merged.columns == df.columns


def test_no_strategies(spark):
    none = spark.createDataFrame([], STORE)
    assert consolidate.merge_plan(none).isEmpty() and consolidate.merge_similar(none)[0].isEmpty()
    with pytest.raises(ValueError):
        consolidate.similar_pairs(none.withColumn("place", F.lit(1)), 0.4)


USES = "strategy_id string, trajectory_id string, question string, outcome string, insights array<struct<pattern:string,lesson:string,key_elements:array<string>>>"


def test_refining(spark):
    old = [(f"old{k}", "c", "f", 0.3 + k / 100) for k in range(8)]
    df = spark.createDataFrame([("a", "A", "P", ["count"], [], 0.5, 10, 1, old), ("b", "B", "P", [], [], 0.2, 3, 4, [])], STORE)
    insight = lambda p, lesson="say so", key=(): (p, lesson, list(key))
    uses = [("a", f"t{k}", "How many cats live here now", "COMPLETE_SUCCESS", []) for k in range(3)]
    uses += [("a", f"f{k}", "q", "EXECUTION_FAILURE", [insight("join", key=["use keys", "x"])] + [insight("old3")] * (k < 2) + [insight("quiet", None)] + [insight(f"rare{k}", "r")]) for k in range(5)] + [("a", "p", "q", "PARTIAL_SUCCESS", [insight("none")])]
    got = {r["strategy_id"]: r for r in consolidate.refine_strategies(df, spark.createDataFrame(uses, USES)).collect()}
    a = got["a"]
    assert a["success_rate"] == pytest.approx(0.7 * 0.5 + 0.3 * 3 / 9) and a["sample_count"] == 19 and a["version"] == 2
    assert set(a["keywords"]) == {"count", "cats", "live", "here", "many"} or set(a["keywords"]) - {"count"} <= {"cats", "live", "here", "many"}
    new = [("join", 1.0, "use keys"), ("rare0", 0.2, "Review query structure"), ("rare1", 0.2, "Review query structure"), ("rare2", 0.2, "Review query structure")]
    want = sorted([(-f, k, m) for k, (m, f, _) in enumerate([(o[0], o[3], "f") for o in old] + new)])[:10]
    assert [p["mistake"] for p in a["common_pitfalls"]] == [m for _, _, m in want] and {p["mistake"]: p["fix"] for p in a["common_pitfalls"]}["join"] == "use keys"
    assert got["b"]["version"] == 4 and got["b"]["success_rate"] == 0.2


def test_feedback_reaches_the_next_attempt(spark):
    asked = spark.createDataFrame([(k, k % 4) for k in range(12)], "q_id long, need int")
    # an attempt is the last one with what it was told
    attempt = lambda df, k: df.withColumn("sql", F.concat(F.coalesce("previous_sql", F.lit("s")), F.coalesce("feedback", F.lit(""))))
    right = F.length("sql") - 1 >= F.col("need")
    judge = lambda df: df.withColumns({"score": F.length("sql") - 1.0, "exact_match": right, "execution_match": right})
    got = {r["q_id"]: r for r in consolidate.refine_with_feedback(asked, attempt, judge, lambda sql, score: F.lit("+"), rounds=3).collect()}
    for k in range(12):
        need = k % 4
        assert (got[k]["sql"], got[k]["attempts"], got[k]["improvement"]) == ("s" + "+" * min(need, 2), min(need + 1, 3), float(min(need, 2)))


def test_stream_of_uses(spark, tmp_path):
    s = store.StrategyStore(spark, str(tmp_path / "store"))
    s.put(spark.createDataFrame([(k, k, 0.0) for k in "abc"], "strategy_id string, name string, success_rate double"), "2024-01-01")
    (tmp_path / "in").mkdir()
    shape = "strategy_id string, success boolean, ts timestamp"

    def arrive(name, *rows):
        spark.createDataFrame(list(rows), "strategy_id string, success boolean, t string").select("strategy_id", "success", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / name))

    def run(checkpoint="c"):
        files = spark.readStream.schema(shape).parquet(str(tmp_path / "in" / "*"))
        q = stream.keep_up(files, s, str(tmp_path / checkpoint), at="2024-03-01", lateness="1 day", idle="10 days")
        q.awaitTermination(120)
        assert q.exception() is None
        return {r["strategy_id"]: (r["sample_count"], r["success_rate"], r["is_active"]) for r in s.table("strategies").collect()}

    arrive("1", ("a", True, "2024-02-01 00:00:00"), ("a", False, "2024-02-01 01:00:00"), ("b", True, "2024-02-01 02:00:00"), ("unknown", True, "2024-02-01 02:00:00"))
    assert run() == {"a": (2, 0.5, True), "b": (1, 1.0, True), "c": (0, 0.0, True)}
    # a much later use of c moves time on; late rows of a count nowhere, and a and b have been idle
    arrive("2", ("c", True, "2024-02-20 00:00:00"))
    run()
    arrive("3", ("a", True, "2024-02-02 00:00:00"), ("b", False, "2024-02-20 01:00:00"))
    got = run()
    assert got["c"] == (1, 1.0, True) and got["b"] == (2, 0.5, True) and got["a"][:2] == (2, 0.5)
    version, evolved = s.log.version(), s.table("strategy_evolution").count()
    # nothing new; and all of it again from the beginning, under numbers that are in already
    assert run() == got and s.log.version() == version
    run("again")
    assert s.log.version() == version and s.table("strategy_evolution").count() == evolved


def test_chain_of_likes_takes_few_rounds(spark, monkeypatch):
    # each is like the next alone: every other one is taken in, in rounds that double what they see
    staged, calls = consolidate.staged, []
    monkeypatch.setattr(consolidate, "staged", lambda df, tag: calls.append(tag) or staged(df, tag))
    n = 150
    place = lambda k: {"rate": 0.0, "id": k}
    kind = "a struct<rate:double,id:int>, b struct<rate:double,id:int>"
    got = consolidate._taken_in(spark.createDataFrame([(place(k), place(k + 1)) for k in range(n - 1)], kind))
    assert sorted(r["p"]["id"] for r in got.collect()) == list(range(1, n, 2))
    assert calls.count("left") <= 10


def test_taken_in_as_one_after_the_other(spark):
    # random graphs, against taking each in turn
    import random

    place = lambda k: {"rate": 0.0, "id": k}
    for seed, n, share in ((1, 30, 0.08), (2, 25, 0.3)):
        rnd = random.Random(seed)
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < share]
        gone = set()
        for b in range(n):
            if any(y == b and x not in gone for x, y in edges):
                gone.add(b)
        df = spark.createDataFrame([(place(a), place(b)) for a, b in edges], "a struct<rate:double,id:int>, b struct<rate:double,id:int>")
        assert {r["p"]["id"] for r in consolidate._taken_in(df).collect()} == gone


def test_pairs_of_copies_are_not_candidates_one_by_one(spark):
    # copies are compared as one kind: similarity is worked out for kinds, and all pairs come out
    from sqlassay.operators import strategies

    rows = [(k, f"P_{k % 2}", ["k", f"n{k % 2}"], ["a"]) for k in range(20)] + [(90, None, ["k"], None), (91, "P_0", None, ["a"])]
    store = spark.createDataFrame(rows, "strategy_id long, pattern string, keywords array<string>, steps array<string>")
    got = sorted((r["a"], r["b"], r["similarity"]) for r in strategies.merge_pairs(store).collect())
    assert got == [(a, b, 1.0) for a in range(20) for b in range(a + 1, 20) if (b - a) % 2 == 0]
    assert "kind" in strategies.merge_pairs(store)._jdf.queryExecution().analyzed().toString()
    low = {(r["a"], r["b"]) for r in strategies.merge_pairs(store, 0.4).collect()}
    assert len(low) == 190  # both patterns share P and a keyword
