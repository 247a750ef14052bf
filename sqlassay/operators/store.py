"""The strategy store on disk, and the log of trajectories: typed tables, appends, JSON in and out."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import commits
from ..staging import staged
from . import strategies

# The store's tables and their columns.
TABLES = {
    "strategies": (
        "strategy_id string, name string, pattern string, description string, reasoning_steps array<string>, critical_rules array<string>, sql_hints string, applicability string, "
        "common_pitfalls array<string>, success_rate double, sample_count long, created_at timestamp, last_updated timestamp, version int, is_active boolean"
    ),
    "strategy_applications": (
        "application_id string, strategy_id string, trajectory_id string, query string, database string, difficulty string, success boolean, exact_match double, "
        "execution_match double, generation_time double, applied_at timestamp"
    ),
    "strategy_evolution": "evolution_id string, strategy_id string, version int, changes string, performance_before double, performance_after double, performance_delta double, evolved_at timestamp",
    "performance_metrics": "metric_id string, strategy_id string, metric_name string, metric_value double, recorded_at timestamp",
}
TRAJECTORY = (
    "trajectory_id string, question string, database string, schema string, generated_sql string, gold_sql string, strategies_used array<string>, reasoning_steps array<string>, "
    "generation_time double, timestamp double, exact_match double, execution_match boolean, component_scores map<string,double>, metadata map<string,string>"
)


def new_id(prefix: str, at: Column, *parts: Column) -> Column:
    """prefix_timestamp_digest: eight digits of an MD5 of the parts, so that reruns agree."""
    digest = F.substring(F.md5(F.concat_ws("\t", *[p.cast("string") for p in parts])), 1, 8)
    return F.concat_ws("_", F.lit(prefix), F.date_format(at, "yyyyMMddHHmmss"), digest)


def typed(df: DataFrame, table: str) -> DataFrame:
    """The columns of a store table in order, cast; those that ``df`` lacks are null, or the table's defaults."""
    defaults = {"success_rate": F.lit(0.0), "sample_count": F.lit(0), "version": F.lit(1), "is_active": F.lit(True)} if table == "strategies" else {}
    out = []
    for spec in _columns(TABLES[table]):
        name, kind = spec
        value = F.col(name) if name in df.columns else F.lit(None)
        if name in defaults:
            value = F.coalesce(value, defaults[name])
        out.append(value.cast(kind).alias(name))
    return df.select(*out)


def _columns(ddl: str) -> list[tuple[str, str]]:
    return [tuple(x.split(" ", 1)) for x in ddl.split(", ")]


def applications(runs: DataFrame, at: Column) -> DataFrame:
    """Rows for strategy_applications from runs (strategy_id, trajectory_id, ...), with ids of their own."""
    rows = runs.withColumn("applied_at", at)
    return typed(rows.withColumn("application_id", new_id("app", at, F.col("strategy_id"), F.col("trajectory_id"))), "strategy_applications")


def evolution(history: DataFrame, at: Column) -> DataFrame:
    """Rows for strategy_evolution from the history that strategies.upsert() gives."""
    rows = history.select("strategy_id", "version", F.col("old_rate").alias("performance_before"), F.col("new_rate").alias("performance_after"), (F.col("new_rate") - F.col("old_rate")).alias("performance_delta"), F.lit("success_rate").alias("changes"))
    return typed(rows.withColumn("evolved_at", at).withColumn("evolution_id", new_id("evo", at, F.col("strategy_id"), F.col("version"))), "strategy_evolution")


class StrategyStore:
    """The four tables in one folder, behind a log of commits: strategies and their evolution change together.

    Several writers may use a store at once: none loses another's rows. A writer that dies
    half-way changes nothing. Use as a context manager or not: nothing stays open.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.log = commits.CommitLog(spark, folder, TABLES)

    def __enter__(self) -> "StrategyStore":
        return self

    def __exit__(self, *_) -> None:
        return None

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of the last commit, or of an earlier one."""
        return self.log.read(name, version)

    def put(self, new: DataFrame, at: str, batch: tuple[str, int] | None = None) -> int:
        """Strategies put in by id; changed success rates go to strategy_evolution with them. The number of the commit.

        A ``batch`` (source, number) that was put in before changes nothing.
        """
        when = F.lit(at).cast("timestamp")
        rows = typed(new, "strategies").withColumn("last_updated", when)

        def change(read) -> dict:
            merged, history = strategies.upsert(read("strategies"), rows, at)
            whole = typed(merged.withColumn("created_at", F.coalesce("created_at", when)), "strategies")
            return {"strategies": (commits.REPLACE, whole), "strategy_evolution": (commits.APPEND, evolution(history, when))}

        return self.log.update(change, batch)

    def record(self, runs: DataFrame, at: str, batch: tuple[str, int] | None = None) -> int:
        """Append applications."""
        rows = applications(runs, F.lit(at).cast("timestamp"))
        return self.log.update(lambda read: {"strategy_applications": (commits.APPEND, rows)}, batch)

    def delete(self, ids: DataFrame) -> int:
        """Strategies (strategy_id) and all that hangs on them, from all tables at once."""
        return self.log.update(lambda read: {t: (commits.REPLACE, strategies.hard_delete(read(t), ids)) for t in TABLES})

    def export(self, path: str) -> int:
        """All strategies, active or not, as a folder of JSON lines, written by the tasks that read them; how many."""
        rows = self.table("strategies")
        rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
        return rows.count()

    def load(self, path: str, at: str) -> int:
        """Put in what export() wrote, or a JSON file {.., strategies: [..]}; how many.

        A path that is missing puts in none. A line that is no JSON, or a file that ends too early, is refused as a whole.
        """
        try:
            text = self.spark.read.text(path, wholetext=path.endswith(".json"))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return 0
        one, whole = TABLES["strategies"], f"strategies array<struct<{TABLES['strategies'].replace(' ', ':').replace(',:', ',')}>>"
        if path.endswith(".json"):
            rows = text.select(F.explode(F.from_json("value", whole, {"mode": "FAILFAST"})["strategies"]).alias("r")).select("r.*")
        else:
            rows = text.select(F.from_json("value", one, {"mode": "FAILFAST"}).alias("r")).select("r.*")
        rows = staged(rows, "loaded")
        if not rows.isEmpty():
            self.put(rows, at)
        return rows.count()


def from_json(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """Dicts as typed rows; keys that the table lacks are dropped, missing ones null."""
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return text.select(F.from_json("j", ddl).alias("r")).select("r.*")


# ---- trajectories ------------------------------------------------------------------------


def trajectories(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Dicts of trajectories as a typed table; lists and maps that lack are empty, times 0."""
    out = from_json(spark, rows, TRAJECTORY)
    none = F.array().cast("array<string>")
    return out.withColumns({"strategies_used": F.coalesce("strategies_used", none), "reasoning_steps": F.coalesce("reasoning_steps", none), "generation_time": F.coalesce("generation_time", F.lit(0.0)), "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>"))})


def to_dicts(log: DataFrame) -> DataFrame:
    """(trajectory_id, json): each trajectory as the JSON that trajectories() reads back."""
    return log.select("trajectory_id", F.to_json(F.struct(*[F.col(n) for n, _ in _columns_of(log)])).alias("json"))


def _columns_of(log: DataFrame) -> list[tuple[str, str]]:
    return [(n, t) for n, t in log.dtypes]


def added(log: DataFrame, new: DataFrame) -> DataFrame:
    """The log with ``new`` put in: an id that is there already is replaced."""
    return log.join(new.select("trajectory_id"), "trajectory_id", "left_anti").unionByName(new)


def get(log: DataFrame, trajectory_id: str) -> DataFrame:
    return log.filter(F.col("trajectory_id") == trajectory_id)


def cleared(log: DataFrame) -> DataFrame:
    return log.limit(0)


def recent(log: DataFrame, most: int = 100, time: str = "timestamp", key: str = "trajectory_id") -> DataFrame:
    """The latest rows: a top-k by design, earlier ids first among equals."""
    return log.orderBy(F.desc(time), key).limit(most)


def log_statistics(log: DataFrame, judged: DataFrame) -> DataFrame:
    """One row: trajectories, judged ones, share of judged ones that succeeded (0 without), mean generation time (0 without)."""
    a = log.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.round(F.avg("generation_time"), 6), F.lit(0.0)).alias("avg_generation_time"))
    ok = F.avg(F.col("outcome").endswith("SUCCESS").cast("double"))
    b = judged.agg(F.count(F.lit(1)).alias("judged"), F.coalesce(F.round(ok, 6), F.lit(0.0)).alias("success_rate"))
    return a.join(F.broadcast(b), F.lit(True))  # one row each


def matched_uses(log: DataFrame, store: DataFrame, used: str = "strategies_used") -> DataFrame:
    """(strategy_id, uses): how often each stored strategy was used in the log."""
    each = log.select(F.explode(used).alias("strategy_id"))
    return each.join(store.select("strategy_id"), "strategy_id").groupBy("strategy_id").agg(F.count(F.lit(1)).alias("uses"))


def history_summary(history: DataFrame, action: str = "action", order: str = "at", last: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts by action, and the last ten entries."""
    return history.groupBy(action).agg(F.count(F.lit(1)).alias("n")), history.orderBy(F.desc(order)).limit(last)


def insight_summary(judged: DataFrame) -> DataFrame:
    """Per outcome: judgments, mean confidence, and how many insights they gave."""
    return judged.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.sum(F.size("insights")).alias("insights"))


def retrieval_statistics(found: DataFrame, key: str = "q_id") -> DataFrame:
    """One row: questions, strategies found, mean relevance."""
    return found.agg(F.countDistinct(key).alias("questions"), F.count(F.lit(1)).alias("found"), F.round(F.avg("relevance"), 6).alias("avg_relevance"))


def feedback(sql: Column, score: Column) -> Column:
    """What to change in an attempt, by rules; joined by `` | ``."""
    up = F.upper(sql)
    order, group = F.instr(up, F.lit("ORDER BY")), F.instr(up, F.lit("GROUP BY"))
    aggregated = F.exists(F.array(*map(F.lit, ("AVG", "SUM", "COUNT", "MAX", "MIN"))), lambda w: up.contains(w))
    rules = [
        F.when(aggregated & (group == 0), "group, if one result for each group is asked for"),
        F.when(up.contains("JOIN") & ~sql.contains("."), "qualify columns by their table"),
        F.when((order > 0) & (group > 0) & (order < group), "sort after grouping"),
        F.when(score < 0.5, "the score is low: review the structure"),
    ]
    return F.coalesce(F.nullif(F.concat_ws(" | ", *rules), F.lit("")), F.lit("nothing stands out"))


def fan_out(questions: DataFrame, generate, schema: str, tasks: int = 5) -> DataFrame:
    """Generate for all questions, ``tasks`` at a time: generate(frames) yields frames of ``schema``."""
    return questions.repartition(tasks).mapInPandas(generate, schema)


def hybrid_best(*attempts: DataFrame) -> DataFrame:
    """Of several ways' candidates (q_id, candidate, score, ...) each question's best; the earlier way's among equals."""
    every = None
    for k, a in enumerate(attempts):
        rows = a.withColumn("way", F.lit(k))
        every = rows if every is None else every.unionByName(rows)
    return strategies.best_candidates(every.withColumn("candidate", F.col("way") * 1_000_000 + F.col("candidate")))
