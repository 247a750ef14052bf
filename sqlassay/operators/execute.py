"""Statements run side by side on the session's tables, each with an outcome and a time limit of its own."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import cell
from ..staging import folder

#: Seconds that a statement may run (fixed value of the benchmarks), and statements under way at a time.
SECONDS, WORKERS = 60.0, 8
#: How often running statements are looked at, in seconds.
LOOK = 0.2
RESULT, EXCEPTION, TIMEOUT = "result", "exception", "timeout"
ROWS = "n long, row_id long, cells array<string>"
#: Most rows in a file of results: a task that reads files of 128 MB, each counted as 4 MB more, meets 32 of them at most.
FILE_ROWS = 100_000

# Words that begin a statement which only reads, and those that change something after WITH.
_READS = re.compile(r"[\s(]*(select|with|values)\b", re.I)
_WRITES = re.compile(r"\b(insert|update|delete|merge)\b", re.I)
_QUOTED = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`")


class Clock:
    """Stops statements that have run too long: each is a job group, and its time passes while its tasks run.

    While the driver plans, or all its tasks wait for a core, time stands still: neither a busy
    driver nor a statement that holds the cores takes any of the others' time.
    """

    def __init__(self, spark: SparkSession, seconds: float):
        self.context, self.seconds = spark.sparkContext, seconds
        self.used: dict[str, float] = {}
        self.expired: set[str] = set()
        self.lock, self.over = threading.Lock(), threading.Event()
        self.thread = threading.Thread(target=self._watch, daemon=True)

    def __enter__(self) -> "Clock":
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()

    def _runs(self, group: str) -> bool:
        """Whether a task of the group is running."""
        tracker = self.context.statusTracker()
        active = set(tracker.getActiveJobsIds())
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group) if j in active]
        stages = [tracker.getStageInfo(s) for job in jobs if job for s in job.stageIds]
        return any(s.numActiveTasks for s in stages if s)

    def _watch(self) -> None:
        last = time.monotonic()
        while not self.over.wait(LOOK):
            now = time.monotonic()
            for group in list(self.used):
                runs = group in self.expired or self._runs(group)
                with self.lock:
                    if group not in self.used:
                        continue
                    self.used[group] += now - last if runs else 0.0
                    late = self.used[group] > self.seconds
                if late:
                    # jobs that a statement starts later are stopped as well
                    self.expired.add(group)
                    self.context.cancelJobGroup(group)
            last = now

    def run(self, work: Callable[[], None]) -> tuple[str, str | None]:
        """(status, first line of the error) of ``work``, whose jobs are stopped when its time is up."""
        group = f"statement-{uuid.uuid4().hex}"
        self.context.setJobGroup(group, "statement", interruptOnCancel=True)
        self.used[group] = 0.0
        try:
            work()
            return RESULT, None
        except Exception as e:  # whatever a statement raises is its outcome
            if group in self.expired:
                return TIMEOUT, f"stopped after {self.seconds:g} seconds"
            return EXCEPTION, (str(e) or type(e).__name__).splitlines()[0]
        finally:
            with self.lock:
                del self.used[group]
            self.context.setLocalProperty("spark.jobGroup.id", None)


def reads_only(sql: str) -> bool:
    """Whether a statement can change nothing: it is a query."""
    begins = _READS.match(sql or "")
    return bool(begins) and not (begins.group(1).lower() == "with" and _WRITES.search(_QUOTED.sub("", sql)))


def _write(spark: SparkSession, sql: str, path: str) -> None:
    if not reads_only(sql):
        raise ValueError("not a query")
    df = spark.sql(sql)
    columns = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    cells = F.array(*[cell(F.col(c).cast("string")) for c in columns.columns])
    columns.select(F.monotonically_increasing_id().alias("row_id"), cells.alias("cells")).write.option("maxRecordsPerFile", FILE_ROWS).parquet(path)


def run_statements(spark: SparkSession, statements: Iterable[tuple], prepare: Callable[[str], str] | None = None, seconds: float = SECONDS, workers: int = WORKERS) -> tuple[DataFrame, DataFrame]:
    """Run (query_id, side, sql) statements: (result rows, outcomes).

    outcomes: query_id, side, status ('result', 'exception' or 'timeout'), error; one for every
    statement given, whatever the others do. Result rows: query_id, side, row_id, cells; they are
    written by the tasks that make them, in one table under the shared folder, and never pass
    through the driver. row_id grows along a sorted result. A statement that is given again is
    run once. ``prepare`` may rewrite a statement, or raise, which is then its outcome. Only
    queries run. One whose time is up beside others has it once more, alone, after the others:
    what it shares its cores with is no outcome of its own.
    """
    base = folder(spark, "statements")
    number: dict[str, int] = {}
    asked: list[tuple] = []
    outcome: dict[int, tuple[str, str | None]] = {}

    def finish(done: Iterable[Future]) -> None:
        for f in done:
            n, status, error = f.result()
            outcome[n] = status, error

    with Clock(spark, seconds) as clock, ThreadPoolExecutor(workers) as pool:

        def one(n: int, sql: str, again: str = "") -> tuple:
            return n, *clock.run(lambda: _write(spark, prepare(sql) if prepare else sql, f"{base}/rows{again}/n={n}"))

        under_way: set[Future] = set()
        for query_id, side, sql in statements:
            if sql not in number:
                number[sql] = len(number)
                if len(under_way) >= 2 * workers:
                    done, under_way = wait(under_way, return_when=FIRST_COMPLETED)
                    finish(done)
                under_way.add(pool.submit(one, number[sql], sql))
            asked.append((query_id, side, number[sql]))
        finish(under_way)
        alone = {n for n, (status, _) in outcome.items() if status == TIMEOUT and workers > 1}
        for sql, n in number.items():
            if n in alone:
                finish([pool.submit(one, n, sql, "-again")])
    kind = "string" if asked and isinstance(asked[0][0], str) else "long"
    outcomes = spark.createDataFrame([(q, s, n, *outcome[n]) for q, s, n in asked], f"query_id {kind}, side int, n long, status string, error string")
    good = outcomes.filter(F.col("status") == RESULT).select("query_id", "side", "n")
    rows = spark.createDataFrame([], ROWS)
    for at, some in ((f"{base}/rows", set(outcome) - alone), (f"{base}/rows-again", alone)):
        if any(outcome[n][0] == RESULT for n in some):
            rows = rows.unionByName(spark.read.schema(ROWS).option("basePath", at).parquet(at))
    # rows stay where they lie: a shuffle by statement would put all rows of one into one task
    return rows.join(F.broadcast(good), "n").select("query_id", "side", "row_id", "cells"), outcomes.drop("n")


def try_sql(spark: SparkSession, sql: str, run: bool = True, most_rows: int = 1000, seconds: float = SECONDS) -> tuple[str, object]:
    """('result', rows), or ('exception' or 'timeout', message); analysed only, if not ``run``.

    A result of more than ``most_rows`` rows stays distributed: it is given as the DataFrame.
    """
    found: list = []

    def work() -> None:
        if not reads_only(sql):
            raise ValueError("not a query")
        df = spark.sql(sql)
        rows = [tuple(r) for r in df.limit(most_rows + 1).collect()] if run else df.columns
        found.append(rows if len(rows) <= most_rows else df)

    with Clock(spark, seconds) as clock:
        status, error = clock.run(work)
    return status, found[0] if status == RESULT else error
