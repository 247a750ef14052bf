"""Strategies kept up to date by a stream of their uses: state by strategy, each batch put in once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.store import StrategyStore
from ..shipping import ship
from ..staging import staged

STATE = "uses long, successes long, late long, last_ms long"
CHANGED = "strategy_id string, uses long, successes long, late long, success_rate double, is_active boolean"
#: The state store that such processors need.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Uses(StatefulProcessor):
    """Of each strategy the uses and successes so far; one that is not used for ``idle_ms`` of event time becomes inactive.

    A use that is older than the watermark is counted as late and in nothing else. What was
    counted stays when a strategy becomes inactive, and its next use makes it active again.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("uses", STATE)

    def _known(self) -> list[int]:
        return list(self.state.get()) if self.state.exists() else [0, 0, 0, 0]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        uses, successes, late, last = self._known()
        mark = timerValues.getCurrentWatermarkInMs()
        for f in rows:
            ms = f["ts_ms"].to_numpy()
            fresh = ms >= mark
            uses += int(fresh.sum())
            successes += int(f["success"].to_numpy()[fresh].sum())
            late += int((~fresh).sum())
            last = max(last, int(ms[fresh].max()) if fresh.any() else last)
        self.state.update((uses, successes, late, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if uses:
            self.handle.registerTimer(last + self.idle_ms)
        yield self._row(key, uses, successes, late, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        uses, successes, late, _ = self._known()
        yield self._row(key, uses, successes, late, False)

    def _row(self, key, uses: int, successes: int, late: int, active: bool) -> pd.DataFrame:
        return pd.DataFrame({"strategy_id": [key[0]], "uses": [uses], "successes": [successes], "late": [late], "success_rate": [successes / uses if uses else 0.0], "is_active": [active]})

    def close(self) -> None:
        pass


def strategy_uses(uses: DataFrame, lateness: str = "1 day", idle: str = "30 days") -> DataFrame:
    """A stream of (strategy_id, success, ts) -> CHANGED: in each batch the strategies that it, or the time, changed.

    Needs the state store PROVIDER. Time is that of the rows; it is known up to the watermark, ``lateness`` before the latest row.
    """
    spark = ship(uses.sparkSession)
    spark.conf.set(*PROVIDER)
    rows = uses.withColumn("ts", F.col("ts").cast("timestamp")).select(F.col("strategy_id").cast("string").alias("strategy_id"), "success", "ts", F.unix_millis("ts").alias("ts_ms")).withWatermark("ts", lateness)
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    return rows.groupBy("strategy_id").transformWithStateInPandas(Uses(idle_ms), CHANGED, "Update", "EventTime")


def keep_up(uses: DataFrame, store: StrategyStore, checkpoint: str, source: str = "uses", at: str = "1970-01-01", **options) -> StreamingQuery:
    """Process what is there, then stop: rates, uses and activity of known strategies go into the store, batch by batch.

    Every batch is one commit that bears the source and the batch's number: a batch that is run
    again, because its commit was not noted before a failure, changes nothing.
    """

    def put(batch: DataFrame, number: int) -> None:
        changed = batch.select("strategy_id", F.col("success_rate").alias("__rate"), F.col("uses").alias("__uses"), F.col("is_active").alias("__active"))
        changed = staged(changed, "batch")  # a batch that is in already has to be read whole as well: its state is kept then
        known = store.table("strategies").join(changed, "strategy_id")
        new = known.withColumns({"success_rate": F.col("__rate"), "sample_count": F.col("__uses"), "is_active": F.col("__active")}).drop("__rate", "__uses", "__active")
        store.put(new, at, (source, number))

    found = strategy_uses(uses, **options)
    return found.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).foreachBatch(put).start()
