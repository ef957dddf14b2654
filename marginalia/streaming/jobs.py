"""Structured Streaming jobs over append-only logs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from marginalia.operators.logs import COUNTED, TERMINAL
from marginalia.sources.store import Store


def read_events(spark, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; times become timestamps, which watermarks need."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def tail_events(stream: DataFrame, run_id: str | None = None) -> DataFrame:
    """Events in the order they come, marked where a run ends; the checkpoint of the sink is the cursor."""
    rows = stream.where(F.col("run_id") == run_id) if run_id else stream
    return rows.withColumn("terminal", F.col("state").isin(*TERMINAL))


def tail_to_end(stream: DataFrame, order: str = "event_id") -> DataFrame:
    """Each run's events in their order up to the first that ends it, that one included; what comes after it is left out."""

    def tail(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            return
        rows = pd.concat(list(parts)).sort_values(order)
        ends = rows["state"].isin(TERMINAL).to_numpy()
        if ends.any():
            state.update((True,))
            rows = rows.iloc[: int(ends.argmax()) + 1]
        yield rows

    return stream.groupBy("run_id").applyInPandasWithState(tail, stream.schema, "ended boolean", "append", GroupStateTimeout.NoTimeout)


def dedupe_usage(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Each usage event once by its idempotency key, as long as copies come within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily_budget_stream(stream: DataFrame, by: list[str], amount: str, at: str, limit: float, late: str = "1 day", status: str | None = None) -> DataFrame:
    """Spend of each day, kept current; usage may come `late`. The limit is reached at the amount itself.

    With a status column only exact and local_zero costs count, as estimates do not.
    """
    rows = stream.where(F.col(status).isin(*COUNTED)) if status else stream
    days = rows.withWatermark(at, late).groupBy(F.window(at, "1 day"), *by).agg(F.sum(amount).alias("spend"))
    return days.select(*by, F.col("window.start").alias("day"), "spend", (F.col("spend") >= limit).alias("over"))


def keep_current(updates: DataFrame, store: Store, table: str, key: list[str], checkpoint: str) -> DataFrame:
    """Run a stream in update mode up to what is there now, its rows put into a store's table by key; returns the table.

    Update mode emits only what a batch has changed, and the watermark drops the state of days that are over, so state stays
    bounded. A batch that is repeated after a failure has the same number and changes nothing.
    """

    def put(rows: DataFrame, number: int) -> None:
        store.change(f"stream:{table}", number, {table: (rows, key)})

    query = updates.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read(table)


class PendingUpdates(StatefulProcessor):
    """Counts the documents of a workspace that wait for an update, and judges each as it comes."""

    def __init__(self, order: str, threshold: int, most: int, warning: float, automatic: bool):
        self.order, self.threshold, self.most, self.warning, self.automatic = order, threshold, most, warning, automatic

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "pending long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.pending.get()[0] if self.pending.exists() else 0
        events = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        done = events["completed"].fillna(False).to_numpy(bool)
        since = np.cumsum(done)  # how many completions there have been: each begins a count of its own
        place = np.arange(1, len(events) + 1)
        start = np.concatenate([[0], place[done]])[since]
        pending = np.where(done, 0, place - start + np.where(since == 0, held, 0))
        dear = ~done & (self.warning > 0) & (events["cost"].astype(float).fillna(0.0).to_numpy() >= self.warning)
        conditions = [done, pending > self.most, dear, self.automatic & (pending >= self.threshold)]
        action = np.select(conditions, ["reset", "confirmation_required", "confirmation_required", "queue"], "none")
        reason = np.select(conditions, ["completed", "maximum_documents_exceeded", "cost_warning", "threshold_reached"], "manual_update_required")
        self.pending.update((int(pending[-1]),))
        yield pd.DataFrame({"workspace": key[0], "at": events[self.order].to_numpy(), "action": action, "reason": reason, "pending": pending, "cost_warning": dear & (action != "queue")})

    def close(self) -> None:
        pass


def pending_updates(stream: DataFrame, by: str, order: str, cost: str, completed: str | None = None, threshold: int = 10, most: int = 100, warning: float = 0.0, automatic: bool = True) -> DataFrame:
    """What each document that comes means for its workspace (workspace, at, action, reason, pending, cost_warning).

    The documents that wait are counted. Over `most` of them, an update must be confirmed; so it must where the document's
    own estimate of its cost reaches `warning` (0: never); at the threshold one is queued, if updates are automatic; else
    nothing is done. An event for which `completed` is true tells that an update has been made, and the count begins anew.
    A batch's events are taken in their order; a null cost is 0.
    """
    rows = stream.select(F.col(by), F.col(order), F.col(cost).cast("double").alias("cost"), (F.col(completed) if completed else F.lit(False)).alias("completed"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    processor = PendingUpdates(order, threshold, most, warning, automatic)
    out = f"workspace {kinds[by]}, at {kinds[order]}, action string, reason string, pending long, cost_warning boolean"
    return rows.groupBy(by).transformWithStateInPandas(processor, out, "append", "none")


class RunStates(StatefulProcessor):
    """The state of a run and when it was told; a timer ends runs that say nothing more."""

    def __init__(self, wait: int):
        self.wait = wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "state string, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, at = self.told.get() if self.told.exists() else ("", 0)
        news = pd.concat(list(rows)).sort_values("at", kind="stable")
        ms = news["at"].astype("datetime64[ms]").astype("int64")
        news, ms = news[ms >= at], ms[ms >= at]  # news older than the last is none
        if len(news):
            changed = news[news["state"] != news["state"].shift(fill_value=last)]
            last, at = news["state"].iloc[-1], int(ms.iloc[-1])
            if len(changed):
                yield pd.DataFrame({"run_id": key[0], "state": changed["state"].to_numpy(), "at": changed["at"].to_numpy()})
        self.told.update((last, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last in ("running", "cancelling"):
            self.handle.registerTimer(max(at + self.wait, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.told.get()[1]
        self.told.clear()
        yield pd.DataFrame({"run_id": [key[0]], "state": ["interrupted"], "at": [pd.Timestamp(at + self.wait, unit="ms")]})

    def close(self) -> None:
        pass


def run_states(stream: DataFrame, stale: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """State changes of runs (run_id, state, at); a run without news for `stale` while running or cancelling is interrupted."""
    kind = stream.schema["run_id"].dataType.simpleString()
    watched = stream.withWatermark("at", late)
    processor = RunStates(int(pd.Timedelta(stale).total_seconds() * 1000))
    return watched.groupBy("run_id").transformWithStateInPandas(processor, f"run_id {kind}, state string, at timestamp", "append", "eventTime")


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that typed state needs, for the queries that start within."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def state_of(spark: SparkSession, checkpoint: str, variable: str) -> DataFrame:
    """What a stopped query's state variable holds, by key, from the state data source."""
    with typed_state(spark):
        rows = spark.read.format("statestore").option("stateVarName", variable).load(checkpoint)
    return rows.select("key.*", "value.*")


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that is there now, written to `path` as Parquet; the next call goes on from the checkpoint."""
    spark = stream.sparkSession
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(path))
    with typed_state(spark):
        query = writer.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
