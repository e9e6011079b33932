"""States of jobs from their events, as a stream with timers and as a batch.

An event is (job_id, event_id, kind, at). Events count in the order of (at, event_id), whatever order they come in, and
repeated event ids once. A job is pending, from its first `started` on processing, and ends at its first `completed` or
`failed`, or, where no event follows for IDLE, as timed_out at that time; later events change nothing. Other kinds keep
a job alive. Events without a job, an id or a time are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The states of a job.
PENDING, PROCESSING, COMPLETED, FAILED, TIMED_OUT = "pending", "processing", "completed", "failed", "timed_out"
STARTED, ENDS = "started", (COMPLETED, FAILED)
IDLE, LATE = "2 hours", "1 hour"
ENDED = "job_id long, status string, ended_at timestamp, n_events long"
_ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def usable(events: DataFrame) -> DataFrame:
    return events.select("job_id", "event_id", "kind", F.col("at").cast("timestamp").alias("at")).where("job_id IS NOT NULL AND event_id IS NOT NULL AND at IS NOT NULL")


def states(events: DataFrame, horizon: Column, idle: str = IDLE) -> DataFrame:
    """(job_id, status, ended_at, n_events) of all jobs as known at `horizon`: windows over each job's events. Of repeated ids the
    earliest row counts; ended_at is null for jobs that go on."""
    wait = F.expr(f"INTERVAL {idle}")
    once = usable(events).groupBy("job_id", "event_id").agg(F.min(F.struct("at", F.coalesce("kind", F.lit("")).alias("kind"))).alias("e")).select("job_id", "event_id", "e.*")
    order = W.partitionBy("job_id").orderBy("at", "event_id")
    rows = once.withColumn("silent", F.coalesce(F.col("at") > F.lag("at").over(order) + wait, F.lit(False)))
    ended = F.max(F.col("kind").isin(*ENDS)).over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("over", F.coalesce(ended, F.lit(False)) | F.max("silent").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    alive = ~F.col("over")
    last = F.max(F.when(alive, F.struct("at", "event_id", "kind"))).alias("last")
    jobs = rows.groupBy("job_id").agg(last, F.count_if(alive).alias("n_events"), F.max(alive & (F.col("kind") == STARTED)).alias("started"), F.max("silent").alias("silent"))
    late = F.col("silent") | (F.col("last.at") + wait <= horizon)
    done = F.col("last.kind").isin(*ENDS)
    status = F.when(done, F.col("last.kind")).when(late, TIMED_OUT).when(F.col("started"), PROCESSING).otherwise(PENDING)
    return jobs.select("job_id", status.alias("status"), F.when(done, F.col("last.at")).when(late, F.col("last.at") + wait).alias("ended_at"), "n_events")


class _Job(StatefulProcessor):
    """Buffers a job's events until the watermark has passed them, then takes them in order; a timer waits for the next one."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "event_id long", "at long, kind string")
        self.job = handle.getValueState("job", "last long, n long, status string")
        self.seen = handle.getMapState("seen", "event_id long", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.job.exists() and self.job.get()[2] not in ("", None)
        for batch in rows:
            if done:
                continue
            for event, kind, at in zip(batch["event_id"], batch["kind"], batch["at"], strict=True):
                us = pd.Timestamp(at).value // 1000
                if self.seen.containsKey((int(event),)):
                    continue
                if self.waiting.containsKey((int(event),)) and self.waiting.getValue((int(event),)) <= (us, kind or ""):
                    continue
                self.waiting.updateValue((int(event),), (us, kind or ""))
                self.handle.registerTimer(us // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last, n, status = self.job.get() if self.job.exists() else (None, 0, "")
        if status:
            return iter(())
        ended = None
        ready = sorted((at, event[0], kind) for event, (at, kind) in self.waiting.iterator() if at < now)
        for at, event, kind in ready:
            if last is not None and at > last + self.idle:
                break
            last, n = at, n + 1
            self.waiting.removeKey((event,))
            self.seen.updateValue((event,), (at,))
            if kind in ENDS:
                status, ended = kind, at
                break
        if not status and last is not None and last + self.idle <= now - 1000:
            status, ended = TIMED_OUT, last + self.idle
        if last is not None:
            self.job.update((last, n, status))
        if status:
            self.waiting.clear()
            self.seen.clear()
            return iter([pd.DataFrame({"job_id": [key[0]], "status": [status], "ended_at": [pd.Timestamp(ended, unit="us")], "n_events": [n]})])
        if last is not None:
            self.handle.registerTimer((last + self.idle) // 1000 + 2)
        return iter(())

    def close(self) -> None:
        pass


def ended(events: DataFrame, idle: str = IDLE, late: str = LATE) -> DataFrame:
    """The stream of jobs that ended: a row each, once, when the watermark has passed its end. The state store must be RocksDB
    (see rocks), for timers."""
    idle_us = int(pd.Timedelta(idle).value // 1000)
    rows = usable(events).withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(_Job(idle_us), outputStructType=ENDED, outputMode="Append", timeMode="EventTime")


def rocks(spark) -> None:
    """Let queries that start from now on keep their state in RocksDB."""
    spark.conf.set(*_ROCKS)
