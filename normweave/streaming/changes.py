"""Triggers over a stream of changes, and statistics of event time as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from normweave.operators import metrics, rules
from normweave.sources.store import discard, stored

CHANGES = f"change_id long, op string, entity_id long, before {rules.IMAGE}, after {rules.IMAGE}, ts timestamp"
#: The tables that a batch of changes is written to.
AUDIT, ACCEPTED, QUARANTINE = "audit", "accepted", "quarantine"


def enforce_batch(changes: DataFrame, table: DataFrame, out: str, number: int) -> None:
    """Judge one batch against the static rules and write its audit rows, accepted and quarantined changes, each in a
    folder of the batch's number. A batch that runs again, after a failure, replaces its own folders and nothing else."""
    audit = stored(rules.fired(changes, table), "fired")
    accepted, blocked = rules.split_changes(changes, audit)
    for name, rows in ((AUDIT, audit), (ACCEPTED, accepted), (QUARANTINE, blocked)):
        rows.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
    discard(audit)


def enforced(spark: SparkSession, path: str, table: DataFrame, out: str, checkpoint: str, files_a_batch: int = 1000) -> StreamingQuery:
    """Follow the change log in Parquet files below path; `table` holds the rules."""
    log = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_a_batch).parquet(path)
    run = lambda batch, number: enforce_batch(batch, table, out, number)
    return log.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stats(stream: DataFrame, at: str, window: Column, late: str, by: list[str], out: str, checkpoint: str,
    value: str = "value", failed: Column | None = None) -> StreamingQuery:
    """metrics.window_stats over a stream, in append mode: a window is written once, when the watermark has passed its end, to
    Parquet. Rows that come later than `late` after the latest seen are left out of windows already written."""
    rows = metrics.window_stats(stream.withWatermark(at, late), window, by, value, failed)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
