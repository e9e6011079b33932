"""The one stream: ingested chunks to validated artifacts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

CHUNKS = "doc_id string, section_id string, chunk_id string, text string, hash string, ingested_at timestamp"


def ingested(spark: SparkSession, path: str, late: str = "1 hour") -> DataFrame:
    """Chunks from Parquet files as they come. A chunk whose hash came within `late` before is a repeat and goes."""
    return spark.readStream.schema(CHUNKS).parquet(path).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["chunk_id", "hash"])


def validated(chunks: DataFrame, compile_batch: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Run each micro-batch through compile_batch. A batch writes its own folder, so that a repeated one replaces
    itself and results stand once."""

    def write(batch: DataFrame, number: int) -> None:
        compile_batch(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
