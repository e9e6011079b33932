"""Events of the five stages: a row for each object with its topic, key and JSON, in a folder that streams can follow.

The folder stands for a message broker, for which no connector is at hand; a broker's sink would take the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from normweave.sources.stages import as_json

#: The topics of the stages, in order.
TOPICS = ("policy.ingested", "policy.parsed", "policy.mapped", "policy.compiled", "policy.validated")
EVENT = "topic string, key string, value string, at timestamp"


def by_document(rows: DataFrame, doc_id: Column, name: str, apart: tuple[str, ...] = ()) -> DataFrame:
    """Rows as one object a document: (doc_id, name array of structs, ordered as structs are, without the columns apart)."""
    return rows.select(doc_id.alias("__doc"),
        F.struct(*[c for c in rows.columns if c not in apart]).alias("__row")).groupBy("__doc").agg(F.array_sort(F.collect_list("__row")).alias(name)).withColumnRenamed("__doc", "doc_id")


def events(objects: DataFrame, topic: str, at: Column, key: str = "doc_id") -> DataFrame:
    """(topic, key, value, at): each object as an event."""
    if topic not in TOPICS:
        raise ValueError(f"no such topic: {topic}")
    return objects.select(F.lit(topic).alias("topic"), F.col(key).alias("key"), as_json(objects).alias("value"), at.cast("timestamp").alias("at"))


def publish(rows: DataFrame, path: str) -> None:
    """Add events to the folder; a job that runs again adds them again, so followers drop repeats. Their JSON repeats names and
    texts, which zstd finds within a page."""
    rows.write.mode("append").option("compression", "zstd").option("parquet.page.size", 1 << 20).partitionBy("topic").parquet(path)


def follow(spark: SparkSession, path: str, topic: str, schema: str, late: str = "1 hour") -> DataFrame:
    """The topic's objects as a stream (key, at, *schema), each event once within `late`."""
    rows = spark.readStream.schema(EVENT).parquet(path).where(F.col("topic") == topic).withColumn("digest", F.xxhash64("value"))
    once = rows.withWatermark("at", late).dropDuplicatesWithinWatermark(["key", "digest"])
    return once.select("key", "at", F.from_json("value", schema).alias("v")).select("key", "at", "v.*")
