"""Helpers shared by the operators: table reading, lineage cuts and ranks without a single-task sort."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from normweave.sources.store import discard, scratch_path, stored  # noqa: F401


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, name: str, level: int = 3, page_mb: int = 1) -> DataFrame:
    """Write df as Parquet in the shared scratch folder and read it back, so that later steps neither
    recompute it nor depend on the executors that made it. Arrow batches are small while it is written. `level` and
    `page_mb`: of stored; higher for large tables that compress well."""
    spark = df.sparkSession
    before = spark.conf.get(_BATCH_BYTES)
    small_batches(spark)
    try:
        return stored(df, name, level, page_mb)
    finally:
        spark.conf.set(_BATCH_BYTES, before)


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, most: int = 4_000_000) -> None:
    """Let no Arrow batch to Python exceed about `most` bytes (a single longer row goes alone), whatever the rows'
    length. DataFrames are lazy, so where an operator returns one that still has to pass through Python, this stays
    set for the session; what the operators write themselves (cut) runs under it and puts the old value back."""
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH_BYTES))
    if not now or int(now[1]) > most:
        spark.conf.set(_BATCH_BYTES, str(most))


def pack(df: DataFrame, **columns: Column) -> DataFrame:
    """(row, *columns): all columns of df in one struct `row`, so that a work column can't clash with any of them."""
    return df.select(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns: an order for rows that agree in everything an operator reads."""
    return F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in df.schema[n].dataType.simpleString() else c for n in df.columns
            for c in [F.col(f"`{n.replace('`', '``')}`")]])


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dense_positions(df: DataFrame, group: list[str], order: list[str], weight: str | None, out: str, bucket: Column | None = None,
    rows: int | None = None, rows_a_bucket: int = 2_000) -> DataFrame:
    """Add column `out`: the sum of `weight` (None: the number) of the rows of the same group before the row in `order`.

    Buckets that ascend with `order` split each group, so no task sorts a whole group: sums of buckets give each
    bucket's offset, a window inside the bucket the rest. `bucket` may give them; else order[0] must be a long
    spread evenly over 64 bits (a hash), whose top bits make buckets of about rows_a_bucket rows out of `rows`.
    df is read twice and must give the same rows each time (cut it before).
    """
    size = F.col(weight) if weight else F.lit(1)
    if bucket is None:
        bits = (max(1, df.count() if rows is None else rows) // rows_a_bucket).bit_length()
        if not bits:  # one bucket: the window alone does it
            before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
            return df.withColumn(out, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("long"))
        bucket = F.shiftright(F.col(order[0]), 64 - bits)
    df = df.withColumn("__bucket", bucket)
    sums = df.groupBy(*group, "__bucket").agg(F.sum(size).cast("long").alias("__sum"))
    before = W.partitionBy(*group).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(g).alias(f"__o_{g}") for g in group], F.col("__bucket").alias("__o_bucket"),
        F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(*group, "__bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)).cast("long"))
    on = F.col("__bucket") == F.col("__o_bucket")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return df.join(offsets, on).withColumn(out, F.col("__offset") + F.col("__inside")).drop("__bucket", "__o_bucket", "__offset",
        "__inside", *[f"__o_{g}" for g in group])
