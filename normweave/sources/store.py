"""Tables written once in the shared scratch folder, so that later steps neither recompute them nor depend on the
executors that made them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Where that is unset, a local session gets a temporary
    folder; on a cluster that is an error, for executors on other machines could not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="normweave-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/normweave-{spark.sparkContext.applicationId}"


def _fs_path(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, which goes when the driver ends."""
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    fs, jvm_path = _fs_path(spark, path)
    fs.deleteOnExit(jvm_path)
    return path


def stored(df: DataFrame, name: str, level: int = 3, page_mb: int = 1, rows: int = 0) -> DataFrame:
    """Write df as Parquet in the scratch folder and read it back. `level` is that of zstd; what it finds alike must lie
    in one page. rows: the most of a file, 0 for no bound; a task that reads them has rows in proportion."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", rows).option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", page_mb << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def expected_bytes(df: DataFrame) -> int:
    """The size that the optimizer expects of df, for a table read from files that of the files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many tasks as there are cores. Rows that grow in the steps to come, such as documents that are
    cut into clauses, would otherwise stay in the few splits that they are read in. Where the optimizer expects enough
    splits, nothing is shuffled."""
    spark = df.sparkSession
    cores, split = spark.sparkContext.defaultParallelism, spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df if expected_bytes(df) >= cores * split else df.repartition(cores, key)


def tasks_of(df: DataFrame, rows: int) -> int:
    """How many tasks of about `rows` rows df makes. Dealt to so many by a key, what groups by the key later neither shuffles again
    nor holds more than such a task makes of its rows. df is counted, so it should be stored."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def grows(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast. The optimizer takes a table for as big as its compressed files, even
    after rows were multiplied; a side that grows with the input would then pass whole through the driver."""
    return df.hint("merge")


def discard(*tables: DataFrame) -> None:
    """Delete tables made by stored that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        root = re.sub(r"^\w+:/*", "", scratch(spark)).lstrip("/")
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            if f"/{root}/" in folder:
                fs, jvm_path = _fs_path(spark, folder)
                fs.delete(jvm_path, True)
