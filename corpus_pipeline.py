"""The corpus pipeline: five operators over documents, each stage written as Parquet and read again.

A stage takes and returns DataFrames, so any stage can be run again from the table before it. All but the last return
the columns of documents, in order, whatever further columns these have and whatever they are called: rows are packed
into one column while a stage works.

| Stage | null text | empty text | very long text | ties, repeated rows | empty table |
|---|---|---|---|---|---|
| quality rules | counts as empty | goes (under ten words) | judged and cleaned whole | each row on its own | empty |
| language ID | goes (`und`) | goes (`und`) | judged whole | judged alike | empty, nothing is learned |
| near copies | counts as empty, copies of each other | the same | compared whole | of a class the least id stays (nulls last), then the least text hash, then the least hash of all columns | empty |
| mixing | has no words, goes | goes | taken in blocks, kept 0 to 2 times whole | of rows equal in id and text a hash of all columns decides who is taken first | empty |
| BPE | no ids, '' decoded | the same | coded whole | each row on its own | empty |

Null ids, languages and sources are values like others, but no row without a language is learned from. Rows that a
stage's rule doesn't name are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from normweave.llm import bpe_lexicon, jaccard_join, language_id, quality_rules, source_mixing
from normweave.llm.common import cut


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Line rules remove poor lines and reject documents that lose too much; n_chars, where there is one, follows."""
    kept = quality_rules.keep_good(docs)
    return kept.withColumn("n_chars", F.length("text").cast(kept.schema["n_chars"].dataType)) if "n_chars" in kept.columns else kept


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID rejects documents without a clear language."""
    return language_id.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return jaccard_join.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix drops or repeats documents towards the sources' target weights."""
    return source_mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encodes what is left and decodes it again, of which the SHA-256 is returned."""
    path = bpe_lexicon.default_path()
    coded = bpe_lexicon.encode(docs.select("doc_id", "lang", "source", "text"), path, bpe_lexicon.build_lexicon(docs, path), decoded="decoded")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality rules", rules), ("language ID", language), ("near copies", near_copies), ("mixing", mixture), ("BPE", tokens)]
#: No SQL expresses the language model, the forest and the merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
