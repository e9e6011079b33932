"""What the stages hand on as JSON: one object a line, one line a document (or artifact, or validation), in and out.

The nested forms group a document's rows, so that a document is one object; reading flattens them again. All files are
written and read by Spark, one part a task. Null parts stay in place as nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_NULLS = {"ignoreNullFields": "false"}
_CHUNK = "struct<chunk_id:string,text:string,token_count:int,embedding_vector:array<float>>"
_SECTION = f"struct<section_id:string,section_title:string,parent_section:string,hierarchy_level:int,text_chunks:array<{_CHUNK}>>"
_ENTITY = "struct<entity:string,qualifiers:array<string>>"
_CLAUSE = f"struct<clause_id:string,source_chunk_id:string,source_text:string,type:string,actor:{_ENTITY},action:struct<verb:string,modifiers:array<string>>,object:{_ENTITY},condition:struct<trigger:string,temporal:string>,temporal_scope:struct<deadline:string,frequency:string,duration:string>,cross_references:array<string>,confidence:double>"
#: Schemas of the objects, by stage.
SCHEMAS = {
    "documents": f"doc_id string, metadata map<string,string>, sections array<{_SECTION}>",
    "clauses": f"doc_id string, parse_timestamp string, clauses array<{_CLAUSE}>",
    "mappings": "clause_id string, mapping_status string, mapped_entities array<struct<role_ord:int,source_role:string,source_entity:string,target_path:string,target_schema:string,confidence:double,mapping_method:string>>, "
    "unmapped_entities array<struct<role_ord:int,source_role:string,entity:string,reason:string,suggestions:array<struct<target_path:string,confidence:double>>>>",
    "artifacts": "artifact_id string, clause_id string, doc_id string, format string, content string, file_path string, template_used string, type string, actor string, verb string, severity string, mapping_confidence double",
    "validations": "trace_id string, clause_id string, artifact_id string, format string, type string, validation_status string, confidence_score double, validation_checks array<struct<check_name:string,passed:boolean,message:string>>, "
    "review_flags array<string>, lineage struct<document_id:string,section_id:string,chunk_id:string,clause_id:string,mapping_id:string,artifact_id:string,lineage_section_id_compat:string>",
}


def write_json(rows: DataFrame, path: str, mode: str = "error") -> None:
    """A line for each row, nulls kept; gzipped, for names and messages repeat in every line. A task's part is one file."""
    rows.write.mode(mode).option("ignoreNullFields", "false").option("compression", "gzip").json(path)


def read_json(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The objects of a stage; a file that isn't JSON fails the read."""
    return spark.read.schema(SCHEMAS[stage]).option("mode", "FAILFAST").json(path)


def as_json(rows: DataFrame) -> Column:
    """A row's JSON text, for a column instead of a file."""
    return F.to_json(F.struct(*rows.columns), _NULLS)


def ingested(sections: DataFrame, chunks: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Sections and their chunks as one object a document; metadata (doc_id, metadata map) may be added."""
    own = chunks.groupBy("doc_id", "section_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_ord", "chunk_id", "text", "token_count"))).alias("c")
    )
    no_chunks = F.array().cast(f"array<{_CHUNK}>")
    texts = F.transform("c", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["text"].alias("text"),
            c["token_count"].alias("token_count"), F.lit(None).cast("array<float>").alias("embedding_vector")))
    rows = sections.drop("text").join(own, ["doc_id", "section_id"], "left").withColumn("text_chunks", F.coalesce(texts, no_chunks))
    of = F.struct("section_ord", F.struct("section_id", "section_title", "parent_section", "hierarchy_level", "text_chunks").alias("s"))
    docs = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(of)), lambda x: x["s"]).alias("sections"))
    if metadata is None:
        return docs.select("doc_id", F.lit(None).cast("map<string,string>").alias("metadata"), "sections")
    return docs.join(metadata.select("doc_id", "metadata"), "doc_id", "left").select("doc_id", "metadata", "sections")


def sections_in(documents: DataFrame) -> DataFrame:
    """Objects of `ingested` back to sections (doc_id, section_id, section_ord, …) without text."""
    rows = documents.select("doc_id", F.posexplode("sections").alias("pos", "s"))
    return rows.select("doc_id", "s.section_id", (F.col("pos") + 1).alias("section_ord"), "s.section_title", "s.hierarchy_level", "s.parent_section")


def chunks_in(documents: DataFrame) -> DataFrame:
    """Objects of `ingested` back to chunks."""
    rows = documents.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.section_id", F.posexplode("s.text_chunks").alias("chunk_ord", "c"))
    return rows.select("doc_id", "section_id", "c.chunk_id", "chunk_ord", "c.text", "c.token_count")


def parsed_out(nested: DataFrame, as_of: Column) -> DataFrame:
    """Clauses of clauses.nested as one object a document."""
    rows = nested.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in nested.columns if c != "doc_id"]))).alias("clauses"))
    return rows.select("doc_id", as_of.cast("string").alias("parse_timestamp"), "clauses")


def parsed_in(collections: DataFrame) -> DataFrame:
    """Objects of `parsed_out` back to flat clauses, as mapping and validation take them."""
    c = collections.select("doc_id", F.explode("clauses").alias("c")).select("doc_id", "c.*")
    section = F.regexp_replace("source_chunk_id", r"_C\d+$", "")
    return c.select(
        "doc_id", section.alias("section_id"), F.col("source_chunk_id").alias("chunk_id"), "clause_id", "source_text", "type",
            F.col("actor.entity").alias("actor"), F.col("action.verb").alias("verb"),
        F.col("object.entity").alias("object"), F.col("condition.trigger").alias("trigger"), "temporal_scope.deadline",
            "temporal_scope.duration", "temporal_scope.frequency", "confidence", "cross_references",
    )


def raw_text(texts: DataFrame, chunk_id: str = "RAW", doc_id: str = "RAW") -> DataFrame:
    """(text, and maybe doc_id) to chunks: each whole text is one chunk of one section."""
    key = F.col("doc_id").cast("string") if "doc_id" in texts.columns else F.lit(doc_id)
    section = F.concat(key, F.lit("_S001"))
    return texts.select(key.alias("doc_id"), section.alias("section_id"), F.concat(section, F.lit(f"_{chunk_id}")).alias("chunk_id"),
        F.lit(0).alias("chunk_ord"), F.coalesce("text", F.lit("")).alias("text"))
