"""Reading documents and registries, writing artifacts and graphs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from normweave.functions.text import doc_key, hash_suffix
from normweave.operators import artifacts, structure

#: Document types by file extension.
TYPES = {"pdf": "pdf", "docx": "docx", "md": "markdown", "markdown": "markdown", "html": "html", "htm": "html"}


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, ext, document_type, content, hash) of all files below path; document_type is null for others."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    kinds = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    files = files.withColumns({"stem": F.regexp_replace(name, r"\.[^.]*$", ""), "ext": F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))})
    return files.select("path", "stem", "ext", F.element_at(kinds, F.col("ext")).alias("document_type"), "content", F.sha2("content", 256).alias("hash"))


def supported(files: DataFrame) -> DataFrame:
    return files.where(F.col("document_type").isin("markdown", "html", "docx"))


def rejected(files: DataFrame) -> DataFrame:
    """Files of an unsupported format, with the reason. PDF needs a parser that isn't part of this library."""
    return files.where(~F.coalesce(F.col("document_type").isin("markdown", "html", "docx"), F.lit(False))).select("path",
        F.concat(F.lit("Unsupported format: ."), "ext").alias("reason"))


def documents(files: DataFrame, as_of: Column) -> DataFrame:
    """Document metadata; ids end in hex of the content's hash, so that a file keeps its id."""
    key = doc_key(F.col("stem"))
    return files.select(F.concat(key, F.lit("_"), hash_suffix(F.col("content"), 6)).alias("doc_id"), key.alias("doc_key"),
        F.col("path").alias("source_file"), as_of.alias("ingestion_timestamp"), "document_type",
        F.lit(None).cast("int").alias("page_count"), F.lit("en").alias("language"), "hash", "content")


UNTITLED = "Untitled Section"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _docx_paragraphs(content: bytes) -> list[tuple[int, str]]:
    """(heading level or 0, text) of each paragraph."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        level = re.fullmatch(r"Heading\s*(\d+)", name)
        out.append((min(6, max(1, int(level[1]))) if level else int(name.startswith("Heading")), "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()))
    return out


def docx_sections(files: DataFrame) -> DataFrame:
    """(doc_id, doc_key, section_ord, section_title, hierarchy_level, text, problem): DOCX files cut at their headings.
    Text before the first heading gets the title of an untitled section. A damaged file gives one row that states
    the problem and nothing else."""

    def cut(parts: list[tuple[int, str]]) -> list[tuple[str, int, list[str]]]:
        found: list[tuple[str, int, list[str]]] = []
        for level, text in parts:
            if level:
                found.append((text, level, []))
            elif text:
                if not found:
                    found.append((UNTITLED, 1, []))
                found[-1][2].append(text)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, key, content in zip(batch["doc_id"], batch["doc_key"], batch["content"]):
                try:
                    found = cut(_docx_paragraphs(content))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, ValueError) as e:
                    rows.append((doc, key, None, None, None, None, f"Damaged file: {type(e).__name__}"))
                    continue
                rows += [(doc, key, n, title, level, "\n\n".join(body), None) for n, (title, level, body) in enumerate(found, 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "doc_key", "section_ord", "section_title", "hierarchy_level", "text",
                    "problem"]).astype({"section_ord": "Int32", "hierarchy_level": "Int32"})

    return files.select("doc_id", "doc_key", "content").mapInPandas(run,
        "doc_id string, doc_key string, section_ord int, section_title string, hierarchy_level int, text string, problem string")


def damaged(docs: DataFrame) -> DataFrame:
    """(path, reason) of DOCX documents that can't be read."""
    own = docs.where("document_type = 'docx'")
    broken = docx_sections(own).where("problem IS NOT NULL").select("doc_id", F.col("problem").alias("reason"))
    return own.select("doc_id", F.col("source_file").alias("path")).join(broken, "doc_id").select("path", "reason")


def _with_ids(sections: DataFrame) -> DataFrame:
    rows = structure.parents(sections)
    of = lambda n: structure.section_id(F.col("doc_key"), n)
    return rows.select("doc_id", of(F.col("section_ord")).alias("section_id"), "section_ord", "section_title", "hierarchy_level",
        F.when(F.col("parent_ord").isNotNull(), of(F.col("parent_ord"))).alias("parent_section"), "text")


def sections_of(docs: DataFrame) -> DataFrame:
    """Sections of documents of all supported formats; blank and damaged documents have none."""
    decoded = docs.withColumn("text", F.decode("content", "UTF-8"))
    md = decoded.where("document_type = 'markdown'").select("doc_id", "doc_key", "text")
    pages = decoded.where("document_type = 'html'")
    html = structure.html_sections(pages, "doc_id", "text", keep=("doc_key",))
    docx = docx_sections(docs.where("document_type = 'docx'")).where("problem IS NULL").drop("problem")
    return structure.markdown_sections(md).unionByName(_with_ids(html)).unionByName(_with_ids(docx))


REGISTRY = "registry_version string, schemas array<struct<schema_id:string,schema_type:string,version:string,tables:array<struct<table_name:string,description:string,fields:array<struct<field_name:string,field_type:string,semantic_labels:array<string>,description:string>>>>>>, synonyms map<string,array<string>>, manual_overrides map<string,string>"


def registry_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fields, synonyms and overrides of a registry file in JSON, with the places of all entries."""
    doc = spark.read.schema(REGISTRY).json(path, multiLine=True)
    tables = doc.select(F.posexplode("schemas").alias("schema_ord", "s")).select("schema_ord", "s.schema_id", F.posexplode("s.tables").alias("table_ord", "t"))
    fields = tables.select("schema_ord", "table_ord", "schema_id", "t.table_name", F.posexplode("t.fields").alias("field_ord", "f"))
    fields = fields.select("schema_ord", "table_ord", "field_ord", "schema_id", "table_name", "f.field_name", "f.field_type",
        F.coalesce("f.semantic_labels", F.array().cast("array<string>")).alias("labels"), "f.description")
    synonyms = doc.select(F.posexplode(F.map_entries("synonyms")).alias("ord", "e")).select("ord", F.col("e.key").alias("term"),
        F.posexplode("e.value").alias("syn_ord", "synonym"))
    overrides = doc.select(F.explode(F.map_entries("manual_overrides")).alias("e")).select(F.lower("e.key").alias("entity_lower"),
        F.col("e.value").alias("target_path"))
    return fields, synonyms, overrides


def save_registry(fields: DataFrame, synonyms: DataFrame, overrides: DataFrame, path: str, version: str = "1", schema_type: str = "sql") -> None:
    """The tables of a registry as the JSON that registry_tables reads; a registry is configuration, so it is one row."""
    field = F.struct("field_ord", F.struct("field_name", "field_type", F.col("labels").alias("semantic_labels"), "description").alias("x"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["x"])
    tables = fields.groupBy("schema_ord", "schema_id", "table_ord", "table_name").agg(ordered(field).alias("fields"))
    table = F.struct("table_ord", F.struct("table_name", F.lit(None).cast("string").alias("description"), "fields").alias("x"))
    schemas = tables.groupBy("schema_ord", "schema_id").agg(ordered(table).alias("tables"))
    schema = F.struct("schema_ord", F.struct("schema_id", F.lit(schema_type).alias("schema_type"), F.lit(version).alias("version"), "tables").alias("x"))
    terms = synonyms.groupBy("ord", "term").agg(F.transform(F.array_sort(F.collect_list(F.struct("syn_ord", "synonym"))), lambda s: s["synonym"]).alias("s"))
    names = terms.agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term", "s"))),
                lambda x: F.struct(x["term"], x["s"]))).alias("synonyms"))
    manual = overrides.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_lower", "target_path")))).alias("manual_overrides"))
    one = schemas.agg(ordered(schema).alias("schemas")).crossJoin(names).crossJoin(manual)  # one row each
    one.select(F.lit(version).alias("registry_version"), "schemas", "synonyms", "manual_overrides").coalesce(1).write.mode("overwrite").json(path)


def templates_in(spark: SparkSession, path: str) -> dict[str, dict[str, artifacts.Renderer]]:
    """Renderers from files <path>/<format>/<clause type>.txt, in the language of artifacts.from_text; `default.txt` serves the
    types without a file, and without it a clause of such a type is an error. Templates are configuration and come to the driver."""
    found: dict[str, dict[str, artifacts.Renderer]] = {}
    for r in spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path).select("value",
        F.input_file_name().alias("path")).collect():
        folder, name = r["path"].split("/")[-2:]
        found.setdefault(folder, {})[name.partition(".")[0]] = artifacts.from_text(r["value"])
    return found


def write_artifacts(rows: DataFrame, path: str) -> None:
    """Artifacts in a folder for each format, replacing what stood there; file_path says where each belongs by
    document and clause, and doc_id orders the rows, so one document's artifacts lie together."""
    rows.sortWithinPartitions("format", "doc_id", "artifact_id").write.mode("overwrite").partitionBy("format").parquet(path)


def merged_metadata(system: Column, user: Column) -> Column:
    """Maps of both; the user's values win. Text that isn't a JSON object counts as empty."""
    parsed = F.coalesce(F.from_json(user, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(system, lambda k, _: ~F.array_contains(F.map_keys(parsed), k)), parsed)
