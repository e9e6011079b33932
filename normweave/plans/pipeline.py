"""Whole paths through the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from normweave.operators import artifacts, clauses, mapping, structure, validation
from normweave.operators.mapping import Registry
from normweave.sources.store import spread, stored

#: A task reads about thirty small files at most; what it makes of their clauses may have to wait for Python.
CLAUSES_A_FILE = 20_000


def ingest(docs: DataFrame) -> DataFrame:
    """Markdown documents (doc_id, doc_key, text) to chunks, spread over the cores by document before they grow."""
    return structure.chunks(structure.markdown_sections(spread(docs, "doc_id")))


def parse_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks to parsed clauses, stored, for the mapping reads them twice; in files that keep the tasks to come small."""
    return stored(clauses.parse(clauses.split_clauses(chunks)).withColumn("cross_references", F.array().cast("array<string>")), "clauses", rows=CLAUSES_A_FILE)


def compile_clauses(parsed: DataFrame, registry: Registry, formats: tuple[str, ...] = ("yaml", "sql"), threshold: float = mapping.THRESHOLD) -> DataFrame:
    """Parsed clauses to validations of all their artifacts.

    A clause and its mappings stay beside its artifacts, so the validation needs no join. The parser finds no cross
    references, so none can be unknown.
    """
    return judge_rules(artifacts.compile_rules(mapping.map_clauses(parsed, registry, threshold), formats, carry=True), formats)


def judge_rules(rules: DataFrame, formats: tuple[str, ...], tasks: int = 0) -> DataFrame:
    """Artifacts with their clauses and mappings beside them to validations; contents are weighed before the check of syntax.

    tasks: deal documents to so many, and leave doc_id beside. Python forgets how rows were dealt, so they are dealt after it, when they
    are narrow.
    """
    checked = artifacts.check_syntax(validation.weigh(rules), formats).withColumn("invalid_refs", F.lit(None).cast("array<string>"))
    return validation.verdicts(checked.repartition(tasks, "doc_id"), keep=("doc_id",)) if tasks else validation.verdicts(checked)


def compile_chunks(chunks: DataFrame, registry: Registry, formats: tuple[str, ...] = ("yaml", "sql"), threshold: float = mapping.THRESHOLD) -> DataFrame:
    """Chunks to validations of all their artifacts."""
    return compile_clauses(parse_chunks(chunks), registry, formats, threshold)


def status_by_type(validations: DataFrame) -> DataFrame:
    return validations.groupBy("type", "validation_status").agg(F.count("*").alias("n"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))
