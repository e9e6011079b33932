"""Validation of artifacts against the clauses they came from: five checks, review flags and a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from normweave.functions.text import hash_suffix
from normweave.operators.artifacts import clause_struct, mapping_struct
from normweave.sources.store import grows

PASS_AT, REVIEW_BELOW, FAIL_BELOW = 0.85, 0.70, 0.50
#: Names of the checks, in order.
CHECKS = ("chain_completeness", "syntax_validity", "confidence_threshold", "semantic_alignment", "cross_reference_integrity")


def _present(test: Column, name: str) -> Column:
    return F.when(~F.coalesce(test, F.lit(False)), name)


def _names(*found: Column) -> Column:
    """An array of those names that are not null. Unlike array_compact, whose lambda is interpreted, it is compiled."""
    return F.array_remove(F.array(*[F.coalesce(n, F.lit("")) for n in found]), "")


def trace_confidence(clause: Column, mappings: Column) -> Column:
    """Mean of the clause's and the mappings' confidences, 0.5 for an absent one; rounded to nine places so that
    means that lie on a threshold compare alike everywhere."""
    n = F.when(mappings.isNotNull(), F.size(mappings)).otherwise(0)
    total = F.aggregate(F.coalesce(mappings, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.5)))
    return F.round((F.coalesce(clause, F.lit(0.5)) + total) / (n + 1), 9)


def validate(artifacts: DataFrame, clauses: DataFrame, mapped: DataFrame, require_complete_chain: bool = True) -> DataFrame:
    """artifacts (artifact_id, clause_id, content, syntax_valid, warnings, …), parsed clauses (clause_id, doc_id,
    section_id, chunk_id, source_text, type, actor, verb, confidence, cross_references) and mapped clauses (clause_id,
    mapped_entities). Left joins on clause_id keep artifacts whose chain is broken.
    """
    c, m = clauses.select("clause_id", clause_struct().alias("c")), mapped.select("clause_id", mapping_struct().alias("m"))
    rows = artifacts.drop("c", "m").join(grows(c), "clause_id", "left").join(grows(m), "clause_id", "left").join(grows(unknown_references(clauses)),
        "clause_id", "left")
    return judge(rows, require_complete_chain)


def unknown_references(clauses: DataFrame) -> DataFrame:
    """(clause_id, invalid_refs): references to clauses that the document lacks."""
    refs = clauses.where(F.size("cross_references") > 0).select("clause_id", F.col("doc_id").alias("ref_doc"), F.explode("cross_references").alias("ref"))
    ids = clauses.select(F.col("clause_id").alias("ref"), F.col("doc_id").alias("ref_doc")).distinct()
    return refs.join(grows(ids), ["ref", "ref_doc"], "left_anti").groupBy("clause_id").agg(F.array_sort(F.collect_set("ref")).alias("invalid_refs"))


def judge(rows: DataFrame, require_complete_chain: bool = True) -> DataFrame:
    """Checks, flags and status of artifacts with their clause (c), mappings (m) and invalid_refs beside them."""
    return verdicts(weigh(rows), require_complete_chain)


def weigh(rows: DataFrame) -> DataFrame:
    """What the verdict asks of content, clause (c) and mappings (m), in place of c and m: what is missing, trace, hits, and the
    clause's ids and type. Before a check of syntax, it keeps them out of the rows that wait for Python."""
    missing = _names(_present(F.col("c").isNotNull(), "parsed_clause"), _present(F.col("m").isNotNull(), "mapped_clause"),
        _present(F.col("artifact_id").isNotNull(), "artifact"))
    lacking = _names(_present(F.col("c").isNull() | (F.col("c.source_text") != ""), "source_text"), _present(F.col("content") != "", "content"))
    low = F.lower("content")
    hits = sum((F.coalesce(low.contains(F.lower(f"c.{n}")) & (F.col(f"c.{n}") != ""), F.lit(False)).cast("int") for n in ("type", "actor", "verb")), F.lit(0))
    return rows.withColumns({
        "missing": F.when(F.size(missing) > 0, missing).otherwise(lacking), "trace": trace_confidence(F.col("c.confidence"), F.col("m.confidences")),
        "hits": hits, "document_id": F.coalesce("c.doc_id", "doc_id"), "section_id": F.col("c.section_id"), "chunk_id": F.col("c.chunk_id"), "type": F.col("c.type"),
    }).drop("c", "m")


def verdicts(rows: DataFrame, require_complete_chain: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Checks, flags and status of weighed artifacts with syntax_valid, warnings and invalid_refs. keep: columns to leave beside."""
    chain, syntax = F.size("missing") == 0, F.coalesce("syntax_valid", F.lit(False))
    confident, aligned, referred = F.col("trace") >= PASS_AT, F.col("hits") >= 1, F.col("invalid_refs").isNull()
    check = lambda n, passed, message: F.struct(F.lit(CHECKS[n]).alias("check_name"), passed.alias("passed"), message.alias("message"))
    checks = F.array(
        check(0, chain, F.when(chain, "all stages present").otherwise(F.concat(F.lit("missing: "), F.array_join("missing", ", ")))),
        check(1, syntax, F.when(syntax & (F.size("warnings") > 0), F.format_string("valid with %d warning(s)",
                        F.size("warnings"))).when(syntax, "valid").otherwise("syntax error")),
        check(2, confident, F.format_string("confidence %.2f, threshold %.2f", F.col("trace"), F.lit(PASS_AT))),
        check(3, aligned, F.format_string("%d of 3 key terms found", F.col("hits"))),
        check(4, referred, F.when(referred, "references resolve").otherwise(F.concat(F.lit("unknown: "), F.array_join("invalid_refs", ", ")))),
    )
    flags = _names(
        F.when(~chain, "incomplete_chain"), F.when(~syntax, "syntax_error"),
        F.when(F.col("trace") < REVIEW_BELOW, "low_confidence").when(F.col("trace") < PASS_AT, "below_threshold"),
        F.when(~aligned, "semantic_drift"), F.when(~referred, "invalid_references"), F.when(F.col("trace") < FAIL_BELOW, "blocked_low_confidence"),
    )
    critical = (~chain | ~syntax) if require_complete_chain else F.lit(False)
    rows = rows.withColumn("validation_checks", checks).withColumn("review_flags", flags)
    status = F.when((F.col("trace") < FAIL_BELOW) | critical, "failed").when(F.size("review_flags") > 0, "needs_review").otherwise("passed")
    return rows.select(
        F.concat(F.lit("TRC_"), hash_suffix(F.col("artifact_id"), 8)).alias("trace_id"), "clause_id", "artifact_id", "format",
            "type", status.alias("validation_status"),
        F.round("trace", 3).alias("confidence_score"), "validation_checks", "review_flags",
        F.struct("document_id", "section_id", "chunk_id", F.col("clause_id"), F.concat(F.lit("map_"), F.col("clause_id")).alias("mapping_id"),
                F.col("artifact_id"), lineage_section(F.col("clause_id")).alias("lineage_section_id_compat")).alias("lineage"), *keep,
    )


def lineage_section(clause_id: Column) -> Column:
    """The part of a clause id up to its first section token, as lineage was once read off the id."""
    return F.nullif(F.regexp_extract(clause_id, r"^(.*?(?:^|_)S\d+)(?=_|$)", 1), F.lit(""))


def summary(validations: DataFrame) -> DataFrame:
    status = F.col("validation_status")
    return validations.agg(F.count("*").alias("total"), *[F.count_if(status == s).alias(s) for s in ("passed", "failed", "needs_review")])


def flag_counts(validations: DataFrame) -> DataFrame:
    """An outer explode, for before a plain one Spark filters by the flags, and finds them, with the syntax check, twice."""
    return validations.select(F.explode_outer("review_flags").alias("flag")).where("flag IS NOT NULL").groupBy("flag").agg(F.count("*").alias("n"))
