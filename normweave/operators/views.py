"""Reports and maintenance over the stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(len(SEVERITIES) + 1)
    for n, s in reversed([*enumerate(SEVERITIES, 1)]):
        rank = F.when(severity == s, n).otherwise(rank)
    return rank


def document_summary(documents: DataFrame, clauses: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Counts of clauses and artifacts of each document. avg_confidence is over joined rows, so a clause weighs as
    often as it has artifacts; avg_clause_confidence counts each clause once. Clauses and artifacts are counted
    before they are joined, so the join doesn't fan out."""
    per_clause = artifacts.groupBy("clause_id").agg(F.count_distinct("artifact_id").alias("n"))
    rows = clauses.join(per_clause, "clause_id", "left").withColumn("w", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)))
    per_doc = rows.groupBy("doc_id").agg(F.count_distinct("clause_id").alias("clause_count"),
        F.sum(F.coalesce("n", F.lit(0))).alias("artifact_count"),
        (F.sum(F.col("confidence") * F.col("w")) / F.sum("w")).alias("avg_confidence"), F.avg("confidence").alias("avg_clause_confidence"))
    return documents.join(per_doc, "doc_id", "left").select(*documents.columns, F.coalesce("clause_count", F.lit(0)).alias("clause_count"),
        F.coalesce("artifact_count", F.lit(0)).alias("artifact_count"), "avg_confidence", "avg_clause_confidence")


def validation_summary(validations: DataFrame) -> DataFrame:
    return validations.groupBy("validation_status").agg(F.count("*").alias("count"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"))


def unresolved(audit: DataFrame, as_of: Column) -> DataFrame:
    """Open violations with their age in hours, most severe and oldest first."""
    hours = (F.unix_micros(as_of) - F.unix_micros("occurred_at")) / 3_600_000_000
    return audit.where(~F.col("resolved")).withColumn("hours_open", hours).orderBy(severity_rank(F.col("severity")), "occurred_at", "id")


def violation_summary(audit: DataFrame) -> DataFrame:
    return audit.groupBy("violation_type", "table_name", "severity").agg(
        F.count("*").alias("total"), F.count_if("resolved").alias("resolved_count"),
            F.count_if(~F.col("resolved")).alias("unresolved_count"), F.min("occurred_at").alias("first_at"),
            F.max("occurred_at").alias("last_at")
    )


def erase(table: DataFrame, clauses: DataFrame, doc_ids: DataFrame, key: str = "clause_id") -> DataFrame:
    """table without the rows of the documents' clauses."""
    return table.join(clauses.join(doc_ids, "doc_id", "left_semi").select(key), key, "left_anti")


def insert_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those rows whose key it lacks."""
    return table.unionByName(rows.dropDuplicates([key]).join(table.select(key), key, "left_anti").select(*table.columns))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def outside_domain(table: DataFrame, column: str = "severity", domain: tuple[str, ...] = SEVERITIES) -> DataFrame:
    return table.where(~F.coalesce(F.col(column).isin(*domain), F.lit(True)))


def first_artifact(artifacts: DataFrame) -> DataFrame:
    """The first artifact of each clause by id."""
    return artifacts.groupBy("clause_id").agg(F.min_by(F.struct(*artifacts.columns), "artifact_id").alias("a")).select("a.*")


def latest(jobs: DataFrame, key: str = "job_id", at: str = "updated_at") -> DataFrame:
    """The last row of each key; ties fall to the greatest row."""
    rest = [c for c in jobs.columns if c not in (key, at)]
    return jobs.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("j")).select(key, "j.*")


def version_diff(old: DataFrame, new: DataFrame, key: str = "clause_id", text: str = "source_text") -> DataFrame:
    """(key, change): added, removed, changed or same, on text without regard to case and spacing."""
    plain = lambda df, name: df.select(key, F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))).alias(name))
    both = plain(old, "__old").join(plain(new, "__new"), key, "full")
    return both.select(key, F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(),
            "removed").when(F.col("__old") == F.col("__new"), "same").otherwise("changed").alias("change"))


def list_documents(documents: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, sections, chunks): every document with what it was cut into."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    out = documents.select("doc_id").join(count(sections, "sections"), "doc_id", "left").join(count(chunks, "chunks"), "doc_id", "left")
    return out.select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sections", "chunks")])


def filter_clauses(parsed: DataFrame, kind: str | None = None, doc_ids: tuple[str, ...] | None = None, least_confidence: float | None = None) -> DataFrame:
    """Clauses of a type, of some documents, of a confidence; what is None doesn't filter."""
    if kind is not None:
        parsed = parsed.where(F.col("type") == kind)
    if doc_ids is not None:
        parsed = parsed.where(F.col("doc_id").isin(*doc_ids))
    return parsed if least_confidence is None else parsed.where(F.col("confidence") >= least_confidence)


# -- stored JSON of any shape


#: How no JSON begins; the parser would raise and catch an error for each such text.
_NEVER_JSON = r"\A[ \t\r\n]*+(?:[A-HJ-MO-Za-eg-mo-su-z]|-[^0-9I])"


def as_variant(rows: DataFrame, column: str, out: str = "v") -> DataFrame:
    """rows with the JSON text of `column` as a variant. Null or blank text gives null, and so does damaged JSON, which
    `<out>_damaged` tells apart."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    parsed = F.when(~blank & ~F.col(column).rlike(_NEVER_JSON), F.try_parse_json(column))
    return rows.withColumn(out, parsed).withColumn(f"{out}_damaged", ~blank & F.col(out).isNull())


def at_path(v: Column, path: str, kind: str = "string") -> Column:
    """What lies at a path such as $.actor.entity; null where nothing does or where it isn't of the kind."""
    return F.try_variant_get(v, path, kind)


def shapes(rows: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """(*by, n, shape): the schema that all variants of a group fit, one aggregation over any mixture of shapes."""
    return rows.where(F.col(v).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.schema_of_variant_agg(v).alias("shape"))
