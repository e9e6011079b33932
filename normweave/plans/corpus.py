"""Synthetic policies over the star schema's customers, and a schema registry: one Markdown document a customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from normweave.operators import clauses, structure
from normweave.operators.mapping import Registry
from normweave.sources.store import spread

#: (level, title, body); {actor} and {n} stand for the customer's desk and number.
SECTIONS = (
    (1, "Account Care Policy", "This policy sets out the duties of every desk. {actor} must verify client identity within 30 days."),
    (2, "Identity & Onboarding",
            "Client must provide proof of address before activation. {actor} shall maintain identity records for 5 years. When a payment exceeds $10,000, staff must report the transaction daily."),
    (3, "Exceptions: Low Risk",
            "Desk number {n} follows the same scheme. Reviews are required unless the account holder is dormant. Staff may not waive checks."),
    (2, "Data Handling", "{actor} must not share client data. Employee shall not copy log entries. Export of files is prohibited."),
    (2, "Access (Levels)",
            "Personnel may request access quarterly. Remote access is permitted for at least 12 months. A reviewer is the person named in section 2."),
    (3, "Terms", "Wire means a remittance of any value. Dormant is defined as without activity for 2 years."),
    (2, "Reserved", ""),
    (2, "Retention", "Record must ensure retention period, as section 14 says. Backups run weekly. The vault is old. {actor} must submit annual report by end of march."),
    (1, "Closing Notes",
            "If a request fails, the clerk logs it. Where duties clash, the stricter rule applies. Notification requires care. Nothing else applies here."),
    (2, "Plain Words", "All desks keep calm. Nothing binds them."),
    (3, "Night Desk", "Quiet house must submit statement monthly. Quiet house shall not copy record."),
    (4, "Reporting", "The following paragraph concerns every statement that leaves the house on paper or by wire and nothing else. Bank must provide statement annually. Bank and client shall confirm amount monthly."),
)

#: (schema_id, table_name, field_name, field_type, labels, description)
FIELDS = (
    ("people", "client", "client_id", "BIGINT", ("client", "customer", "holder"), "who holds an account"),
    ("people", "client", "identity", "BOOLEAN", ("identity", "proof", "client identity"), "whether papers were seen"),
    ("people", "staff", "staff_id", "BIGINT", ("staff", "employee"), ""),
    ("people", "staff", "access", "VARCHAR", ("access", "clearance"), "what a member of staff may open"),
    ("books", "payment", "payment_id", "BIGINT", ("payment", "wire"), ""),
    ("books", "payment", "amount", "DECIMAL", ("amount", "value"), "money moved"),
    ("books", "statement", "statement", "VARCHAR", ("statement", "annual report"), "what is sent out"),
    ("archive", "ledger", "record", "VARCHAR", ("record", "document"), ""),
    ("archive", "ledger", "Quiet house", "VARCHAR", (), ""),
    ("archive", "ledger", "retention_period", "INTERVAL", ("retention",), "how long a record stays"),
)
#: (term, synonyms)
SYNONYMS = (("client", ("account holder", "depositor")), ("employee", ("personnel", "clerk")), ("record", ("log", "log entries", "file")),
    ("payment", ("transaction", "the transaction", "remittance")))
OVERRIDES = (("bank", "org:house.bank_id"), ("reviews", "people.review"))


def _quoted(x) -> str:
    return "NULL" if x is None else f"'{x.replace(chr(39), chr(39) * 2)}'" if isinstance(x,
        str) else f"[{', '.join(map(_quoted, x))}]" if isinstance(x, tuple) else str(x)


def values(rows) -> str:
    """Rows as SQL VALUES for DuckDB."""
    return "VALUES " + ", ".join(f"({', '.join(map(_quoted, r))})" for r in rows)


def registry(spark: SparkSession) -> Registry:
    schemas = list(dict.fromkeys(f[0] for f in FIELDS))
    tables = {s: list(dict.fromkeys(f[1] for f in FIELDS if f[0] == s)) for s in schemas}
    rows, place = [], {}
    for s, t, name, kind, labels, text in FIELDS:
        n = place[s, t] = place.get((s, t), -1) + 1
        rows.append((schemas.index(s), tables[s].index(t), n, s, t, name, kind, list(labels), text))
    fields = spark.createDataFrame(rows,
        "schema_ord int, table_ord int, field_ord int, schema_id string, table_name string, field_name string, field_type string, labels array<string>, description string")
    synonyms = spark.createDataFrame([(i, t, j, s) for i, (t, all_) in enumerate(SYNONYMS) for j, s in enumerate(all_)],
        "ord int, term string, syn_ord int, synonym string")
    return Registry(fields, synonyms, spark.createDataFrame(list(OVERRIDES), "entity_lower string, target_path string"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, doc_key, text)"""
    c = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment"), "c_custkey")
    text = "Preamble of desk {n}.\n" + "\n".join(f"{'#' * n} {title}\n{body}" for n, title, body in SECTIONS)
    actor = F.concat(F.lit("The "), F.lower("c_mktsegment"), F.lit(" desk"))
    filled = F.replace(F.replace(F.lit(text), F.lit("{actor}"), actor), F.lit("{n}"), F.col("c_custkey").cast("string"))
    key = F.concat(F.lit("DESK_"), F.col("c_custkey").cast("string"))
    return c.select(key.alias("doc_id"), key.alias("doc_key"), filled.alias("text"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.markdown_sections(documents(spark, sf_dir))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chunks(sections(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses.parse(clauses.split_clauses(chunks(spark, sf_dir)))


#: (rule_id, type, actor, action, object, has_condition, severity)
RULES = (
    ("R1", "obligation", "automobile", "close", "order", False, "high"),
    ("R2", "prohibition", "building", "hold", "order", False, "critical"),
    ("R3", "permission", "machinery", "review", None, False, "medium"),
    ("R4", "obligation", "building", "close", None, True, "high"),
    ("R5", "prohibition", "furniture", "close", None, False, "critical"),
)


def rule_cte() -> str:
    """The rules as a common table expression `rule`."""
    rows = values([(*r[:5], str(r[5]), r[6]) for r in RULES]).replace("'True'", "true").replace("'False'", "false")
    return f"rule(rule_id, type, actor, action, object, has_condition, severity) AS ({rows})"


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), "rule_id string, type string, actor string, action string, object string, has_condition boolean, severity string")
