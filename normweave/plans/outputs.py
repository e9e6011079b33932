"""Registered queries over what the engine keeps and hands out: registries, graphs, metrics, stored JSON, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from normweave.operators import artifacts, lineage, mapping, metrics, rules, structure, views
from normweave.plans import corpus, oracle, pipeline
from normweave.plans.catalog import query, read
from normweave.sources import files
from normweave.sources.store import scratch_path, spread
from normweave.streaming import jobs

# -- registry and graph


@query("""WITH t AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) - 1 AS field_ord FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'geo' AS schema_id, r_regionkey::INTEGER AS table_ord, lower(r_name) AS table_name, field_ord::INTEGER AS field_ord, lower(n_name) AS field_name, 'label ' || lower(n_name) AS label FROM t""")
def registry_saved(spark, sf_dir):
    """Regions as tables, nations as fields: written as a registry's JSON and read back."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    rows = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    before = n.select(F.col("n_regionkey").alias("k"), F.col("n_nationkey").alias("x"))
    rank = n.join(before, F.col("n_regionkey") == F.col("k")).groupBy("n_nationkey").agg(F.count_if(F.col("x") < F.col("n_nationkey")).cast("int").alias("field_ord"))
    name = F.lower("n_name")
    fields = rows.join(rank, "n_nationkey").select(F.lit(0).alias("schema_ord"), F.col("r_regionkey").cast("int").alias("table_ord"), "field_ord", F.lit("geo").alias("schema_id"),
        F.lower("r_name").alias("table_name"), name.alias("field_name"), F.lit("VARCHAR").alias("field_type"), F.array(F.concat(F.lit("label "), name)).alias("labels"),
        F.lit(None).cast("string").alias("description"))
    path = scratch_path(spark, "registry")
    reg = corpus.registry(spark)
    files.save_registry(fields, reg.synonyms, reg.overrides, path)
    back, _, _ = files.registry_tables(spark, path)
    return back.select("schema_id", "table_ord", "table_name", "field_ord", "field_name", F.col("labels")[0].alias("label"))


@query("""WITH old AS (SELECT 'customer:' || c_custkey AS node_id, 'customer' AS node_type, c_mktsegment AS note FROM customer), new AS (SELECT 'customer:' || o_custkey AS node_id, 'customer' AS node_type, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS note FROM orders GROUP BY o_custkey
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', NULL FROM supplier) SELECT node_id, node_type, note FROM old WHERE node_id NOT IN (SELECT node_id FROM new) UNION ALL SELECT node_id, node_type, note FROM new""")
def graph_upsert(spark, sf_dir):
    """Customers of a graph get the status of their last order, suppliers are new."""
    c, o, s = (read(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    node = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id")
    kind = lambda k: F.lit(k).alias("node_type")
    old = c.select(node("customer", "c_custkey"), kind("customer"), F.col("c_mktsegment").alias("note"), F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("long").alias("k")).alias("at"))
    orders = o.select(node("customer", "o_custkey"), kind("customer"), F.col("o_orderstatus").alias("note"), F.struct(F.col("o_orderdate").cast("timestamp").alias("t"), F.col("o_orderkey").alias("k")).alias("at"))
    suppliers = s.select(node("supplier", "s_suppkey"), kind("supplier"), F.lit(None).cast("string").alias("note"), F.struct(F.lit(None).cast("timestamp").alias("t"), F.lit(None).cast("long").alias("k")).alias("at"))
    return lineage.upsert(old, orders.unionByName(suppliers), order="at").select("node_id", "node_type", "note")


# -- metrics and rules


@query("""WITH c AS (SELECT event_type, count(*) AS n, arg_max(user_id, (ts, event_id)) AS last FROM events GROUP BY 1)
SELECT 'app_seen_total' AS name, 0 AS ord, '# HELP app_seen_total Events seen' AS line UNION ALL SELECT 'app_seen_total', 1, '# TYPE app_seen_total counter' UNION ALL SELECT 'app_user', 0, '# HELP app_user Last user' UNION ALL SELECT 'app_user', 1, '# TYPE app_user gauge'
UNION ALL SELECT 'app_seen_total', 2, 'app_seen_total{kind="' || event_type || '"} ' || n FROM c UNION ALL SELECT 'app_user', 2, 'app_user{kind="' || event_type || '"} ' || last FROM c""")
def metrics_exposed(spark, sf_dir):
    """A counter and a gauge for each kind of event in the Prometheus text format."""
    e = read(spark, sf_dir, "events")
    of = lambda name, kind, value: e.select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.create_map(F.lit("kind"), F.col("event_type")).alias("labels"),
        value.cast("long").alias("value"), F.struct("ts", "event_id").alias("ts"))
    seen = metrics.observed(of("app_seen_total", "counter", F.lit(1)).unionByName(of("app_user", "gauge", F.col("user_id"))))
    known = spark.createDataFrame([("app_seen_total", "counter", "Events seen"), ("app_user", "gauge", "Last user")], "name string, kind string, help string")
    return metrics.prometheus(known, seen).select("name", "ord", "line")


@query(f"""WITH {corpus.rule_cte()}, fact AS (SELECT o_orderkey AS entity_id, lower(c_mktsegment) AS actor, o_orderstatus AS st, o_totalprice AS price, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT entity_id, rule_id, CASE type WHEN 'obligation' THEN st <> 'F' WHEN 'prohibition' THEN st = 'O' ELSE price > 300000 END AS violated, CASE WHEN type = 'obligation' AND object IS NOT NULL AND p LIKE '5%' THEN 1 ELSE 0 END AS n_warnings FROM fact JOIN rule USING (actor)""")
def rule_enforcement(spark, sf_dir):
    """Verdicts without raising, with warnings where an obligation's object has no value."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    s = F.col("o_orderstatus")
    facts = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("entity_id"), F.lower("c_mktsegment").alias("actor"), F.lit("close").alias("action"),
        F.when(~F.col("o_orderpriority").startswith("5"), "order").alias("object"), F.when(F.col("o_totalprice") > 300000, "violation").otherwise("ok").alias("status"),
        (s == "F").alias("completed"), (s == "O").alias("attempted"), F.lit(True).alias("condition_met"), F.col("o_orderdate").alias("ts"))
    out = rules.enforce(facts, corpus.rule_table(spark), raise_on_violation=False)
    return out.select("entity_id", "rule_id", "violated", F.size("warnings").alias("n_warnings"))


@query(f"WITH {corpus.rule_cte()} SELECT o_orderkey AS entity_id, CASE type WHEN 'prohibition' THEN 730 ELSE 365 END AS retention_days, CASE type WHEN 'prohibition' THEN 'compliance_officer,legal' ELSE 'compliance_officer' END AS escalate_to FROM orders JOIN customer ON o_custkey = c_custkey JOIN rule ON lower(c_mktsegment) = actor AND rule_id <> 'R4'")
def rule_retention(spark, sf_dir):
    """How long the records of each order are kept, by its customer's first rule."""
    table = corpus.rule_table(spark).where("rule_id <> 'R4'")
    kept = rules.retention(table).join(table.select("rule_id", "actor"), "rule_id")
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(kept), F.lower("c_mktsegment") == F.col("actor"))  # a row a rule
    return rows.select(F.col("o_orderkey").alias("entity_id"), "retention_days", F.array_join("escalate_to", ",").alias("escalate_to"))


# -- stored JSON


def _stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of two shapes and what isn't JSON: rules, properties of events, and the contents of SQL artifacts."""
    mapped = mapping.map_clauses(pipeline.parse_chunks(corpus.chunks(spark, sf_dir)), corpus.registry(spark))
    made = artifacts.compile_rules(mapped, ("json", "sql")).select(F.col("format").alias("kind"), F.col("artifact_id").alias("id"), F.col("content").alias("body"))
    return made.unionByName(read(spark, sf_dir, "events").select(F.lit("event").alias("kind"), F.col("event_id").cast("string").alias("id"), F.col("props").alias("body")))


@query(f"""WITH {oracle.artifacts_cte(("json", "sql"))} SELECT format AS kind, artifact_id AS id, CASE WHEN format = 'json' THEN actor END AS entity, CASE WHEN format = 'json' THEN actor_path END AS mapped_to, NULL::BIGINT AS k, format = 'sql' AS damaged FROM artifact
UNION ALL SELECT 'event', event_id::VARCHAR, NULL, NULL, (props->>'$.k')::BIGINT, false FROM events""")
def variant_paths(spark, sf_dir):
    v = views.as_variant(_stored_json(spark, sf_dir), "body")
    return v.select("kind", "id", views.at_path(F.col("v"), "$.actor.entity").alias("entity"), views.at_path(F.col("v"), "$.actor.mapped_to").alias("mapped_to"),
        views.at_path(F.col("v"), "$.k", "bigint").alias("k"), F.col("v_damaged").alias("damaged"))


@query(f"""WITH {oracle.artifacts_cte(("json",))} SELECT 'json' AS kind, count(*) AS n, true AS has_actor, false AS has_k FROM artifact UNION ALL SELECT 'event', count(*), false, true FROM events""")
def variant_shapes(spark, sf_dir):
    s = views.shapes(views.as_variant(_stored_json(spark, sf_dir), "body"), ["kind"])
    return s.select("kind", "n", F.col("shape").rlike(r"\bactor: ?OBJECT<").alias("has_actor"), F.col("shape").rlike(r"\bk: ?BIGINT").alias("has_k"))


# -- bodies of web pages

_BLOCKS = "(?i)</?(p|div|section|article|ul|ol|li|table|tr|br|h[1-6])\\b[^>]*>"
_ENTITIES = "".join(f", '{a}', {b})" for a, b in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&nbsp;", "' '"), ("&amp;", "'&'")))


@query(rf"""WITH b AS (SELECT page_id, regexp_extract(html, '(?is)</h1>(.*?)</article>', 1) AS x FROM pages), t AS (SELECT page_id, regexp_replace(regexp_replace(x, '{_BLOCKS}', chr(10) || chr(10), 'g'), '<[^>]*>', '', 'g') AS x FROM b),
u AS (SELECT page_id, {"replace(" * 6}x{_ENTITIES} AS x FROM t) SELECT page_id, 1 AS section_ord, sha256(regexp_replace(regexp_replace(x, '[ \t]*\n\s*\n\s*', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS body_hash FROM u""")
def html_bodies(spark, sf_dir):
    """What stands among a heading's siblings, of every page."""
    rows = structure.html_sections(spread(read(spark, sf_dir, "pages"), "page_id"))
    return rows.select("page_id", "section_ord", F.sha2("text", 256).alias("body_hash"))


# -- jobs


@query("""WITH e AS (SELECT user_id * 100 + day(ts) AS job_id, event_id, ts AS t, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'created' WHEN 'click' THEN 'started' ELSE event_type END AS kind FROM events),
w AS (SELECT *, coalesce(t > lag(t) OVER o + INTERVAL 2 HOUR, false) AS silent, coalesce(bool_or(kind IN ('completed', 'failed')) OVER (PARTITION BY job_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ended FROM e WINDOW o AS (PARTITION BY job_id ORDER BY t, event_id)),
x AS (SELECT *, ended OR bool_or(silent) OVER (PARTITION BY job_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS over FROM w),
j AS (SELECT job_id, arg_max(kind, (t, event_id)) FILTER (NOT over) AS kind, max(t) FILTER (NOT over) AS last, count(*) FILTER (NOT over) AS n_events, bool_or(kind = 'started' AND NOT over) AS started, bool_or(silent) AS silent FROM x GROUP BY job_id),
h AS (SELECT *, silent OR last + INTERVAL 2 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) AS late FROM j)
SELECT job_id, CASE WHEN kind IN ('completed', 'failed') THEN kind WHEN late THEN 'timed_out' WHEN started THEN 'processing' ELSE 'pending' END AS status, CASE WHEN kind IN ('completed', 'failed') THEN epoch_us(last) WHEN late THEN epoch_us(last + INTERVAL 2 HOUR) END AS ended_us, n_events FROM h""")
def job_states(spark, sf_dir):
    """Each user's events of a day as a job."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kinds = {"purchase": "completed", "error": "failed", "signup": "created", "click": "started"}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    rows = e.select((F.col("user_id") * 100 + F.dayofmonth("ts")).alias("job_id"), "event_id", kind.alias("kind"), F.col("ts").alias("at"))
    horizon = e.agg(F.max("ts")).first()[0]
    return jobs.states(rows, F.lit(horizon) - F.expr("INTERVAL 1 HOUR")).select("job_id", "status", F.unix_micros("ended_at").alias("ended_us"), "n_events")
