"""Registered queries over what changes: lineage of any depth, triggers on a change log, statistics of event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from normweave.operators import artifacts, clauses, lineage, metrics, rules, structure
from normweave.plans import corpus, oracle, pipeline
from normweave.plans.catalog import query, read
from normweave.sources.store import scratch_path, stored
from normweave.streaming import changes

FORMATS = ("yaml", "sql")
CHANGED = "Identity & Onboarding"


# -- lineage of any depth


def _links(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The graph's links and its sections. keep: columns beside the links, doc_id at most."""
    sections = stored(corpus.sections(spark, sf_dir), "sections")
    chunks = structure.chunks(sections)
    parsed = pipeline.parse_chunks(chunks)
    refs = parsed.select("doc_id", "clause_id", F.explode(clauses.cross_references(F.col("source_text"))).alias("ref"))
    refs = refs.select("doc_id", "clause_id", F.concat("doc_id", F.lit("_S"), F.lpad("ref", 3, "0")).alias("section_id"))
    return lineage.links(sections, chunks, parsed, artifacts.artifact_ids(parsed, FORMATS, keep), refs, keep), sections


_LINKS = rf"""WITH RECURSIVE {oracle.artifacts_cte(FORMATS)}, sid AS (SELECT doc_id, sec, title, doc_id || '_S' || lpad(sec::VARCHAR, 3, '0') AS section_id,
  (SELECT max(p.sec) FROM sec p WHERE p.sec < s.sec AND p.lvl < s.lvl) AS up FROM sections s),
named_by AS (SELECT clause_id, doc_id || '_S' || lpad(ref, 3, '0') AS section_id FROM (SELECT clause_id, doc_id, unnest(list_distinct(regexp_extract_all(source_text, '(?i)\bsection\s+(\d+(?:\.\d+)*)', 1))) AS ref FROM parsed)),
link AS (SELECT 'document:' || doc_id AS s, 'section:' || section_id AS t FROM sid UNION SELECT 'section:' || doc_id || '_S' || lpad(up::VARCHAR, 3, '0'), 'section:' || section_id FROM sid WHERE up IS NOT NULL
  UNION SELECT 'section:' || section_id, 'chunk:' || chunk_id FROM chunk UNION SELECT 'chunk:' || chunk_id, 'clause:' || clause_id FROM parsed UNION SELECT 'section:' || section_id, 'clause:' || clause_id FROM named_by
  UNION SELECT 'clause:' || clause_id, 'artifact:' || artifact_id FROM artifact)"""


def _walk(starts: str, near: str = "s", far: str = "t") -> str:
    return f"""walk(start_id, node_id, depth, path) AS (SELECT id, id, 0, [id] FROM ({starts}) UNION ALL SELECT start_id, link.{far}, depth + 1, list_append(path, link.{far}) FROM walk JOIN link ON link.{near} = node_id WHERE NOT list_contains(path, link.{far})),
reached AS (SELECT start_id, node_id, min(depth)::INTEGER AS depth FROM walk GROUP BY 1, 2)"""


_starts = f"SELECT 'section:' || section_id AS id FROM sid WHERE title = '{CHANGED}'"


@query(f"{_LINKS}, {_walk(_starts)} SELECT start_id, node_id, depth FROM reached")
def lineage_impact(spark, sf_dir):
    """All that a changed section reaches: its sections, chunks, clauses and artifacts, and clauses that name it."""
    graph, sections = _links(spark, sf_dir)
    starts = sections.where(F.col("section_title") == CHANGED).select(F.concat(F.lit("section:"), "section_id").alias("start_id"))
    return lineage.reach(graph, starts)


_of = lambda kind: f"count(*) FILTER (starts_with(node_id, '{kind}:'))"


@query(f"{_LINKS}, {_walk('SELECT DISTINCT s AS id FROM link WHERE starts_with(s, ' + chr(39) + 'document:' + chr(39) + ')')} SELECT start_id, {_of('section')} AS sections, {_of('clause')} AS clauses, {_of('artifact')} AS artifacts, max(depth) AS deepest FROM reached GROUP BY start_id")
def lineage_of_documents(spark, sf_dir):
    """From each document down to all its artifacts."""
    graph, sections = _links(spark, sf_dir, ("doc_id",))
    down = lineage.reach_in_parts(graph, sections.where("section_ord = 1").select("doc_id", F.concat(F.lit("document:"), "doc_id").alias("start_id")), "doc_id")
    count = lambda kind: F.size(F.filter("reached", lambda n: n["node_id"].startswith(f"{kind}:"))).cast("long").alias(f"{kind}s")
    return down.select("start_id", count("section"), count("clause"), count("artifact"), F.array_max("reached.depth").alias("deepest"))


@query(f"""{_LINKS}, {_walk("SELECT 'artifact:' || artifact_id AS id FROM artifact", "t", "s")} SELECT start_id, count(*) - 1 AS sources, max(depth) AS furthest, min(depth) FILTER (starts_with(node_id, 'document:')) AS to_document FROM reached GROUP BY start_id""")
def lineage_sources(spark, sf_dir):
    """From each artifact up to all that it rests on."""
    graph, _ = _links(spark, sf_dir, ("doc_id",))
    tips = graph.where(F.col("target_id").startswith("artifact:")).select("doc_id", F.col("target_id").alias("start_id"))
    up = lineage.reach_in_parts(graph, tips, "doc_id", upwards=True)
    documents = F.filter("reached", lambda n: n["node_id"].startswith("document:"))
    return up.select("start_id", (F.size("reached") - 1).cast("long").alias("sources"), F.array_max("reached.depth").alias("furthest"),
        F.array_min(F.transform(documents, lambda n: n["depth"])).alias("to_document"))


# -- triggers on a change log


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions of each order: entered as open, brought to its status a day later, and, if closed and cheap, deleted."""
    o = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def image(status: Column) -> Column:
        return F.struct(F.lower("c_mktsegment").alias("actor"), F.when(status == "F", "close").when(status == "O", "hold").otherwise("review").alias("action"),
            F.lit("order").alias("object"), F.when(F.col("o_totalprice") > 300000, "violation").otherwise("ok").alias("status"),
            F.when(status != "P", status == "F").alias("completed"), (status == "O").alias("attempted"), F.col("o_orderpriority").startswith("1").alias("condition_met"))

    old, new = image(F.lit("O")), image(F.col("o_orderstatus"))
    none = F.lit(None).cast(rules.IMAGE)
    day = F.expr("INTERVAL 1 DAY")
    at = F.col("o_orderdate").cast("timestamp")
    step = lambda n, op, before, after, ts: F.struct((F.col("o_orderkey") * 3 + n).alias("change_id"), F.lit(op).alias("op"),
        F.col("o_orderkey").alias("entity_id"), before.cast(rules.IMAGE).alias("before"), after.cast(rules.IMAGE).alias("after"), ts.alias("ts"))
    gone = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") < 50000)
    steps = [step(0, "insert", none, old, at), step(1, "update", old, new, at + day), step(2, "delete", new, none, at + day + day)]
    rows = F.filter(F.array(*steps), lambda s: (s["op"] != "delete") | gone)
    return o.select(F.explode(rows).alias("c")).select("c.*")


_CHANGES = f"""WITH {corpus.rule_cte()}, base AS (SELECT o_orderkey AS entity_id, lower(c_mktsegment) AS actor, o_orderstatus AS status, o_totalprice AS price, o_orderpriority LIKE '1%' AS condition_met FROM orders JOIN customer ON o_custkey = c_custkey),
change AS (SELECT entity_id * 3 AS change_id, 'insert' AS op, 'O' AS st, * FROM base UNION ALL SELECT entity_id * 3 + 1, 'update', status, * FROM base UNION ALL SELECT entity_id * 3 + 2, 'delete', status, * FROM base WHERE status = 'F' AND price < 50000),
hit AS (SELECT change_id, op, entity_id, rule_id, type, CASE WHEN price > 300000 THEN 'violation' ELSE 'ok' END AS state, CASE type WHEN 'obligation' THEN 'obligation_not_met' WHEN 'prohibition' THEN 'prohibition_violated' ELSE type || '_triggered' END AS violation_type,
  CASE WHEN type = 'prohibition' THEN 'critical' ELSE severity END AS severity FROM change JOIN rule USING (actor) WHERE CASE type WHEN 'obligation' THEN op <> 'delete' AND st <> 'F' WHEN 'prohibition' THEN st = 'O' ELSE op <> 'delete' AND (NOT has_condition OR condition_met) END),
stopped AS (SELECT DISTINCT change_id FROM hit WHERE type IN ('obligation', 'prohibition')),
audit AS (SELECT change_id, op, entity_id, rule_id, violation_type, severity, type IN ('obligation', 'prohibition') AS blocking, CASE WHEN op <> 'insert' THEN state END AS status_before, CASE WHEN op <> 'delete' THEN state END AS status_after FROM hit WHERE type IN ('obligation', 'prohibition') OR change_id NOT IN (FROM stopped))"""


@query(f"{_CHANGES} SELECT * FROM audit")
def change_triggers(spark, sf_dir):
    return rules.fired(change_log(spark, sf_dir), corpus.rule_table(spark)).drop("ts")


@query(f"{_CHANGES} SELECT entity_id, last_op AS op FROM (SELECT entity_id, arg_max(op, change_id) AS last_op FROM change WHERE change_id NOT IN (FROM stopped) GROUP BY 1) WHERE last_op <> 'delete'")
def change_replay(spark, sf_dir):
    """The orders that are left when blocked changes are kept out."""
    log = stored(change_log(spark, sf_dir), "changes")
    accepted, _ = rules.split_changes(log, stored(rules.fired(log, corpus.rule_table(spark)), "fired"))
    last = accepted.groupBy("entity_id").agg(F.max_by("op", "change_id").alias("op"))
    return rules.replayed(accepted).select("entity_id").join(last, "entity_id")


@query(f"{_CHANGES} SELECT 'audit' AS kind, op, count(*) AS n FROM audit GROUP BY op UNION ALL SELECT CASE WHEN change_id IN (FROM stopped) THEN 'quarantine' ELSE 'accepted' END, op, count(*) FROM change GROUP BY ALL")
def change_stream(spark, sf_dir):
    """The same through the stream, whose log comes in several files and batches."""
    path = scratch_path(spark, "change-log")
    change_log(spark, sf_dir).repartition(4, "entity_id").write.parquet(path)
    out = scratch_path(spark, "change-out")
    changes.enforced(spark, path, corpus.rule_table(spark), out, scratch_path(spark, "change-checkpoint"), files_a_batch=2).awaitTermination()
    count = lambda kind: spark.read.parquet(f"{out}/{kind}").groupBy("op").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "op", "n")
    return count(changes.AUDIT).unionByName(count(changes.ACCEPTED)).unionByName(count(changes.QUARANTINE))


# -- statistics of event time


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def _rounded(rows: DataFrame) -> DataFrame:
    exact = rows.select(F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), *[c for c in rows.columns if c not in ("start", "end")])
    return exact.withColumns({c: F.round(c, 6) for c in ("success_rate", "per_second", "mean", "stdev")})


_stats = """count(*) AS count, count(*) FILTER (value > 95) AS failures, round(1 - count(*) FILTER (value > 95) / count(*), 6) AS success_rate, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stdev, min(value) AS min, max(value) AS max"""


@query(f"SELECT epoch_us(date_trunc('day', ts)::TIMESTAMP) AS start_us, epoch_us(date_trunc('day', ts)::TIMESTAMP) + 86400000000 AS end_us, event_type, {_stats}, round(count(*) / 86400.0, 6)::DOUBLE AS per_second FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def window_load_stats(spark, sf_dir):
    """Requests per second and times of each day and endpoint."""
    return _rounded(metrics.window_stats(_requests(spark, sf_dir), F.window("ts", "1 day"), ["event_type"], failed=F.col("value") > 95))


@query(f"""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER o <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE ts IS NOT NULL WINDOW o AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g),
t AS (SELECT user_id, nr, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + 21600000000 AS end_us, {_stats} FROM s GROUP BY user_id, nr) SELECT user_id, start_us, end_us, count, failures, success_rate, mean, stdev, min, max, round(count / ((end_us - start_us) / 1000000.0), 6)::DOUBLE AS per_second FROM t""")
def session_load_stats(spark, sf_dir):
    """The same for each user's sessions, which six idle hours end."""
    return _rounded(metrics.window_stats(_requests(spark, sf_dir), F.session_window("ts", "6 hours"), ["user_id"], failed=F.col("value") > 95))


@query("SELECT event_type, count(value) AS count, true AS p50, true AS p90, true AS p95, true AS p99 FROM events WHERE value IS NOT NULL GROUP BY 1")
def window_quantiles(spark, sf_dir):
    """Quantiles of a month from merged sketches of its days: whether each one's exact rank is within 1 %."""
    e = _requests(spark, sf_dir)
    q = metrics.merged_quantiles(metrics.window_sketches(e, F.window("ts", "1 day"), ["event_type"]), ["event_type"])
    both = e.where("value IS NOT NULL").join(q, "event_type")
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    within = {n: (F.avg((F.col("value") < F.col(n)).cast("double")) <= p + 0.01) & (F.avg((F.col("value") <= F.col(n)).cast("double")) >= p - 0.01) for n, p in names.items()}
    return both.groupBy("event_type", "count").agg(*[w.alias(n) for n, w in within.items()])
