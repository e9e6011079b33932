"""Lineage loops, triggers over streams and windows of event time. The queries run against DuckDB beside the others."""

import collections
import datetime
import random
import shutil

import pytest
from pyspark.sql import Row, functions as F

from normweave.operators import lineage, metrics, rules
from normweave.plans import corpus, history
from normweave.streaming import changes


def breadth_first(links, start):
    out, depth, frontier = {start: 0}, 0, {start}
    ahead = collections.defaultdict(set)
    for a, b in links:
        ahead[a].add(b)
    while frontier:
        depth += 1
        frontier = {b for a in frontier for b in ahead[a]} - set(out)
        out |= dict.fromkeys(frontier, depth)
    return out


@pytest.mark.parametrize("upwards", [False, True])
def test_reach_of_any_graph(spark, upwards):
    rng = random.Random(4)
    nodes = [f"n{k}" for k in range(30)]
    links = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(35)] + [("n0", "n0"), ("n1", "n2"), ("n2", "n1"), ("n1", "n2")]
    graph = spark.createDataFrame([*links, (None, "n1"), ("n2", None)], "source_id string, target_id string")
    starts = spark.createDataFrame([("n0",), ("n1",), ("n1",), ("elsewhere",)], "start_id string")
    got = sorted(tuple(r) for r in lineage.reach(graph, starts, upwards).collect())
    turned = [(b, a) for a, b in links] if upwards else links
    assert got == sorted((s, n, d) for s in ("n0", "n1", "elsewhere") for n, d in breadth_first(turned, s).items())


def test_reach_of_a_long_chain_and_of_nothing(spark):
    graph = spark.createDataFrame([(f"c{k}", f"c{k + 1}") for k in range(12)], "source_id string, target_id string")
    rows = lineage.reach(graph, spark.createDataFrame([("c0",)], "start_id string")).collect()
    assert {r["node_id"]: r["depth"] for r in rows} == {f"c{k}": k for k in range(13)}
    assert lineage.reach(graph, spark.createDataFrame([], "start_id string")).count() == 0


def image(actor, completed=None, attempted=None, met=None):
    return Row(actor=actor, action="a", object=None, status="ok", completed=completed, attempted=attempted, condition_met=met)


CHANGES = changes.CHANGES


def log(spark, rows):
    at = datetime.datetime(2026, 1, 1)
    return spark.createDataFrame([(i, op, e, b, a, at + datetime.timedelta(seconds=i)) for i, (op, e, b, a) in enumerate(rows)], CHANGES)


RULES = [("O", "obligation", "Desk", "a", None, False, "high"), ("P", "prohibition", "vault", "a", None, False, "low"),
    ("N", "permission", "desk", "a", None, True, "medium"), ("V", "definition", "vault", "a", None, False, "low")]
RULE = "rule_id string, type string, actor string, action string, object string, has_condition boolean, severity string"


def test_triggers_by_operation(spark):
    rows = log(spark, [
        ("insert", 1, None, image("desk", completed=True, met=True)),  # N only
        ("update", 1, image("desk", completed=True), image("desk", completed=None, met=True)),  # O blocks, so N is silent
        ("delete", 1, image("desk", completed=False), None),  # obligations don't watch deletes
        ("delete", 2, image("vault", attempted=True), None),  # P sees the row that was
        ("update", 3, image("vault", attempted=True), image("vault", attempted=False)),  # V
        ("insert", 4, None, image("vault", attempted=None)),  # V
        ("delete", 4, image("vault"), None),  # nothing
        ("merge", 5, image("vault", attempted=True), image("vault", attempted=True)), ("insert", 6, None, None), (None, 7, None, None),
    ])
    table = spark.createDataFrame(RULES, RULE)
    audit = rules.fired(rows, table)
    assert sorted((r["change_id"], r["rule_id"], r["violation_type"], r["severity"], r["blocking"]) for r in audit.collect()) == [
        (0, "N", "permission_triggered", "medium", False), (1, "O", "obligation_not_met", "high", True),
        (3, "P", "prohibition_violated", "critical", True), (4, "V", "definition_triggered", "low", False), (5, "V", "definition_triggered", "low", False)]
    accepted, blocked = rules.split_changes(rows, audit)
    assert sorted(r["change_id"] for r in blocked.collect()) == [1, 3] and accepted.count() == 8
    known = accepted.where("op IN ('insert', 'update', 'delete')")
    assert sorted(r["entity_id"] for r in rules.replayed(known).collect()) == [3, 6]


def test_hooks_of_validators(spark):
    facts = spark.createDataFrame([(1, "desk", "a", None, "ok", None, None, True, None), (2, "desk", "a", None, "ok", True, None, True, None)],
        "entity_id long, actor string, action string, object string, status string, completed boolean, attempted boolean, condition_met boolean, ts timestamp")
    table = spark.createDataFrame(RULES[:1], RULE)
    seen = rules.enforce(facts, table, before=lambda f: f.where("completed"), after=lambda o: o.withColumn("noted", F.lit(True))).collect()
    assert [(r["entity_id"], r["violated"], r["noted"]) for r in seen] == [(2, False, True)]
    with pytest.raises(Exception, match="rule O violated by entity 1"):
        rules.enforce(facts, table).collect()


def test_a_repeated_batch_changes_nothing(spark, sf, tmp_path):
    """The batch plan's rows, also after a batch ran twice and after a restart from the checkpoint."""
    whole = history.change_log(spark, sf)
    whole.repartition(3).write.parquet(f"{tmp_path}/log")
    table = corpus.rule_table(spark)
    run = lambda: changes.enforced(spark, f"{tmp_path}/log", table, f"{tmp_path}/out", f"{tmp_path}/checkpoint", 1).awaitTermination()
    run()
    names = ["change_id", "rule_id", "violation_type", "severity", "status_before", "status_after"]
    want = sorted(map(repr, rules.fired(whole, table).select(*names).collect()))
    read = lambda: sorted(map(repr, spark.read.parquet(f"{tmp_path}/out/audit").select(*names).collect()))
    assert read() == want and want
    last = max(int(p.name) for p in (tmp_path / "checkpoint/commits").iterdir() if p.name.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        (tmp_path / "checkpoint/commits" / name).unlink()  # as if the driver was lost before the batch was noted
    shutil.rmtree(tmp_path / "out/quarantine" / f"batch={last}")
    run()
    assert read() == want
    counts = [spark.read.parquet(f"{tmp_path}/out/{kind}").count() for kind in ("accepted", "quarantine")]
    assert sum(counts) == whole.count() and min(counts) > 0


def test_windows_as_a_stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for k in range(5):  # one after another, for the source takes files by their time
        e.where(F.least(F.floor((F.dayofyear("ts") - 1) / 6), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/events")
    for name, window, by in (("day", F.window("ts", "1 day"), ["event_type"]), ("session", F.session_window("ts", "6 hours"), ["user_id"])):
        failed = F.col("value") > 95
        changes.window_stats(stream, "ts", window, "100 days", by, f"{tmp_path}/{name}", f"{tmp_path}/{name}-c", failed=failed).awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/{name}").count() == 0  # all may still change
        changes.window_stats(stream, "ts", window, "2 days", by, f"{tmp_path}/{name}2", f"{tmp_path}/{name}2-c", failed=failed).awaitTermination()
        top = e.agg(F.max("ts")).first()[0] - datetime.timedelta(days=2)
        row = lambda r: (r["start"], r["end"], r[by[0]], r["count"], r["failures"], round(r["per_second"], 9), round(r["mean"], 6), r["min"], r["max"])
        want = sorted(row(r) for r in metrics.window_stats(e, window, by, failed=failed).where(F.col("end") <= F.lit(top)).collect())
        got = sorted(row(r) for r in spark.read.parquet(f"{tmp_path}/{name}2").collect())
        assert set(got) <= set(want) and len(got) == len(set(got)) and len(got) >= 0.9 * len(want) > 0


def test_window_edges(spark):
    at = datetime.datetime(2026, 1, 1)
    rows = [(at, None, "a"), (at + datetime.timedelta(hours=1), 2.0, "a"), (None, 3.0, "a"), (at, 4.0, None)]
    df = spark.createDataFrame(rows, "ts timestamp, value double, k string")
    got = {r["k"]: r for r in metrics.window_stats(df, F.window("ts", "1 day"), ["k"]).collect()}
    assert (got["a"]["count"], got["a"]["mean"], got["a"]["stdev"], got[None]["max"], got["a"]["success_rate"]) == (2, 2.0, None, 4.0, 1.0)
    assert metrics.window_stats(df.limit(0), F.session_window("ts", "1 hour"), ["k"]).count() == 0


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(8)
    at = datetime.datetime(2026, 1, 1)
    values = [rng.lognormvariate(0, 2) for _ in range(30_000)] + [1.0] * 5000
    df = spark.createDataFrame([(at + datetime.timedelta(minutes=i), v, "a") for i, v in enumerate(values)], "ts timestamp, value double, k string")
    q = metrics.merged_quantiles(metrics.window_sketches(df, F.window("ts", "1 hour"), ["k"]), ["k"], (0.5, 0.9, 0.99, 0.999)).first()
    assert q["count"] == len(values)
    for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p99_9", 0.999)):
        below, upto = sum(v < q[name] for v in values) / len(values), sum(v <= q[name] for v in values) / len(values)
        assert below <= p + 0.005 and upto >= p - 0.005
