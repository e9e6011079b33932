import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from normweave.operators import artifacts, clauses, lineage
from normweave.plans import registry


def test_levels_of_compiled_validations_need_no_distinct(spark):
    """Nodes and edges with a format that each clause has once, against the general ones."""
    ids = [(d, f"{d}_S{s}", f"{d}_S{s}_C0", f"{d}_S{s}_C0_CL{c}") for d in ("a", "b") for s in range(2) for c in range(3)]
    rows = [((d, s, k, c, f"{c}_{f}"), 0.5 if f == "sql" else 0.9, "passed", f, "obligation") for d, s, k, c in ids for f in ("yaml", "sql")]
    v = spark.createDataFrame(rows, "lineage struct<document_id:string,section_id:string,chunk_id:string,clause_id:string,artifact_id:string>, "
        "confidence_score double, validation_status string, format string, type string")
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(lineage.nodes(v)) == flat(lineage.nodes(v, once="yaml")) and lineage.nodes(v).count() == 2 + 4 + 4 + 12 + 24
    assert flat(lineage.edges(v)) == flat(lineage.edges(v, once="sql")) and lineage.edges(v).count() == 4 + 4 + 12 + 24


def test_reach_by_one_link_or_many(spark):
    """Cycles, loops, repeated links and nodes that several links lead to, against a search over the same links."""
    links = [("a", "b"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("b", "d"), ("d", "d"), ("d", "e"), ("e", "f"), ("x", "e"), ("y", "y"), ("f", None)]
    graph, starts = spark.createDataFrame(links, "source_id string, target_id string"), ["a", "c", "e", "x", "y", "z"]
    want = set()
    for s in starts:
        depth, now = {s: 0}, {s}
        while now:
            now = {t for u, t in links if u in now and t is not None} - set(depth)
            depth |= {t: max(depth.values()) + 1 for t in now}
        want |= {(s, n, d) for n, d in depth.items()}
    found = list(map(tuple, lineage.reach(graph, spark.createDataFrame([(s,) for s in starts + ["a"]], "start_id string")).collect()))
    assert set(found) == want and len(found) == len(want)


def test_artifact_ids_without_contents(spark):
    c = spark.createDataFrame([("c1",), ("c2",)], "clause_id string")
    assert sorted(r.artifact_id for r in artifacts.artifact_ids(c, ("yaml", "sql")).collect()) == ["c1_sql", "c1_yaml", "c2_sql", "c2_yaml"]


def test_guards_leave_out_only_what_cannot_match(spark):
    """Every component with and without its guard, in ASCII and other texts."""
    texts = ["Staff MUST report the log Within 5 days.", "The clerk mu\u017ft verify papers if asked, daily", "Nothing here", "", "W\u0130THIN by noon. for 3 days", "Upon notice, staff can go before 9."]
    rows = clauses.parse(spark.createDataFrame([(t,) for t in texts], "source_text string")).withColumn("__low", F.lit(None).cast("string"))
    patterns = list(clauses._WORDS)
    free = rows.select(*[clauses._guarded(F.col("source_text"), p).alias(f"p{i}") for i, p in enumerate(patterns)])
    low = F.when(F.octet_length("source_text") == F.length("source_text"), F.lower("source_text"))
    kept = rows.withColumn("__low", low).select(*[clauses._guarded(F.col("source_text"), p).alias(f"p{i}") for i, p in enumerate(patterns)])
    assert free.collect() == kept.collect()


def _graph(spark):
    """Parts with cycles, loops, shared targets, repeated links and null ends; p5 is larger, z is a chain."""
    pick = random.Random(5)
    links = [(f"p{k}", f"p{k}_{pick.randrange(9)}", f"p{k}_{pick.randrange(9)}") for k in range(12) for _ in range(40 if k == 5 else 14)]
    links += [("z", f"z{n}", f"z{n + 1}") for n in range(40)] + [("p0", None, "p0_1"), ("p0", "p0_1", None), (None, "p1_1", "p1_2")]
    starts = [(f"p{k}", f"p{k}_{n}") for k in range(12) for n in (0, 3, 3)] + [("z", "z0"), ("z", "z39"), ("q", "alone")]
    return spark.createDataFrame(links, "doc string, source_id string, target_id string"), spark.createDataFrame(starts, "doc string, start_id string")


@pytest.mark.parametrize("largest,upwards", [(1_000_000, False), (1_000_000, True), (42, True)])
def test_parts_are_walked_as_the_whole_graph(spark, monkeypatch, largest, upwards):
    """In tasks, and for parts over the limit by all tasks, against a search over the same links."""
    monkeypatch.setattr(lineage, "LARGEST_PART", largest)
    monkeypatch.setattr(lineage, "ROWS_A_TASK", 30)
    graph, starts = _graph(spark)
    links = {(t, s) if upwards else (s, t) for d, s, t in graph.collect() if d is not None}
    want = set()
    for s in {r.start_id for r in starts.collect()}:
        depth, now = {s: 0}, {s}
        while now:
            now = {t for u, t in links if u in now and t is not None} - set(depth)
            depth |= {t: max(depth.values()) + 1 for t in now}
        want |= {(s, n, d) for n, d in depth.items()}
    rows = lineage.reach_in_parts(graph, starts, "doc", upwards).collect()
    found = [(r.start_id, n.node_id, n.depth) for r in rows for n in r.reached]
    assert set(found) == want and len(found) == len(want) and len(rows) == starts.distinct().count()


def test_few_pairs_at_once_find_the_same(spark, monkeypatch):
    """The walk of a task without Spark, in blocks of one start and of all."""
    graph, starts = _graph(spark)
    rows = [(d, s, t, False) for d, s, t in graph.where("doc IS NOT NULL AND source_id IS NOT NULL").collect()] + [(d, s, None, True) for d, s in starts.collect()]
    table = pa.table([pa.chunked_array([list(c)], kind) for c, kind in zip(zip(*rows), (pa.string(), pa.string(), pa.string(), pa.bool_()))], ["part", "near", "far", "starts"])
    found = []
    for most in (1, 100, 2_000_000):
        monkeypatch.setattr(lineage, "PAIRS_AT_ONCE", most)
        found.append(sorted((r["start_id"], n["node_id"], n["depth"]) for b in lineage._walk(table) for r in b.to_pylist() for n in r["reached"]))
    assert found[0] == found[1] == found[2] and ("z0", "z40", 40) in found[0] and ("alone", "alone", 0) in found[0]


def test_lineage_queries_walk_documents_in_tasks(spark, sf):
    """No round of joins over all documents."""
    for name in ("lineage_sources", "lineage_of_documents"):
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and plan.count("hashpartitioning(") == 1
