"""What must hold for queries to grow with their input: no side that grows is broadcast, nothing is written in full length."""

import glob

import pytest
from pyspark.sql import functions as F

from normweave.operators import artifacts, mapping, structure, validation, views
from normweave.plans import pipeline, registry
from normweave.sources import stages
from normweave.sources.store import tasks_of
from normweave.streaming import events


@pytest.mark.parametrize("name", ["crossref_integrity", "validation_faults"])
def test_growing_sides_are_not_broadcast(spark, sf, name):
    """The optimizer takes sections and stored clauses for small; only the registry's mappings may go to every task."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert not [k for k in keys if "clause_id#" in k or "section_id#" in k or "ref#" in k]
    assert "SortMergeJoin" in plan


def test_json_of_stages_is_compressed(spark, tmp_path):
    rows = spark.range(2000).selectExpr("concat('TRC_', id) AS trace_id", "array('low_confidence', 'semantic_drift') AS review_flags")
    stages.write_json(rows, f"{tmp_path}/v")
    assert glob.glob(f"{tmp_path}/v/*.json.gz") and not glob.glob(f"{tmp_path}/v/*.json")
    assert stages.read_json(spark, f"{tmp_path}/v", "validations").where("review_flags[1] = 'semantic_drift'").count() == 2000


def test_rendered_artifacts_need_no_parser(spark, sf):
    """What the renderers make is proved valid by a pattern; what isn't still reaches the parser."""
    made = registry._rules(spark, sf, ("yaml", "python")).select("format", "content")
    assert made.count() > 0 and made.where(~artifacts.surely_valid(F.col("format"), F.col("content"))).count() == 0
    odd = ["a: [1", "# x\na:\n  b: \"c\"\n   d: \"e\"\n", "a:\n  b: \"\\q\"\n", "a:\n  b: c: d\n", "a:\n  b: \"x\" y\n", "a:\n\tb: c\n", "a:\n  b:\n    c: \"d\n", "a: b\n", "a:\n  b: \x01\n", ""]
    bad = ["def f(:", "X = \"a\nb\"\n", "X = 1.5 2\n", "x = \"\\\"\n", "X = \"\x00\"\n", "def test_a():\n    record = {\"a\": 1\n", "# ok\nX = \"y\"\n"]
    rows = spark.createDataFrame([("yaml", c) for c in odd] + [("python", c) for c in bad], "format string, content string")
    sure = {(r[0], r[1]) for r in rows.where(artifacts.surely_valid(F.col("format"), F.col("content"))).collect()}
    assert sure == {("python", "# ok\nX = \"y\"\n")}


def test_top_k_ranks_what_rounds_alike_by_id(spark):
    """Similarities equal to six places are a tie, as in the SQL; odd vectors are measured as cosine does."""
    rows = [(1, [1.0, 1e-5]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (6, [-1.0, 0.0]), (7, [1.0, None])]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>")
    q = spark.createDataFrame([(9, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    for block in (1, 3, 100):
        top = mapping.top_k(q, items, 4, query_block=block, item_block=block, digits=6)
        got = {(r.query_id, r.rank): (r.item_id, r.similarity) for r in top.collect()}
        assert [got[9, n] for n in (1, 2, 3, 4)] == [(1, 1.0), (2, 1.0), (5, 1.0), (3, 0.0)]
        assert [got[8, n] for n in (1, 2, 3, 4)] == [(n, 0.0) for n in (1, 2, 3, 4)]


@pytest.mark.parametrize("name", ["review_flag_counts", "artifact_matrix", "variant_paths", "render_terraform", "render_python", "prov_edges"])
def test_methods_are_short_enough_for_the_jvm(spark, sf, name):
    """The JVM interprets methods over 8,000 bytes for good; a renderer fused with its neighbours makes one of 20,000."""
    debug = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$").__getattr__("MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan()
        codes = debug.codegenStringSeq(plan)
        assert codes.size() > 0 and max(codes.apply(i)._3().maxMethodCodeSize() for i in range(codes.size())) <= 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_syntax_is_checked_once_and_contents_only_where_asked(spark, sf):
    """No filter by the flags runs the parser a second time; a query of ids renders nothing."""
    plan = lambda name: registry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan("review_flag_counts").count("ArrowEvalPython") == 1
    assert "ALTER TABLE" in plan("review_flag_counts") and "ALTER TABLE" not in plan("artifact_matrix")


def test_derived_arrays_are_made_once(spark, sf):
    """No filter by an array's size makes sections, chunks, clauses or entities a second time."""
    plan = registry.queries()["clause_split_context"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 3
    assert not [line for line in plan.splitlines() if "Filter" in line and "size(" in line]
    texts = ["", " ", None, "# A\n", "# A\n\n# B\nStaff must go. ", "no heading"]
    docs = spark.createDataFrame([(f"d{n}", f"d{n}", t) for n, t in enumerate(texts)], "doc_id string, doc_key string, text string")
    assert [(r.section_id, r.text) for r in structure.markdown_sections(docs).orderBy("section_id").collect()] == [
        ("d3_S001", ""), ("d4_S001", ""), ("d4_S002", "Staff must go."), ("d5_S001", "no heading")]
    assert [r.chunk_ord for r in structure.chunks(structure.markdown_sections(docs)).collect()] == [0, 0]


def test_texts_that_cannot_be_json_are_not_parsed(spark):
    texts = ["-- x", "ALTER", " \n-a", "-1", " {\"a\": 1}", "true", "null", "nope", "\"x\"", "[", "-", "é", "", None]
    v = views.as_variant(spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, body string"), "body").orderBy("n")
    assert [r[0] for r in v.select("v_damaged").collect()] == [True, True, True, False, False, False, False, True, False, True, True, True, False, False]
    assert "RLIKE" in v._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["artifact_syntax", "validation_summary", "validation_status_summary", "review_flag_counts", "json_validations", "graph_json"])
def test_rows_that_wait_for_python_are_narrow(spark, sf, name):
    """They wait in a queue that goes to disk: neither contents, nor clauses, nor mappings may be among their columns."""
    if name in ("json_validations", "graph_json"):  # these store the validations first
        df = registry._validated(spark, sf)
    else:
        df = registry.queries()[name](spark, sf)
    lines = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted").splitlines()
    inputs = [lines[n + 1] for n, line in enumerate(lines) if line.endswith(") ArrowEvalPython")]
    waiting = {c.split("#")[0].strip() for c in inputs[0].partition("[")[2].partition("[")[2].strip("]").split(",")}
    assert len(inputs) == 1 and "__asked" in waiting
    assert not waiting & {"content", "c", "m", "source_text", "__content0", "mapped_entities"}


def test_stored_clauses_lie_in_small_files(spark, sf, monkeypatch):
    """Tasks that read them have clauses in proportion to a file's."""
    monkeypatch.setattr(pipeline, "CLAUSES_A_FILE", 50)
    parsed = registry._parsed(spark, sf)
    assert parsed.groupBy(F.input_file_name().alias("f")).count().where("count > 50").count() == 0 and parsed.count() == 3300


def test_syntax_is_checked_of_weighed_artifacts(spark):
    """A damaged content fails, also beside good ones, and a null one or a broken chain is told apart."""
    c = "doc_id string, section_id string, chunk_id string, source_text string, type string, actor string, verb string, confidence double, cross_references array<string>"
    kind = f"artifact_id string, clause_id string, doc_id string, format string, content string, c struct<{c}>, m struct<there:boolean,confidences:array<double>>, invalid_refs array<string>"
    clause = ("d", "s", "k", "Staff must go.", "obligation", "Staff", "go", 0.9, [])
    rows = [("a1", "x", "d", "yaml", "a: staff", clause, (True, [0.9]), None), ("a2", "x", "d", "yaml", "a: [staff", clause, (True, [0.9]), None),
        ("a3", "x", "d", "python", "staff = (", clause, (True, [0.9]), None), ("a4", "x", "e", "yaml", None, None, None, None), ("a5", "x", "d", "sql", " ", clause, (True, [0.9]), ["n"])]
    v = validation.verdicts(artifacts.check_syntax(validation.weigh(spark.createDataFrame(rows, kind))))
    got = {r.artifact_id: (r.validation_status, r.type, r.lineage.document_id, ",".join(r.review_flags)) for r in v.collect()}
    assert got == {"a1": ("passed", "obligation", "d", ""), "a2": ("failed", "obligation", "d", "syntax_error"), "a3": ("failed", "obligation", "d", "syntax_error"),
        "a4": ("failed", None, "e", "incomplete_chain,low_confidence,semantic_drift"), "a5": ("failed", "obligation", "d", "syntax_error,semantic_drift,invalid_references")}


def test_documents_are_dealt_once_for_their_events(spark, sf):
    """What becomes one object a document is not shuffled as objects: artifacts lie as their clauses were dealt, and verdicts are
    dealt before their texts are made."""
    parsed, reg = registry._parsed(spark, sf), registry.corpus.registry(spark)
    hits, plan = mapping.clause_hits(parsed, reg), lambda df: df._jdf.queryExecution().executedPlan().toString()
    made = artifacts.compile_rules(mapping.map_clauses(parsed.repartition(7, "doc_id"), reg, hits=hits), ("yaml", "sql"))
    found = plan(events.by_document(made, F.col("doc_id"), "artifacts"))
    assert found.count("hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in found
    judged = pipeline.judge_rules(artifacts.compile_rules(mapping.map_clauses(parsed, reg, hits=hits), ("yaml", "sql"), carry=True), ("yaml", "sql"), tasks=7)
    objects = events.by_document(judged, F.col("doc_id"), "results", apart=("doc_id",))
    assert plan(objects).count("hashpartitioning(") == 1 and plan(objects).index("hashpartitioning(") < plan(objects).index("ArrowEvalPython")
    assert "doc_id" not in objects.schema["results"].dataType.elementType.names and objects.count() == 150


def test_published_events_are_compressed_well(spark, tmp_path):
    rows = spark.createDataFrame([("policy.parsed", "D1", "{}", None)], events.EVENT)
    events.publish(rows, f"{tmp_path}/e")
    assert glob.glob(f"{tmp_path}/e/topic=policy.parsed/*.zstd.parquet")


def test_tasks_grow_with_rows(spark, tmp_path):
    assert tasks_of(spark.range(1000), 10) == 100 and tasks_of(spark.range(3), 10) == spark.sparkContext.defaultParallelism
