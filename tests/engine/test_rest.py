import ast
import datetime
import json
import zipfile

import pytest
import yaml
from pyspark.sql import functions as F

from normweave.operators import artifacts, clauses, lineage, mapping, metrics, rules, validation, views
from normweave.plans import corpus, pipeline
from normweave.sources import files
from normweave.streaming import events, validate as stream


def parsed(spark, *texts):
    rows = [("D", "D_S001", "D_S001_C000", i, f"D_CL{i:03d}", t) for i, t in enumerate(texts, 1)]
    return clauses.parse(spark.createDataFrame(rows,
            "doc_id string, section_id string, chunk_id string, clause_ord int, clause_id string, source_text string")).withColumn("cross_references", F.array().cast("array<string>"))


def test_cascade(spark):
    reg = corpus.registry(spark)
    names = spark.createDataFrame([("BANK",), ("Customer",), ("account holder",), ("log entries",), ("client identity",),
            ("nothing like it",)], "entity string")
    out = {r["entity"]: r for r in mapping.map_entities(names, reg).collect()}
    assert (out["BANK"]["target_path"], out["BANK"]["target_schema"], out["BANK"]["confidence"]) == ("house.bank_id", "org", 1.0)
    assert out["Customer"]["mapping_method"] == "exact" and out["account holder"]["mapping_method"] == "synonym" and out["log entries"]["target_path"] == "ledger.record"
    assert out["client identity"]["mapping_method"] != "exact"  # labels of several words never match the joined key
    lost = out["nothing like it"]
    assert lost["target_path"] is None and len(lost["suggestions"]) == 3 and all(s["confidence"] >= 0 for s in lost["suggestions"]) and "0.7" in lost["reason"]
    assert mapping.map_entities(names, reg, threshold=-1.0).where("mapping_method = 'semantic'").count() == 2
    only = {r["entity"]: r["mapping_method"] for r in mapping.map_entities(names, reg.only("archive")).collect()}
    assert only["Customer"] is None and only["BANK"] == "manual"
    more = reg.with_synonym("client", "patron").with_override("Thing", "x:y.z")
    assert {r["entity"]: r["target_path"] for r in mapping.map_entities(spark.createDataFrame([("patron",), ("thing",)], "entity string"),
            more).collect()} == {"patron": "client.client_id", "thing": "y.z"}


def test_status_and_empty(spark):
    reg = corpus.registry(spark)
    p = parsed(spark, "Client must provide proof.", "Client must provide zzz qqq.", "Qqq must go.", "Nothing.")
    got = {r["clause_id"][-1]: r["mapping_status"] for r in mapping.map_clauses(p, reg).collect()}
    assert got == {"1": "complete", "2": "partial", "3": "needs_review", "4": "needs_review"}
    assert mapping.map_clauses(p.limit(0), reg).count() == 0


def test_hostile_text_stays_inert(spark):
    p = parsed(spark, 'Staff must say "hi"; DROP TABLE x; -- {{ a }} \'q\' ${b} <script> unless\nnew line: # y.',
        "Client must not share a 'thing'.", "Wire means \\ back.")
    made = artifacts.check_syntax(artifacts.compile_rules(mapping.map_clauses(p, corpus.registry(spark)), tuple(artifacts.EXTENSIONS))).collect()
    assert len(made) == 18 and all(r["syntax_valid"] for r in made), [r["content"] for r in made if not r["syntax_valid"]]
    for r in made:
        if r["format"] == "json":
            assert json.loads(r["content"])["rule_id"] == r["clause_id"]
        if r["format"] == "yaml":
            assert yaml.safe_load(r["content"])["control"]["id"] == r["clause_id"]
        if r["format"] == "python":
            tree = ast.parse(r["content"])
            scope = {}
            exec(compile(tree, "rule", "exec"), scope)
            for name, f in scope.items():
                if name.startswith("test_"):
                    f()
        if r["format"] == "sql" and r["type"] == "prohibition":
            assert "CHECK (NOT share_status)" in r["content"]
    with pytest.raises(ValueError):
        artifacts.compile_rules(mapping.map_clauses(p, corpus.registry(spark)), ("cobol",))


def test_syntax_checks(spark):
    rows = [("yaml", "a: !odd 1"), ("yaml", "a: 2001-99-99"), ("yaml", "? [a]\n: 1"), ("yaml", "a: *lost"), ("yaml", "a: [1"), ("yaml", "a: 1"), ("python", "def f(:"), ("json", "{"), ("json", "{}"), ("terraform", "a {"),
        ("terraform", 'a = "x'), ("sql", "  "), ("sql", "MERGE x"), ("rego", "x"), ("other", None)]
    out = [(r["syntax_valid"], len(r["warnings"])) for r in artifacts.check_syntax(spark.createDataFrame(rows, "format string, content string")).collect()]
    assert out == [(False, 0)] * 4 + [(False, 0), (True, 0), (False, 0), (False, 0), (True, 0), (False, 0), (False, 0), (False, 1), (True, 1), (True, 2), (True, 0)]


def test_resource_types(spark):
    row = spark.range(1).select(*[artifacts.resource_type(F.lit(x)).alias(x) for x in ("Data team", "VPC owner", "server", "db admin",
                "clerk", "database")]).first().asDict()
    assert row == {"Data team": "storage_bucket", "VPC owner": "network", "server": "instance", "db admin": "database",
        "clerk": "generic_resource", "database": "storage_bucket"}


def test_validation(spark):
    p = parsed(spark, "Client must provide proof.", "Qqq must go.").withColumn("cross_references",
        F.when(F.col("clause_ord") == 2, F.array(F.lit("D_CL001"), F.lit("nope"))).otherwise(F.array().cast("array<string>")))
    m = mapping.map_clauses(p, corpus.registry(spark))
    a = artifacts.check_syntax(artifacts.compile_rules(m, ("json",)))
    broken = a.limit(1).withColumns({"artifact_id": F.lit("X"), "clause_id": F.lit("absent")})
    out = {r["artifact_id"]: r for r in validation.validate(a.unionByName(broken), p, m).collect()}
    assert out["D_CL001_json"]["validation_status"] == "passed" and out["D_CL001_json"]["confidence_score"] == 0.883
    two = out["D_CL002_json"]
    assert two["validation_status"] == "needs_review" and two["review_flags"] == ["below_threshold", "invalid_references"]
    lost = out["X"]
    assert lost["validation_status"] == "failed" and lost["review_flags"][0] == "incomplete_chain" and "parsed_clause" in lost["validation_checks"][0]["message"]
    assert validation.summary(validation.validate(a, p, m)).first().asDict() == {"total": 2, "passed": 1, "failed": 0, "needs_review": 1}
    v = validation.validate(a, p, m)
    g = lineage.edges(v)
    assert {(r["document"], r["clause"]) for r in lineage.trace(g, v.select("artifact_id")).collect()} == {("document:D", "clause:D_CL001"),
        ("document:D", "clause:D_CL002")}
    assert lineage.nodes(v).count() == 7 and lineage.dot_lines(lineage.nodes(v), g).count() == 2 + 7 + g.count()
    assert spark.range(1).select(validation.lineage_section(F.lit("DOC_AB12CD_DOC_S001_C000_CL001")).alias("s")).first()["s"] == "DOC_AB12CD_DOC_S001"


def test_rules(spark):
    facts = spark.createDataFrame([(1, "a", "go", "x", None, None, None, None), (2, "A", "go", "x", "violation", True, True, True)],
        "entity_id int, actor string, action string, object string, status string, completed boolean, attempted boolean, condition_met boolean").withColumn("ts", F.lit(datetime.datetime(2026, 1, 1)))
    rule = spark.createDataFrame([("o", "obligation", "a", "go", "x", False, "high"), ("p", "prohibition", "a", "go", None, False, "low"),
            ("q", "permission", "a", "go", None, False, "low")],
        "rule_id string, type string, actor string, action string, object string, has_condition boolean, severity string")
    assert rules.check_violations(facts, F.col("completed")).count() == 0  # null passes a CHECK
    out = {(r["entity_id"], r["rule_id"]): r["violated"] for r in rules.validator_outcomes(facts, rule).collect()}
    assert out == {(1, "o"): True, (2, "o"): False, (1, "p"): False, (2, "p"): True, (1, "q"): False, (2, "q"): True}
    assert rules.trigger_log(facts, rule).where("rule_id = 'p'").first()["severity"] == "critical"
    assert {r["entity_id"]: (r["allow"], r["violations"]) for r in rules.decisions(facts, rule).collect()} == {1: (True, 2), 2: (True, 1)}
    pair = rules.validator_outcomes(rules.fixture_pairs(rule).withColumn("ts", F.lit(None)), rule)
    assert {r["violated"] for r in pair.where("entity_id = concat(rule_id, '_violating')").collect()} == {True} and {r["violated"]
        for r in pair.where("entity_id = concat(rule_id, '_compliant')").collect()} == {False}
    assert spark.range(1).select(rules.prohibition_predicate(F.lit(True)).alias("i"),
        rules.prohibition_predicate(F.lit(True), True).alias("e")).first().asDict() == {"i": False, "e": True}
    assert rules.retention(rule).where("rule_id = 'p'").first()["retention_days"] == 730


def test_metrics(spark):
    rows = [("a", float(v)) for v in range(10)] + [("b", 1.0)] * 3 + [("c", None)]
    out = {r["k"]: r for r in metrics.histogram_stats(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert (out["a"]["p50"], out["a"]["p95"], out["a"]["p99"]) == (5.0, 9.0, 9.0) and out["b"]["p50"] == 1.0 and "c" not in out


def test_views(spark):
    a = spark.createDataFrame([(1, "low"), (2, "critical"), (3, "odd")], "id int, severity string")
    assert [r["id"] for r in a.orderBy(views.severity_rank(F.col("severity"))).collect()] == [2, 1, 3] and views.outside_domain(a).first()["id"] == 3
    assert views.insert_absent(a, spark.createDataFrame([(3, "x"), (4, "y"), (4, "y")], "id int, severity string"), "id").count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "My Policy.md").write_text("# A\nStaff must go.\n## B\nx", encoding="utf-8")
    (tmp_path / "page.HTML").write_text("<h1>T</h1><p>Client may wait.</p>")
    (tmp_path / "x.xyz").write_text("?")
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s,
        t in (("Normal", "Intro."), ("Heading2", "Sub"), ("Normal", "Body.")))
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml",
            f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    raw = files.raw_files(spark, str(tmp_path))
    assert [r["reason"] for r in files.rejected(raw).collect()] == ["Unsupported format: .xyz"]
    docs = files.documents(files.supported(raw), F.lit("2026-01-01T00:00:00"))
    assert files.damaged(docs).count() == 0
    out = {(r["doc_id"][:-7], r["section_title"]): r["text"] for r in files.sections_of(docs).collect()}
    assert out == {("MY_POLICY", "A"): "Staff must go.", ("MY_POLICY", "B"): "x", ("PAGE", "T"): "Client may wait.",
        ("D", "Untitled Section"): "Intro.", ("D", "Sub"): "Body."}


def docx(path, *paragraphs):
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' for s, t in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml",
            f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_docx_is_not_markdown(spark, tmp_path):
    docx(tmp_path / "a.docx", ("Heading1", "One"), ("Normal", "# no heading"), ("HeadingX", "Two"), ("Normal", "b"), ("Heading3", "Three"),
        ("Normal", "c"), ("Normal", "d"))
    docx(tmp_path / "empty.docx")
    (tmp_path / "bad.docx").write_bytes(b"PK no zip")
    (tmp_path / "blank.md").write_text(" \n ")
    docs = files.documents(files.supported(files.raw_files(spark, str(tmp_path))), F.lit("2026-01-01T00:00:00"))
    out = {r["section_title"]: (r["hierarchy_level"], r["parent_section"], r["text"]) for r in files.sections_of(docs).collect()}
    assert out == {"One": (1, None, "# no heading"), "Two": (1, None, "b"), "Three": (3, "A_S002", "c\n\nd")}
    bad = files.damaged(docs).collect()
    assert len(bad) == 1 and bad[0]["path"].endswith("bad.docx") and bad[0]["reason"].startswith("Damaged file")


def test_registry_is_saved_as_it_is_read(spark, tmp_path):
    reg, path = corpus.registry(spark), str(tmp_path / "saved")
    files.save_registry(reg.fields, reg.synonyms, reg.overrides, path)
    for old, new in zip((reg.fields, reg.synonyms, reg.overrides), files.registry_tables(spark, path)):
        assert sorted(map(str, old.collect())) == sorted(map(str, new.select(*old.columns).collect()))


def test_templates_from_a_folder(spark, tmp_path):
    (tmp_path / "note").mkdir()
    (tmp_path / "note" / "default.txt").write_text("{{ clause_id }}: {{actor}} {{ object }}!")
    (tmp_path / "note" / "prohibition.txt").write_text("NO {{ verb }}")
    p = parsed(spark, "Client must provide proof.", "Staff must not share data.", "Qqq may go.")
    made = artifacts.compile_rules(mapping.map_clauses(p, corpus.registry(spark)), ("note",), files.templates_in(spark, str(tmp_path)))
    assert {r["clause_id"]: (r["content"], r["template_used"]) for r in made.collect()} == {
        "D_CL001": ("D_CL001: Client proof!", "note/default"), "D_CL002": ("NO share", "note/prohibition"),
        "D_CL003": ("D_CL003: Qqq !", "note/default")}


def test_hooks(spark):
    """A parser's client and an embedding of the caller's."""
    def client(texts):
        return [None if "proof" in t else '```json\n{"actor": "Robot", "confidence": 0.9}\n```' if "Qqq" in t else "no idea" for t in texts]

    rows = spark.createDataFrame([(1, "Client must provide proof."), (2, "Qqq must go."), (3, "Staff must stay.")], "n int, source_text string")
    out = {r["n"]: (r["actor"], r["verb"], r["confidence"]) for r in clauses.parse_by_client(rows, client).collect()}
    assert out == {1: ("Client", "provide", 0.75), 2: ("Robot", "go", 0.9), 3: ("Staff", "stay", 0.75)}
    one = lambda text: F.array(F.lit(1.0), F.length(text) * 0.0)  # noqa: E731  everything is near everything
    m = mapping.map_clauses(parsed(spark, "Zzz must go."), corpus.registry(spark), embed=one).first()
    assert m["mapped_entities"][0]["mapping_method"] == "semantic" and m["mapping_status"] == "complete"


def test_graph_upsert_and_json(spark):
    kind = "node_id string, node_type string, properties map<string,string>"
    old = spark.createDataFrame([("a", "x", {"k": "1"}), ("b", "x", {})], kind)
    new = spark.createDataFrame([("b", "y", {"k": "1"}, 1), ("b", "z", {"k": "0"}, 2), ("c", "y", None, 1)], kind + ", at int")
    out = {r["node_id"]: r["node_type"] for r in lineage.upsert(old, new, order="at").collect()}
    assert out == {"a": "x", "b": "z", "c": "y"} and lineage.upsert(old, new.drop("at")).where("node_id = 'b'").first()["node_type"] == "z"
    edge = spark.createDataFrame([("e:a->b", "a", "b", "R", None)],
        "edge_id string, source_id string, target_id string, relationship string, confidence double")
    text = "\n".join(r["line"] for r in lineage.json_lines(old, edge).orderBy("ord", "id").collect())
    assert json.loads(text) == {"nodes": [{"node_id": "a", "node_type": "x", "properties": {"k": "1"}}, {"node_id": "b", "node_type": "x",
                "properties": {}}], "edges": [{"edge_id": "e:a->b", "source_id": "a", "target_id": "b", "relationship": "R",
                "confidence": None}]}
    none = "\n".join(r["line"] for r in lineage.json_lines(old.limit(0), edge.limit(0)).orderBy("ord", "id").collect())
    assert json.loads(none) == {"nodes": [], "edges": []}


def test_enforcement(spark):
    facts = spark.createDataFrame([(1, "a", "go", "x", None, True, None, None)],
        "entity_id int, actor string, action string, object string, status string, completed boolean, attempted boolean, condition_met boolean")
    rule = spark.createDataFrame([("o", "obligation", "a", "go", "x", False, "high")],
        "rule_id string, type string, actor string, action string, object string, has_condition boolean, severity string")
    assert rules.enforce(facts, rule).first()["violated"] is False
    broken = facts.withColumn("completed", F.lit(False))
    assert rules.enforce(broken, rule, raise_on_violation=False).first()["violated"] is True
    with pytest.raises(Exception, match="rule o violated by entity 1"):
        rules.enforce(broken, rule).collect()
    assert sorted(map(str, rules.joined(facts, rule, most=0).collect())) == sorted(map(str, rules.joined(facts, rule).collect()))  # by actor and salt


def test_running_totals(spark):
    import random

    rng = random.Random(5)
    rows = [(g, rng.choice((None, *range(40))), i, rng.choice((None, 1, 2, 5))) for g in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, at int, id int, v int")
    out = {r["id"] if r["g"] == "a" else (r["g"], r["id"]): r["t"] for r in metrics.running_total(df, ["g"], ["at", "id"], "v", "t", parts=20).collect()}
    for g in ("a", "b", None):
        total = None
        for _, at, i, v in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
            total = total if v is None else (total or 0) + v
            assert out[i if g == "a" else (g, i)] == total
    assert metrics.running_total(df.limit(0), ["g"], ["at", "id"], "v", "t").count() == 0


def test_metrics_exports(spark):
    rows = [("m_requests_total", "counter", {"path": "/a"}, 2.0, 1), ("m_requests_total", "counter", {"path": "/a"}, 3.0, 2),
        ("m_requests_total", "counter", {}, 1.0, 1), ("m_documents_in_progress", "gauge", {}, 4.0, 1),
        ("m_documents_in_progress", "gauge", {}, 2.0, 2),
            ("m_request_duration_seconds", "histogram", {"path": "/b"}, 0.2, 1),
                ("m_request_duration_seconds", "histogram", {"path": "/b"}, 3.0, 2)]
    seen = metrics.observed(spark.createDataFrame(rows, "name string, kind string, labels map<string,string>, value double, ts int"))
    known = metrics.default_metrics(spark, "m_")
    lines = [r["line"] for r in metrics.prometheus(known, seen).orderBy("name", "ord", "label_key").collect()]
    assert known.count() == 16 and lines.count("# TYPE m_requests_total counter") == 1 and 'm_requests_total{path="/a"} 5.0' in lines and "m_requests_total 1.0" in lines and "m_documents_in_progress 2.0" in lines
    assert 'm_request_duration_seconds_bucket{path="/b",le="0.25"} 1' in lines and 'm_request_duration_seconds_bucket{path="/b",le="+Inf"} 2' in lines and 'm_request_duration_seconds_sum{path="/b"} 3.2' in lines
    assert lines.index("# HELP m_requests_total Calls of the interface") < lines.index("m_requests_total 1.0")
    out = {r["name"]: json.loads(r["json"]) for r in metrics.metrics_json(known, seen).collect()}
    assert out["m_requests_total"]["values"] == {"": 1.0,
        "path=/a": 5.0} and out["m_request_duration_seconds"]["values"]["path=/b"]["count"] == 2 and out["m_active_connections"] == {
        "type": "gauge", "description": "Connections that are open", "values": {}}


def test_registry_file(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"registry_version": "1", "schemas": [{"schema_id": "s", "schema_type": "sql", "version": "1",
                        "tables": [{"table_name": "t", "fields": [{"field_name": "f", "field_type": "INT"}]}]}], "synonyms": {"f": ["g"]},
                "manual_overrides": {"H": "s:t.f"}}))
    reg = mapping.Registry(*files.registry_tables(spark, str(path)))
    assert {r["entity"]: r["mapping_method"] for r in mapping.map_entities(spark.createDataFrame([("F",), ("g",), ("h",)], "entity string"),
            reg).collect()} == {"F": "exact", "g": "synonym", "h": "manual"}
    row = spark.createDataFrame([({"a": "1", "b": "2"}, '{"b": "3"}'), ({"a": "1"}, "bad")],
        "s map<string,string>, u string").select(files.merged_metadata(F.col("s"), F.col("u")).alias("m")).collect()
    assert [r["m"] for r in row] == [{"a": "1", "b": "3"}, {"a": "1"}]


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("D", "D_S001", f"D_S001_C{i:03d}", f"Client must provide proof {i}.", f"h{i}", datetime.datetime(2026, 1, 1)) for i in range(3)]
    spark.createDataFrame(rows + rows[:1], stream.CHUNKS).write.parquet(source)
    reg = corpus.registry(spark)
    for _ in range(2):  # a second run finds nothing new
        stream.validated(stream.ingested(spark, source), lambda b: pipeline.compile_chunks(b, reg), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).groupBy("format").count().collect()[0]["count"] == 3


def test_events_are_followed_once(spark, tmp_path):
    path, out = str(tmp_path / "events"), str(tmp_path / "out")
    objects = events.by_document(spark.createDataFrame([("D1", "c2", 2), ("D1", "c1", 1), ("D2", "c3", None)],
            "doc_id string, clause_id string, n int"), F.col("doc_id"), "clauses")
    for _ in range(2):  # published twice, followed once
        events.publish(events.events(objects, "policy.parsed", F.lit(datetime.datetime(2026, 1, 1))), path)
    kind = "doc_id string, clauses array<struct<doc_id:string,clause_id:string,n:int>>"
    stream_of = events.follow(spark, path, "policy.parsed", kind)
    stream_of.writeStream.format("parquet").option("path", out).option("checkpointLocation",
        str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    got = {r["key"]: [c["clause_id"] for c in r["clauses"]] for r in spark.read.parquet(out).collect()}
    assert got == {"D1": ["c1", "c2"], "D2": ["c3"]} and spark.read.parquet(out).count() == 2
    with pytest.raises(ValueError):
        events.events(objects, "policy.lost", F.lit(None))


def test_top_k_in_blocks(spark):
    v = {n: [float(n % 7 + 1), float(n % 5), float(n % 3)] for n in range(60)}
    df = spark.createDataFrame(list(v.items()), "id long, embedding array<double>")
    out = mapping.top_k(df.where("id % 4 = 0").withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "item_id"), 3, query_block=4, item_block=7)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "BroadcastExchange" not in plan
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    want = {(q, n, i) for q in v if q % 4 == 0 for n, i in enumerate(sorted(v, key=lambda i: (-round(cos(v[q], v[i]), 9), i))[:3], 1)}
    assert {(r["query_id"], r["rank"], r["item_id"]) for r in out.collect()} == want
