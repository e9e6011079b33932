"""Templates with blocks and filters, the file sink, and the states of jobs."""

import datetime
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from normweave.operators import artifacts, mapping
from normweave.plans import corpus
from normweave.sources import files, sink
from normweave.streaming import jobs


def rendered(spark, template, rows=None):
    df = spark.createDataFrame(rows or [("Bank", None, True, 3, [("a", 1.5), ("b", None)], 'say "x"')],
        "actor string, object string, banned boolean, n int, parts array<struct<name:string,weight:double>>, text string")
    return [r[0] for r in df.select(artifacts.from_text(template)()).collect()]


@pytest.mark.parametrize(("template", "want"), [
    ("plain { text } % }", "plain { text } % }"), ("", ""),
    ("{{actor}}/{{ object }}/{{ n }}", "Bank//3"),
    ("{{ actor | upper }} {{ object | default('nobody') | upper }} {{ actor|truncate(2) }} {{ actor | replace('an', \"oo\") | lower }}", "BANK NOBODY Ba... book"),
    ("{{ text | json }}", '"say \\"x\\""'),
    ("{% if banned %}no{% else %}yes{% endif %}{% if object %}!{% endif %}{% if not object %}?{% endif %}", "no?"),
    ("{% if actor == 'Desk' %}a{% elif actor != \"Bank\" %}b{% elif n == 3 %}c{% else %}d{% endif %}", "c"),
    ("{% if banned %}{% if object %}x{% else %}{% if n %}deep{% endif %}{% endif %}{% endif %}", "deep"),
    ("{% for p in parts %}{{ p.name | upper }}{% if p.weight %}={{ p.weight }}{% endif %} of {{ actor }};{% endfor %}", "A=1.5 of Bank;B of Bank;"),
])
def test_template_language(spark, template, want):
    assert rendered(spark, template) == [want]


def test_templates_of_nulls_and_empty_arrays(spark):
    rows = [(None, "", False, 0, [], ""), (None, None, None, None, None, None)]
    assert rendered(spark, "[{{ actor }}{% if object %}o{% endif %}{% if banned %}b{% endif %}{% if n %}n{% endif %}{% for p in parts %}p{% endfor %}]", rows) == ["[]", "[]"]


@pytest.mark.parametrize("template", ["{% if a %}x", "{% for a in b %}x", "{% endif %}", "{{ a | shout }}", "{% while a %}{% endwhile %}", "{{ a b }}", "{{ }}", "{% if a > 3 %}{% endif %}"])
def test_faulty_templates_are_errors(template):
    with pytest.raises(ValueError):
        artifacts.from_text(template)


def clause_rules(spark, path, kinds):
    rows = [(f"D_C{k}", "D", "D_S001", "D_S001_C000", f"Staff must do {k}", kind, "staff", "do", None, None, None, None, None, 0.75, []) for k, kind in enumerate(kinds)]
    parsed = spark.createDataFrame(rows, "clause_id string, doc_id string, section_id string, chunk_id string, source_text string, type string, actor string, verb string, object string, trigger string, deadline string, duration string, frequency string, confidence double, cross_references array<string>")
    return artifacts.compile_rules(mapping.map_clauses(parsed, corpus.registry(spark)), ("note",), files.templates_in(spark, str(path)))


def test_types_without_a_template(spark, tmp_path):
    (tmp_path / "note").mkdir()
    (tmp_path / "note/obligation.txt").write_text("{{ clause_id }}: {% if actor_path %}{{ actor_path }}{% endif %}")
    (tmp_path / "note/permission.txt").write_text("may")
    assert sorted(r["content"] for r in clause_rules(spark, tmp_path, ["obligation", "permission"]).collect()) == ["D_C0: staff.staff_id", "may"]
    with pytest.raises(Exception, match="no template for note/definition"):
        clause_rules(spark, tmp_path, ["obligation", "definition"]).collect()


# -- the sink


def below(path):
    return {str(p.relative_to(path)): p.read_text() for p in pathlib.Path(path).rglob("*") if p.is_file()}


def some_artifacts(spark, docs, text="v1"):
    rows = [(f"D{d}", f"D{d}/D{d}_C{k}.yaml", f"{text} {d} {k}") for d in docs for k in range(3)]
    return spark.createDataFrame(rows, "doc_id string, file_path string, content string")


def test_one_file_an_artifact(spark, tmp_path):
    sink.write_files(some_artifacts(spark, range(6)), str(tmp_path))
    assert below(tmp_path) == {f"D{d}/D{d}_C{k}.yaml": f"v1 {d} {k}" for d in range(6) for k in range(3)}
    sink.write_files(some_artifacts(spark, [1, 9], "v2").where("file_path NOT LIKE '%C2%'"), str(tmp_path))
    now = below(tmp_path)
    assert {k: v for k, v in now.items() if k.startswith("D1/")} == {f"D1/D1_C{k}.yaml": f"v2 1 {k}" for k in range(2)}  # replaced as a whole
    assert len(now) == 15 + 2 + 2 and not (tmp_path / "_staging").exists()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    sink.write_files(some_artifacts(spark, range(2)), str(tmp_path))
    before = below(tmp_path)
    bad = some_artifacts(spark, range(8), "v3").withColumn("content", F.when(F.col("file_path") == "D5/D5_C2.yaml", F.raise_error(F.lit("lost"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        sink.write_files(bad, str(tmp_path))
    assert below(tmp_path) == before
    for path in ("D0/../x", "../x", "flat", "/D0/x", "_staging/x"):
        with pytest.raises(Exception, match="not a document"):
            sink.write_files(spark.createDataFrame([("D0", path, "c")], "doc_id string, file_path string, content string"), str(tmp_path))
    assert below(tmp_path) == before


def test_an_attempt_that_ran_twice(tmp_path):
    """Two attempts wrote all, or a part; one is committed."""
    writer = sink.ArtifactWriter(str(tmp_path))
    rows = [{"file_path": f"D/{k}.txt", "content": None if k == 3 else str(k)} for k in range(4)]
    first, second = writer.write(iter(rows[:2])), writer.write(iter(rows))
    assert first.folder != second.folder
    writer.commit([None, second])
    assert below(tmp_path) == {"D/0.txt": "0", "D/1.txt": "1", "D/2.txt": "2", "D/3.txt": ""}


# -- the states of jobs


def job_events(seed):
    rng, at = random.Random(seed), datetime.datetime(2026, 1, 1)
    rows = [(rng.randrange(60), i, rng.choice(["created", "started", "completed", "failed", "beat", "beat", None]), at + datetime.timedelta(minutes=rng.randrange(2000))) for i in range(400)]
    return rows + rows[:40] + [(None, 900, "failed", at), (1, None, "failed", at), (1, 901, "failed", None)]


JOB = "job_id long, event_id long, kind string, at timestamp"


def by_hand(rows, horizon, idle=datetime.timedelta(hours=2)):
    events = {}
    for job, event, kind, at in rows:
        if None not in (job, event, at):
            events.setdefault(job, {})[event] = min((at, kind or ""), events.get(job, {}).get(event, (at, kind or "")))
    out = {}
    for job, own in events.items():
        last, n, status, end = None, 0, "pending", None
        for at, _, kind in sorted((at, e, kind) for e, (at, kind) in own.items()):
            if last is not None and at > last + idle:
                status, end = "timed_out", last + idle
                break
            last, n = at, n + 1
            status = "processing" if kind == "started" else status
            if kind in ("completed", "failed"):
                status, end = kind, at
                break
        if end is None and last + idle <= horizon:
            status, end = "timed_out", last + idle
        out[job] = status, end, n
    return out


def test_job_states(spark):
    horizon = datetime.datetime(2026, 1, 2, 8)
    rows = job_events(2) + [(100, 950, "created", horizon), (101, 951, "started", horizon), (101, 952, "beat", horizon + datetime.timedelta(hours=1))]
    df = spark.createDataFrame(rows, JOB)
    got = {r["job_id"]: (r["status"], r["ended_at"], r["n_events"]) for r in jobs.states(df, F.lit(horizon)).collect()}
    assert got == by_hand(rows, horizon) and len({v[0] for v in got.values()}) == 5
    assert jobs.states(df.limit(0), F.lit(horizon)).count() == 0


def test_jobs_as_a_stream(spark, tmp_path):
    """In four batches, with repeated events and events out of order: the jobs that the batch sees ended by the watermark."""
    rows = job_events(3)
    df = spark.createDataFrame(rows, JOB)
    start = datetime.datetime(2026, 1, 1)
    for k in range(4):  # one after another, for the source takes files by their time
        part = F.floor((F.unix_seconds("at") - F.unix_seconds(F.lit(start))) / 30_001)
        df.where(F.coalesce(part, F.lit(0)) == k).coalesce(1).sortWithinPartitions(F.xxhash64("event_id")).write.mode("append").parquet(f"{tmp_path}/e")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    jobs.rocks(spark)
    try:
        stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
        jobs.ended(stream).writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(
            availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    horizon = max(r[3] for r in rows if r[3]) - datetime.timedelta(hours=1)
    got = [(r["job_id"], (r["status"], r["ended_at"], r["n_events"])) for r in spark.read.parquet(f"{tmp_path}/o").collect()]
    want = {k: v for k, v in by_hand(rows, horizon).items() if v[1] is not None and v[1] < horizon}
    assert len(got) == len(dict(got)) and dict(got) == want and len(want) > 30
