import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from normweave.functions import text as T
from normweave.operators import clauses, structure
from normweave.operators.structure import ChunkSizes
from normweave.plans import oracle


def test_chunks_equal_a_recursion(spark):
    """Random texts, small sizes: the fold against DuckDB's recursion over paragraphs and sentences."""
    rng, sizes = random.Random(3), ChunkSizes(target=20, least=6, most=30, overlap=4)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice(".!?,")
    texts = ["\n\n".join(" ".join(sentence() for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 7)))
        for _ in range(150)] + ["", "  \n\n \n", "x" * 500]
    sections = spark.createDataFrame([(f"D{i}", f"D{i}_S001", t) for i, t in enumerate(texts)], "doc_id string, section_id string, text string")
    frame = sections.toPandas()  # noqa: F841  DuckDB finds it by name
    want = duckdb.sql(
        f"WITH RECURSIVE sections AS (SELECT * FROM frame), {oracle.chunk_cte(20, 6, 30, 4)} SELECT section_id, chunk_ord, text FROM chunked").fetchall()
    got = [(r["section_id"], r["chunk_ord"], r["text"]) for r in structure.chunks(sections, sizes).collect()]
    assert len(want) > 300 and sorted(got) == sorted(want)


def test_parents_are_the_nearest_earlier_smaller_level(spark):
    rng = random.Random(4)
    docs = [[rng.randint(1, 6) for _ in range(rng.randint(1, 15))] for _ in range(80)]
    rows = [(f"D{i}", f"D{i}", "before\n" + "".join(f"{'#' * n} h{k}\nbody {k}\n" for k, n in enumerate(d))) for i, d in enumerate(docs)]
    found = structure.markdown_sections(spark.createDataFrame(rows, "doc_id string, doc_key string, text string")).collect()
    by_id = {r["section_id"]: r for r in found}
    for i, d in enumerate(docs):
        for k, n in enumerate(d, 1):
            above = max((j for j in range(1, k) if d[j - 1] < n), default=None)
            r = by_id[f"D{i}_S{k:03d}"]
            assert (r["parent_section"], r["hierarchy_level"], r["text"]) == (above and f"D{i}_S{above:03d}", n, f"body {k - 1}")
    sections = spark.createDataFrame([(r["doc_id"], r["section_ord"], r["hierarchy_level"], r["parent_section"]) for r in found],
        "doc_id string, section_ord int, hierarchy_level int, expected string")
    for r in structure.parents(sections).collect():
        assert r["expected"] == (f"{r['doc_id']}_S{r['parent_ord']:03d}" if r["parent_ord"] else None)


def test_markdown_edges(spark):
    rows = [("A", "A", None), ("B", "B", "plain text\nno heading"), ("C", "C", "# One\r\nx\r\n## Two: \"q\" & (r)\n\n# Last"),
        ("E", "E", "#no heading\n####### seven")]
    out = {(r["doc_id"], r["section_ord"]): r for r in structure.markdown_sections(spark.createDataFrame(rows,
                "doc_id string, doc_key string, text string")).collect()}
    assert out["B", 1]["section_title"] == structure.DEFAULT_TITLE and out["B", 1]["text"] == "plain text\nno heading"
    assert [out["C", k]["section_title"] for k in (1, 2, 3)] == ["One", 'Two: "q" & (r)', "Last"]
    assert out["C", 1]["text"] == "x" and out["C", 3]["text"] == "" and ("A", 1) not in out and ("E", 2) not in out


def test_html(spark):
    pages = [(1, "<nav>menu</nav><h1>A &amp; B</h1><p>one</p><!-- <h2>no</h2> --><h2>C</h2><div>two<br>three</div><script>x<y</script>"),
        (2, "<p>only</p><p>text</p>"), (3, None)]
    out = {(r["page_id"], r["section_ord"]): (r["section_title"], r["hierarchy_level"], r["text"])
        for r in structure.html_sections(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert out[1, 1] == ("A & B", 1, "one") and out[1, 2] == ("C", 2, "two\n\nthree") and out[2, 1] == (structure.DEFAULT_TITLE, 1,
        "only\n\ntext") and (3, 1) not in out


def test_character_references(spark):
    texts = {"a &amp;lt; b": "a &lt; b", "&eacute;&#233;&#xE9;&#X1F600;": "\u00e9\u00e9\u00e9\U0001f600",
        "R&D &unknown; &; &#0; &#xD800; &#99999999;": "R&D &unknown; &; &#0; &#xD800; &#99999999;",
        "x&nbsp;y &lt;&quot;&#39;&apos;&gt;": "x y <\"''>", "": "", "&": "&", "&hellip;a;b": "\u2026a;b"}
    rows = spark.createDataFrame([(k,) for k in texts], "t string").select("t", structure.unescape_html(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == texts


def test_scalars(spark):
    row = spark.range(1).select(
        T.doc_key(F.lit("  My file-(v2)  ")).alias("key"), T.doc_key(F.lit("日本")).alias("none"),
            T.shorten(F.lit("abcdef"), 3).alias("short"), T.first_words(F.lit("a  b c d"), 3).alias("three"),
        T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(5.0))).alias("same"),
            T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), T.strip(F.lit("\t a \n")).alias("s"),
    ).first()
    assert (row["key"], row["none"], row["short"], row["three"], row["zero"], row["s"]) == ("MY_FILE_V2", "", "abc...", "a b c", 0.0,
        "a") and 0 < row["same"] < 1


@pytest.mark.parametrize("kind", ["headings", "paragraphs", "sentences"])
def test_folds_grow_with_the_text(spark, kind):
    """Twice the headings, paragraphs or sentences take at most two and a half times as long."""

    def seconds(n):
        if kind == "headings":
            df = structure.markdown_sections(spark.createDataFrame([("d", "d", "".join(f"{'#' * (i % 6 + 1)} t{i}\nbody {i}\n" for i in range(n)))], "doc_id string, doc_key string, text string"))
        elif kind == "paragraphs":
            df = structure.chunks(spark.createDataFrame([("d", "s", "\n\n".join("word " * 30 for _ in range(n)))], "doc_id string, section_id string, text string"))
        else:
            df = clauses.split_clauses(spark.createDataFrame([("d", "s", "c", " ".join(f"Staff must do item {i}." for i in range(n)))], "doc_id string, section_id string, chunk_id string, text string"))
        took = []
        for _ in range(3):
            began = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(1000)  # compiles
    assert min(seconds(20_000) / seconds(10_000) for _ in range(3)) <= 2.5  # the machine may be busy


@pytest.mark.parametrize(("html", "want", "wide"), [
    ("<nav>a<nav>b</nav>c</nav><h1>T</h1>x", [("T", 1, "x")], None),
    ("<header><nav>a</header>left<h1>T</h1>x<footer>f<div><footer>g</footer>h</div>i</footer>y", [("T", 1, "x y")], None),
    ("<div><h2>A</h2><p>one</p></div><p>out</p><h2>B</h2>two", [("A", 2, "one"), ("B", 2, "two")], [("A", 2, "one\n\nout"), ("B", 2, "two")]),
    ("<h1>A</h1><div>in<h3>B</h3>deep</div>tail<h2>C</h2>end", [("A", 1, "in\n\nB\n\ndeep\n\ntail"), ("B", 3, "deep"), ("C", 2, "end")],
        [("A", 1, "in"), ("B", 3, "deep\n\ntail"), ("C", 2, "end")]),
    ("<h1>A<b>!</b></h1>x</div></p>y<br/>z", [("A!", 1, "x\n\ny\n\nz")], None),
    ("<div><h2>lost</div>after", [("lost", 2, "")], [("lost", 2, "after")]),
    ("<h2>never closed <i>x", [("never closed x", 2, "")], None),
    ("<nav><h1>menu</h1></nav><p>text</p>", [("Document Content", 1, "text")], None),
    ("<h1>1 < 2</h1>a<b", [("1 < 2", 1, "a<b")], None),
    ("<H1 class='x'>Up</H1><img src=a>p<!-- <h2>no</h2> --><script>if(a<b){'<h2>'}</script>q", [("Up", 1, "p q")], None), ("   ", [], None), ("<nav>only</nav>", [], None),
])
def test_html_by_a_tag_stack(spark, html, want, wide):
    df = spark.createDataFrame([(7, html)], "page_id int, html string")
    for siblings, expected in ((True, want), (False, wide or want)):
        rows = structure.html_sections(df, siblings=siblings).orderBy("section_ord").collect()
        assert [(r["section_title"], r["hierarchy_level"], " ".join(r["text"].split(" "))) for r in rows] == expected or [
            (r["section_title"], r["hierarchy_level"], " ".join(r["text"].split())) for r in rows] == [(t, n, " ".join(x.split())) for t, n, x in expected]


def test_short_ways_equal_the_folds(spark, monkeypatch):
    """Parents by string functions and chunks of short texts, against the folds that serve long ones."""
    texts = ["# a\n### b\n## c\n#\td\r\nbody\r\n##### e\n###### f\n## g # h", "intro\n## x\n\n y \n\nz\n# \u00e9t\u00e9\n", "no heading\n\n\n two ", " \n", None, "#x\n####### y\n",
        "".join(f"{'#' * (1 + i * i % 6)} t{i}\n{'word. ' * (i % 5)}\n\n" for i in range(200))]
    docs = spark.createDataFrame([(f"d{i}", f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, doc_key string, text string")
    found = lambda: (sorted(map(tuple, structure.markdown_sections(docs).collect()), key=str),
        sorted(map(tuple, structure.chunks(structure.markdown_sections(docs), structure.ChunkSizes(most=40)).collect()), key=str))
    short = found()
    monkeypatch.setattr(structure, "SHORT_SCAN", 0)
    long = found()
    assert short == long and len(short[0]) > 200
    monkeypatch.setattr(structure, "SHORT_SCAN", 1_000)
    assert found()[0] == long[0]
