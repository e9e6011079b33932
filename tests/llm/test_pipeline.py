"""Each stage of the pipeline against brute force on its own input."""

import collections
import hashlib

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from normweave.llm import bpe_lexicon, quality_rules
from normweave.llm.common import cut
from tests.llm.test_pairs_and_groups import brute, check_mix
from tests.oracle import connect


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"kept": F.lit("extra"), "row": F.lit(1)})
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality rules", "language ID", "near copies", "mixing", "BPE"]
    passed = {}
    for name, stage in corpus_pipeline.STAGES:
        passed[name] = docs
        docs = cut(stage(spark, docs, sf), "test-stage")
        if name != "BPE":
            assert docs.columns == passed[name].columns
    ids = lambda df: collections.Counter(r["doc_id"] for r in df.collect())
    after = lambda name: passed[[*stages][[*stages].index(name) + 1]] if name != "BPE" else docs
    kept = connect(sf).execute(f"SELECT doc_id FROM ({quality_rules.OP7_SQL}) WHERE kept").fetchall()
    assert ids(after("quality rules")) == collections.Counter(k for k, in kept)
    assert ids(after("language ID")) == ids(passed["language ID"])  # no kept document lacks a clear language
    rows = [(r["doc_id"], r["text"]) for r in passed["near copies"].collect()]
    assert ids(after("near copies")) == collections.Counter(k for k, v in brute(rows).items() if v[0] == k)
    from normweave.llm import source_mixing

    decided = source_mixing.mix(passed["mixing"])[1].collect()
    check_mix(decided, passed["mixing"].count())
    assert ids(after("mixing")) == +collections.Counter({r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in decided})
    lib, text = Tokenizer.from_file(bpe_lexicon.default_path()), {r["doc_id"]: r["text"] for r in passed["BPE"].collect()}
    assert docs.count() == passed["BPE"].count()
    for r in docs.collect():
        assert r["ids"] == lib.encode(text[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def hostile(spark):
    """Null and empty values in every column, long texts, repeated rows, and columns that the stages use themselves."""
    good = "This is a fine line of text, with some words in it; it goes on for a while.\nAnother one follows here, and it ends well.\nAnd a third line number {n} closes the whole text."
    rows = [(k, good.format(n=k), "en", "web", 1) for k in range(30)] + [(None, good.format(n="none"), "en", None, 2),
        (None, None, None, None, None), (40, None, "en", "web", 1), (41, "", "en", "web", 1), (42, "12 34 !?", None, "web", 1)]
    rows += [(50, good.format(n=50), "en", "web", n) for n in (1, 1, 2)] + [(51, good.format(n=50), None, "books", 1)] + [
        (60, " ".join(f"word{i % 977} goes{i}," for i in range(40_000)), "en", "books", 1)]
    taken = ("row", "h", "th", "tie", "times", "place", "score", "lang_pred", "ambiguous", "node", "size", "target", "taken", "ids",
        "quality", "__bucket", "__doc", "doc")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int")
    return docs.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string"))
            for c in taken}).withColumn("tags", F.create_map(F.lit("k"), F.col("extra")))


def test_hostile_rows(spark, sf):
    """Every stage by itself on the hostile rows, and the stages in a chain."""
    docs = cut(hostile(spark), "test-hostile")
    whole = collections.Counter(map(str, docs.collect()))
    chain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and not set(map(str, rows)) - set(whole), name  # rows come back untouched
        if name != "mixing":
            assert not collections.Counter(map(str, rows)) - whole
        kept = [r["doc_id"] for r in rows]
        if name == "quality rules":
            assert set(range(30)) <= set(kept) and not {40, 41, 42} & set(kept) and kept.count(50) == 3 and 60 in kept
        if name == "language ID":
            assert not {40, 41, 42} & set(kept) and 51 in kept and kept.count(None) == 1
        if name == "near copies":
            assert kept.count(50) == 1 and 51 not in kept and kept.count(40) == 1 and 41 not in kept and [r["extra"] for r in rows
                if r["doc_id"] == 50] == [r["extra"] for r in stage(spark, docs, sf).where("doc_id = 50").collect()]
        if name == "mixing":
            assert not {40, 41} & set(kept) and sorted(map(str, rows)) == sorted(map(str, stage(spark, docs.repartition(3),
                        sf).collect()))  # reruns agree, however the rows lie
        chain = cut(stage(spark, chain, sf), "test-hostile")
    assert chain.count() > 0
    assert corpus_pipeline.tokens(spark, docs, sf).count() == docs.count() and corpus_pipeline.tokens(spark, chain, sf).count() == chain.count()


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), "test-empty")
        assert docs.count() == 0


def test_tokens_decode(spark, sf):
    docs = spark.createDataFrame([(1, "en", "a", "Rules apply, \u00e9\U0001f600 to  all."), (2, "en", "a", ""), (3, None, None, None)],
        "doc_id long, lang string, source string, text string")
    lib, rows = Tokenizer.from_file(bpe_lexicon.default_path()), corpus_pipeline.tokens(spark, docs, sf).collect()
    assert len(rows) == 3 and all(r["decoded_sha256"] == hashlib.sha256(lib.decode(r["ids"], skip_special_tokens=False).encode()).hexdigest() for r in rows)


def test_cleaned_text_goes_on(spark, sf):
    good = [" ".join(f"word{k}{c}" for c in "abcdefghij") + ", and so on." for k in range(6)]
    text = "\n".join([good[0], "Home | News | Shop | Login", "", *good[1:], "Click here to read more"])
    docs = spark.createDataFrame([(1, text, len(text), "mine")], "doc_id long, text string, n_chars int, quality string")
    (row,) = corpus_pipeline.rules(spark, docs, sf).collect()
    assert row["text"] == "\n".join(good) and row["n_chars"] == len(row["text"]) and row["quality"] == "mine"
    assert corpus_pipeline.rules(spark, docs.drop("n_chars"), sf).columns == ["doc_id", "text", "quality"]
