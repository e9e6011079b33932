import random
import re

import pytest
from pyspark.sql import functions as F

from normweave.operators import clauses as C


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize("text, kind", [
    ("Staff must log in.", "obligation"), ("Staff shall not leave.", "prohibition"), ("Smoking is prohibited here.", "prohibition"),
        ("Guests may not enter.", "permission"), ("Guests are permitted to wait.", "permission"),
    ("If asked, staff must answer.", "conditional"), ("When late, call.", "conditional"), ("Wire means a payment.", "definition"),
        ("A day is defined as 24 hours.", "definition"), ("Staff must go unless told.", "exception"),
    ("Notification matters.", "conditional"), ("This requires care.", "obligation"), ("", "obligation"), ("   ", "obligation"),
])
def test_types(spark, text, kind):
    assert one(spark, C.clause_type, text) == kind


def test_components(spark):
    rows = [("The bank must verify client papers within 30 days.",), ("American bank pays.",),
        ("Costs ($5) must fall, if sales drop, daily.",), ("Staff must not share x, for 2 years.",), ("",), (None,)]
    out = [r.asDict() for r in C.parse(spark.createDataFrame(rows, "source_text string")).collect()]
    assert (out[0]["actor"], out[0]["verb"], out[0]["object"], out[0]["deadline"]) == ("The bank", "verify", "client papers within 30 days", "30 days")
    assert out[1]["verb"] == "bank" and out[1]["actor"] == C.NO_ACTOR
    assert out[2]["actor"] == C.NO_ACTOR and out[2]["trigger"] == "sales drop" and out[2]["frequency"] == "daily"
    assert out[3]["object"] == "share x" and out[3]["duration"] == "2 years"
    assert out[4]["verb"] == C.NO_VERB and out[4]["object"] is None and out[5]["actor"] == C.NO_ACTOR
    assert C.nested(C.parse(spark.createDataFrame([("d", "c", "k", "Go.")],
                "doc_id string, clause_id string, chunk_id string, source_text string"))).first()["temporal_scope"] is None


def test_context_equals_a_loop(spark):
    def loop(text):
        out, held = [], []
        for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text)):
            if not s:
                continue
            if re.search(r"\b(must|shall|may|should|required|prohibited|permitted|means|defined|except|unless|if|when|where)\b", s, re.I):
                ctx = " ".join(held)
                out.append(f"{ctx} {s}" if held and len(ctx) < 100 else s)
                held = []
            else:
                held.append(s)
        return out or ([" ".join(held)] if held else [])

    rng = random.Random(5)
    s = lambda: rng.choice(["We go.", "They must go!", "It was long and it was far and nobody knew the way at all.", "Where is it?",
            "Nobody may; none.", "Musty mayhem."])
    texts = [rng.choice([" ", "\n", "  "]).join(s() for _ in range(rng.randint(0, 9))) for _ in range(200)] + ["", " "]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.clause_texts(F.col("t")).alias("c")).collect():
        assert r["c"] == loop(r["t"])


def test_numbers_and_json(spark):
    chunk = spark.createDataFrame([("D", "S", "D_S001_C000", "A must b. C must d.")], "doc_id string, section_id string, chunk_id string, text string")
    assert [r["clause_id"] for r in C.split_clauses(chunk).orderBy("clause_ord").collect()] == ["D_D_S001_C000_CL001", "D_D_S001_C000_CL002"]
    assert one(spark, C.recovered_json, 'x ```json\n{"a": 1}\n``` y').strip() == '{"a": 1}' and one(spark, C.recovered_json,
        'so: {"a": {"b": 2}} ok') == '{"a": {"b": 2}}' and one(spark, C.recovered_json, "no") is None
    assert one(spark, C.cross_references, "See Section 2 and section 4.2, not sections.") == ["2", "4.2"]
    bad = spark.createDataFrame([(0.999,), (1.5,), (-0.1,)], "confidence double")
    assert [r["confidence"] for r in C.valid_confidence(bad).collect()] == [1.0]
