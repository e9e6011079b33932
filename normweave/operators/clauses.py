"""From chunks to typed clauses with actor, action, object, condition and temporal scope."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from normweave.functions.text import exploded, extract, first_words, let, sentences, strip

#: Words that make a sentence regulatory.
REGULATORY = ("must", "shall", "may", "should", "required", "prohibited", "permitted", "means", "defined", "except", "unless", "if", "when", "where")
CONTEXT_BELOW = 100
#: The classifier's substrings in order of priority.
TYPE_RULES = (
    ("prohibition", ("must not", "shall not", "prohibited")),
    ("definition", ("defined as", "means")),
    ("exception", ("except", "unless")),
    ("permission", ("may", "permitted")),
    ("obligation", ("must", "shall", "required")),
    ("conditional", ("if", "when")),
)
#: Fixed patterns of the components; none has word boundaries.
ACTOR = r"^([\w\s]+?)\s+(?:must|shall|may|should|can)\s"
VERB = r"(?:must|shall|may|should|can)\s+(?:not\s+)?(\w+)"
OBJECTS = (r"(?:verify|maintain|report|submit|provide|ensure)\s+([\w\s]+?)(?:\.|,|$)", r"(?:must|shall)\s+\w+\s+([\w\s]+?)(?:\.|,|$)")
TRIGGERS = (r"(?:if|when|where)\s+([\w\s]+?)(?:,|then|$)", r"(?:before|after|upon)\s+([\w\s]+?)(?:,|\.|$)")
DEADLINE = r"(?:within|by|before)\s+([\w\s]+?)(?:\.|,|$)"
DURATION = r"(?:for|at least|up to)\s+(\d+\s*(?:days?|months?|years?))"
FREQUENCY = r"(annually|monthly|weekly|daily|quarterly)"
#: Words of which a match of each pattern holds one at least.
_MODALS = ("must", "shall", "may", "should", "can")
_WORDS = {ACTOR: _MODALS, VERB: _MODALS, OBJECTS[0]: ("verify", "maintain", "report", "submit", "provide", "ensure"), OBJECTS[1]: ("must", "shall"),
    TRIGGERS[0]: ("if", "when", "where"), TRIGGERS[1]: ("before", "after", "upon"), DEADLINE: ("within", "by", "before"),
    DURATION: ("for", "at least", "up to"), FREQUENCY: ("annually", "monthly", "weekly", "daily", "quarterly")}
CONFIDENCE = 0.75
NO_ACTOR, NO_VERB = "unspecified entity", "comply"


def is_regulatory(sentence: Column) -> Column:
    return sentence.rlike(r"(?iU)\b(" + "|".join(REGULATORY) + r")\b")


def clause_texts(text: Column) -> Column:
    """Array of clause texts of a chunk, by the places of its regulatory sentences; nothing leaves the row.

    Other sentences wait as context; the next regulatory sentence takes them as a prefix if they are short, else
    they go. Without any regulatory sentence the whole text is one clause.
    """

    def of(x: Column) -> Column:
        def one(end: Column, k: Column) -> Column:  # ends count from 1
            begin, sentence = F.coalesce(F.get(x["ends"], k - 1), F.lit(0)), F.get(x["s"], end - 1)
            context = F.array_join(F.slice(x["s"], begin + 1, end - begin - 1), " ")
            return F.when((end - begin > 1) & (F.length(context) < CONTEXT_BELOW), F.concat(context, F.lit(" "), sentence)).otherwise(sentence)

        whole = F.when(F.size(x["s"]) > 0, F.array(F.array_join(x["s"], " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(x["ends"]) > 0, F.transform(x["ends"], one)).otherwise(whole)

    ends = lambda s: F.array_compact(F.transform(s, lambda t, i: F.when(is_regulatory(t), i + 1)))
    return let(sentences(text), lambda s: let(F.struct(s.alias("s"), ends(s).alias("ends")), of))


def split_clauses(chunks: DataFrame) -> DataFrame:
    """Chunks (doc_id, section_id, chunk_id, text) to clauses, numbered from 1 in each chunk; no shuffle."""
    rows = exploded(chunks, ["doc_id", "section_id", "chunk_id"], clause_texts(F.col("text")), "pos", "source_text")
    number = F.col("pos") + 1
    return rows.select("doc_id", "section_id", "chunk_id", number.alias("clause_ord"),
        F.format_string("%s_%s_CL%03d", "doc_id", "chunk_id", number).alias("clause_id"), "source_text")


def clause_type(text: Column) -> Column:
    low = F.lower(strip(text))
    kind = F.when(low.startswith("if ") | low.startswith("when "), "conditional")
    for name, parts in TYPE_RULES:
        hit = low.contains(parts[0])
        for part in parts[1:]:
            hit = hit | low.contains(part)
        kind = kind.when(hit, name)
    return kind.otherwise("obligation")


def _guarded(text: Column, pattern: str) -> Column:
    """extract, which is left out where `__low` (the text in lower case, null unless it is ASCII) holds none of the pattern's words."""
    hit = F.lit(False)
    for word in _WORDS[pattern]:
        hit = hit | F.col("__low").contains(word)
    return F.when(F.coalesce(hit, F.lit(True)), extract(text, pattern))


def first_match(text: Column, patterns: tuple[str, ...]) -> Column:
    return F.coalesce(*[_guarded(text, p) for p in patterns])


def parse(clauses: DataFrame) -> DataFrame:
    """Add type, actor, verb, object, trigger, deadline, duration, frequency and confidence to (…, source_text)."""
    text = F.col("source_text")
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text))
    return clauses.withColumn("__low", low).withColumns({
        "type": clause_type(text),
        "actor": F.coalesce(_guarded(text, ACTOR), F.lit(NO_ACTOR)),
        "verb": F.coalesce(_guarded(text, VERB), F.lit(NO_VERB)),
        "object": first_words(first_match(text, OBJECTS), 5),
        "trigger": first_match(text, TRIGGERS),
        "deadline": _guarded(text, DEADLINE),
        "duration": _guarded(text, DURATION),
        "frequency": _guarded(text, FREQUENCY),
        "confidence": F.lit(CONFIDENCE),
    }).drop("__low")


#: Fields that a model's answer may give, as text.
_ANSWER = "type string, actor string, verb string, object string, trigger string, deadline string, duration string, frequency string, confidence double"


def parse_by_client(clauses: DataFrame, client: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """parse, with what a language model answers in place of the patterns' findings.

    client: takes the texts of one Arrow batch and gives an answer for each, JSON with any of the fields, bare, fenced
    or inside prose; it runs on the executors, so it must be picklable and batch its own requests. Where an answer is
    null or holds no JSON, the patterns stand.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(client(texts.tolist()), dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    asked = F.pandas_udf(run, StringType())
    rows = parse(clauses).withColumn("__answer", asked("source_text")).withColumn("__answer", F.from_json(recovered_json(F.col("__answer")), _ANSWER))
    names = [f.split()[0] for f in _ANSWER.split(", ")]
    return rows.withColumns({c: F.coalesce(F.col(f"__answer.{c}"), F.col(c)) for c in names}).drop("__answer")


def nested(parsed: DataFrame) -> DataFrame:
    """Parsed clauses in nested form, with null structs for absent parts."""
    empty = F.array().cast("array<string>")
    times = F.coalesce("deadline", "frequency", "duration").isNotNull()
    return parsed.select(
        "doc_id", "clause_id", F.col("chunk_id").alias("source_chunk_id"), "source_text", "type",
        F.struct(F.col("actor").alias("entity"), empty.alias("qualifiers")).alias("actor"),
        F.struct(F.col("verb"), empty.alias("modifiers")).alias("action"),
        F.when(F.col("object").isNotNull(), F.struct(F.col("object").alias("entity"), empty.alias("qualifiers"))).alias("object"),
        F.when(F.col("trigger").isNotNull(), F.struct("trigger", F.lit(None).cast("string").alias("temporal"))).alias("condition"),
        F.when(times, F.struct("deadline", "frequency", "duration")).alias("temporal_scope"),
        empty.alias("cross_references"), F.round("confidence", 2).alias("confidence"),
    )


def valid_confidence(parsed: DataFrame) -> DataFrame:
    """Rows whose confidence lies in [0, 1], rounded to two places."""
    return parsed.where(F.col("confidence").between(0, 1)).withColumn("confidence", F.round("confidence", 2))


def cross_references(text: Column) -> Column:
    """Numbers of the sections that a text names."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)\bsection\s+(\d+(?:\.\d+)*)"), F.lit(1)))


def recovered_json(text: Column) -> Column:
    """JSON in a model's answer: the whole text, a fenced block, or what the outermost braces hold; else null."""
    tries = (text, F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1), F.regexp_extract(text, r"\{[\s\S]*\}", 0))
    return F.coalesce(*[F.when(F.try_parse_json(F.nullif(t, F.lit(""))).isNotNull(), t) for t in tries])
