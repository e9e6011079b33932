"""Language identification by error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit (log-odds of hashed byte trigrams between the
languages whose bit is 1 and the others) predicts that bit for a text, and the language with the least summed
logistic loss against the predicted bits wins. A runner-up that is nearly as near flags the text as ambiguous.

Defined results: null texts and texts without a letter get `und`, score 0, not ambiguous; very long texts count as
a whole; ties go to the language first in code-point order; repeated rows are judged alike; an empty table gives an
empty table, and a model learned from no row answers `und`; results come in columns of their own names, which
replace columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .batches import by_bytes
from .common import read, small_batches

#: Learning takes about so many labelled rows of each language at most, chosen by a hash of their id.
TRAIN_ROWS_PER_LANGUAGE = 5_000
BUCKET_BITS = 14
#: A text's evidence is that of so many trigrams at most, so that length alone doesn't make a text certain.
EVIDENCE = 64.0
AMBIGUOUS_BELOW = 0.75
BATCH_BYTES = 1_000_000
_LETTER = regex.compile(r"\p{L}")
#: Letters and bytes of non-ASCII characters stay; all else is a gap.
_KEEP = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], dtype=np.uint8)


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1. Up to 7 languages: all splits of them in two; beyond: seeded random words, twice
    as many bits as the logarithm asks for, in which no two languages agree."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.float32)
    if n <= 7:
        splits = np.arange(1, 2 ** (n - 1))
        return np.array([[1 if i == 0 or not s >> (i - 1) & 1 else -1 for s in splits] for i in range(n)], dtype=np.float32)
    bits = int(np.ceil(15 * np.log2(n)))
    for seed in range(1000):
        code = np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.float32), size=(n, bits))
        if len(np.unique(code, axis=0)) == n and (np.abs(code.sum(axis=0)) < n).all():
            return code
    raise ValueError(f"no codewords for {n} languages")


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and the offset of each text's first one (each text has one at least)."""
    raw = [f"  {t} ".lower().encode("utf-8", "replace") for t in texts]
    lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    data = _KEEP[np.frombuffer(b"".join(raw) + b"  ", dtype=np.uint8)].astype(np.uint32)
    key = (data[:-2] << 16 | data[1:-1] << 8 | data[2:]) * np.uint32(2654435761)
    return (key >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), np.cumsum(lens) - lens


class EcocModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        """counts: trigrams of each language by bucket."""
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1], bits), dtype=np.float32)
        for b in range(bits):
            one = self.code[:, b] > 0
            self.weights[:, b] = np.log(share[one].mean(axis=0)) - np.log(share[~one].mean(axis=0))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        known = [i for i, t in enumerate(texts) if self.languages and t and _LETTER.search(t)]
        lang, score, doubt = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        if not known:
            return lang, score, doubt
        key, starts = trigrams([texts[i] for i in known])
        n = np.diff(np.append(starts, len(key))).astype(np.float32)
        z = np.add.reduceat(self.weights[key], starts, axis=0) * np.minimum(1, EVIDENCE / n)[:, None] if self.code.shape[1] else np.zeros((len(known), 0))
        loss = np.logaddexp(0, -z[:, None, :].astype(np.float64) * self.code[None, :, :]).sum(axis=2)
        near = np.exp(loss.min(axis=1, keepdims=True) - loss)
        near /= near.sum(axis=1, keepdims=True)
        best = near.argmax(axis=1)
        for k, i in enumerate(known):
            lang[i], score[i] = self.languages[best[k]], near[k, best[k]]
            doubt[i] = score[i] < AMBIGUOUS_BELOW
        return lang, score, doubt


def fit(rows: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", rows_per_language: int = TRAIN_ROWS_PER_LANGUAGE) -> EcocModel:
    """Learn from about rows_per_language rows of each language; trigrams are counted by the executors, and the
    driver gets at most 2**BUCKET_BITS counts a language."""
    small_batches(rows.sparkSession)
    rows = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(label).alias("lang"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return EcocModel([], np.zeros((0, 2**BUCKET_BITS)))
    span = 1_000_000
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(span, -(-rows_per_language * span // n))).otherwise(share)
    rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(span)) < share).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                key, starts = trigrams(batch.column(0).to_pylist())
                bounds = np.append(starts, len(key))
                for i, lang in enumerate(batch.column(1).to_pylist()):
                    found = np.bincount(key[bounds[i] : bounds[i + 1]], minlength=2**BUCKET_BITS)
                    held[lang] = held.get(lang, 0) + found
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "bucket": at.astype(np.int32), "n": n[at]},
                schema=pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())]))

    found = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(found["lang"]))
    counts = np.zeros((len(languages), 2**BUCKET_BITS))
    counts[found["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=np.int64), found["bucket"].to_numpy()] = found["n"]
    return EcocModel(languages, counts)


def predict(docs: DataFrame, model: EcocModel, text: str = "text") -> DataFrame:
    """docs with lang_pred string, score double and ambiguous boolean."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**BUCKET_BITS numbers
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
            T.StructField("ambiguous", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text, BATCH_BYTES):
                lang, score, doubt = shared.value.predict(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)],
                    names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> DataFrame:
    """The rows whose language is found and not ambiguous, with all their columns; learns from their labels."""
    model = fit(docs, text, label, key)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]) if len(docs.columns) > 1 else F.lit(0)
    kept = predict(docs.select(others.alias("row"), F.col(text).alias("text")), model).where((F.col("lang_pred") != "und") & ~F.col("ambiguous"))
    return kept.select(*[F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])


def held_out(key: str = "doc_id", of: int = 5, rest: int = 0):
    """crc32 of the id as text; rows without an id are never held out, nor learned from."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of)) == rest


def op10_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "lang_pred", "score", "ambiguous")
