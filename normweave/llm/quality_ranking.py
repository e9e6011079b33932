"""Quality scores by Bradley-Terry pairwise ranking.

Labelled rows give preference pairs (a good text beats a bad one); the weights of a linear score maximise the
likelihood of these outcomes, which is logistic regression on the differences of the pair's features. The features are
shares of Unicode classes of characters, counts of words and lines, and hashed shares of words and of byte trigrams, so
a score sees letters of any script and the wording. The threshold is one quantile of the learned rows' scores: the one
that leaves as many rows above it as are labelled good. It maps to 0.7, so predicted = score >= 0.7.

Learning reads the texts of all labelled ids once and keeps their features in blocks; each Newton step sums over the
blocks on the executors, and the threshold is an exact quantile of all learned rows. Then one pass over all whole texts measures and scores.
Defined results: null text is empty; an empty text has zero counts and a score like any other; repeated rows score
alike; labels without a document, without a label or of null id are left out; of several texts of one id the least is
learned from; equal labels of one id count once; ties at the threshold are kept; an empty table gives an empty table;
learning from no pair gives every text the score 0.7; only the named columns are read.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from normweave.sources.store import grows

from .batches import by_bytes
from .common import discard, read, small_batches, stored

#: Pairs a labelled row, and labelled rows of a block, within which pairs are made.
PAIRS_A_ROW = 2
BLOCK_ROWS = 20_000
CUT_SCORE = 0.7
BATCH_BYTES = 1_000_000
#: Buckets of hashed words and of hashed byte trigrams.
WORD_BUCKETS = GRAM_BUCKETS = 128
SEED = 7

#: Groups of Unicode categories, each a feature; the last three are sets of single characters within them.
CLASSES = {"lower": ("Ll",), "upper": ("Lu", "Lt"), "letter": ("Lo", "Lm"), "mark": ("Mn", "Mc", "Me"), "digit": ("Nd", "Nl", "No"),
    "symbol": ("Sm", "Sc", "Sk", "So"), "other": ("Pc", "Pd", "Ps", "Pe", "Pi", "Pf", "Po"), "control": ("Cc", "Cf", "Co", "Cn", "Cs")}
SINGLE = {"sentence": ".,;:?\u2026\u3001\u3002\uff0c\uff1f\u061f\u0964", "shout": "!\uff01\u00a1", "code": "#*$%&|<>~^=+_\\{}[]@/", "line": "\n"}
PLAIN = ("log_words", "word_length", *CLASSES, *SINGLE, "variety", "repeats", "longest")
FEATURES = (*PLAIN, *(f"word_{k}" for k in range(WORD_BUCKETS)), *(f"gram_{k}" for k in range(GRAM_BUCKETS)))


@cache
def _classes() -> np.ndarray:
    """The class of each code point, 0 for white space."""
    number = {c: k for k, group in enumerate(CLASSES.values(), 1) for c in group}
    out = np.fromiter((number.get(unicodedata.category(chr(c)), 0) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for k, group in enumerate(SINGLE.values(), 1 + len(CLASSES)):
        out[[ord(c) for c in group]] = k
    return out


def measure(texts: list[str]) -> np.ndarray:
    """(texts, features)."""
    points = [np.frombuffer(f"{t} ".encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
    lens = np.fromiter(map(len, points), dtype=np.int64, count=len(points))
    kinds = _classes()[np.concatenate(points)]
    n_kinds = 1 + len(CLASSES) + len(SINGLE)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * n_kinds, lens)
    counts = np.bincount(owner + kinds, minlength=len(texts) * n_kinds).reshape(len(texts), n_kinds)
    out = np.zeros((len(texts), len(FEATURES)), dtype=np.float32)
    size = lens.astype(np.float64)
    out[:, 2 : 1 + n_kinds] = counts[:, 1:] / size[:, None]
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    codes, first = [], len(PLAIN)
    for i, t in enumerate(texts):
        w = t.split()
        codes.append(np.fromiter(map(index.__getitem__, w), dtype=np.int64, count=len(w)))
        if w:
            out[i, 0] = len(w)
            out[i, first - 3] = np.log1p(len(set(w))) / np.log1p(len(w))
            out[i, first - 2] = sum(map(eq, w, w[1:])) / len(w)
            out[i, first - 1] = np.log1p(max(map(len, w)))
    out[:, 1] = np.minimum(size / np.maximum(out[:, 0], 1), 40)
    bucket = np.fromiter((xxhash.xxh64_intdigest(w.lower()) % WORD_BUCKETS for w in index), dtype=np.int64, count=len(index))
    raw = np.frombuffer(b"".join(t.lower().encode("utf-8", "surrogatepass") + b"   " for t in texts), dtype=np.uint8).astype(np.uint32)
    ends = np.cumsum([len(t.lower().encode("utf-8", "surrogatepass")) + 3 for t in texts])
    gram = ((raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) * np.uint32(2654435761) >> np.uint32(8)) % GRAM_BUCKETS
    at = 0
    for i, end in enumerate(ends):
        words, grams = np.bincount(bucket[codes[i]], minlength=WORD_BUCKETS), np.bincount(gram[at : end - 3], minlength=GRAM_BUCKETS)
        out[i, first : first + WORD_BUCKETS] = np.sqrt(words / max(1, len(codes[i])))
        out[i, first + WORD_BUCKETS :] = np.sqrt(grams / max(1, end - 3 - at))
        at = end
    out[:, 0] = np.log1p(out[:, 0])
    return out


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, f array<float>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                f = measure([t or "" for t in batch.column("text").to_pylist()])
                at = np.arange(0, f.size + 1, f.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.ListArray.from_arrays(pa.array(at), pa.array(f.reshape(-1)))], names=["key", "f"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, f array<float>").withColumnRenamed("key", key)


class BradleyTerry:
    """score = sigmoid(scale * (w . f - threshold) + logit(CUT_SCORE))"""

    def __init__(self, f: np.ndarray, good: np.ndarray, seed: int = SEED):
        d = f.shape[1]
        self.weights, self.threshold, self.scale = np.zeros(d), 0.0, 1.0
        up, down = np.flatnonzero(good), np.flatnonzero(~good)
        if not len(up) or not len(down):
            return
        rng = np.random.default_rng(seed)
        i = np.concatenate((np.repeat(up, PAIRS_A_ROW), rng.choice(up, len(down) * PAIRS_A_ROW)))
        j = np.concatenate((rng.choice(down, len(up) * PAIRS_A_ROW), np.repeat(down, PAIRS_A_ROW)))
        spread = f.std(axis=0, dtype=np.float64)
        spread[spread < 1e-9] = 1.0
        self.pairs, self.ridge = (i, j), 1e-3 * len(i)
        w = np.zeros(d)
        for _ in range(30):  # Newton steps on the pairs' logistic loss, a slice of pairs at a time
            slope, curve = -self.ridge * w, self.ridge * np.eye(d)
            for low in range(0, len(i), 8_192):
                x = (f[i[low : low + 8_192]] - f[j[low : low + 8_192]]) / spread
                p = 1 / (1 + np.exp(np.minimum(x @ w, 500)))
                slope += x.T @ p
                curve += (x * (p * (1 - p))[:, None]).T @ x
            step = np.linalg.solve(curve, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w / spread
        s = f @ self.weights
        self.threshold = float(np.quantile(s, len(down) / len(s)))
        self.scale = 4.0 / max(1e-6, float(np.median(s[up])) - self.threshold)

    def score(self, f: np.ndarray) -> np.ndarray:
        x = self.scale * (f @ self.weights - self.threshold) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _untaught() -> BradleyTerry:
    return BradleyTerry(np.zeros((0, len(FEATURES))), np.zeros(0, dtype=bool))


def _pairs(good: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that win and rows that lose: each row of a block meets PAIRS_A_ROW rows of the other class in it."""
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return up[:0], down[:0]
    rng = np.random.default_rng((SEED, block))
    return (np.concatenate((np.repeat(up, PAIRS_A_ROW), rng.choice(up, len(down) * PAIRS_A_ROW))),
        np.concatenate((rng.choice(down, len(up) * PAIRS_A_ROW), np.repeat(down, PAIRS_A_ROW))))


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, f, good) of rows (id, good, f): about BLOCK_ROWS rows by hash are one row of bytes, so that each round of learning
    reads them without a shuffle."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("hash", "ascending"), ("id", "ascending"), ("good", "ascending")]).to_numpy()
        good = table.column("good").to_numpy().astype(np.uint8)[order]
        block, f, at = table.column("block")[0].as_py(), np.empty((len(order), len(FEATURES)), dtype=np.float32), np.argsort(order)
        low = 0
        for chunk in table.column("f").chunks:  # a block's features are held twice at most: as they came, and in order
            f[at[low : low + len(chunk)]] = chunk.flatten().to_numpy().reshape(-1, len(FEATURES))
            low += len(chunk)
        packed = pa.Array.from_buffers(pa.binary(), 1, [None, pa.py_buffer(np.array([0, f.nbytes], dtype=np.int32)), pa.py_buffer(f)])
        return pa.table({"block": pa.array([block], pa.int32()), "f": packed, "good": pa.array([good.tobytes()], pa.binary())})

    n = max(1, -(-rows.count() // BLOCK_ROWS))
    hashed = F.xxhash64(F.lit(SEED), "id")
    return rows.select("id", F.col("good").cast("byte").alias("good"), "f", hashed.alias("hash"), F.pmod(hashed, F.lit(n)).cast("int").alias("block")).groupBy("block").applyInArrow(run,
        "block int, f binary, good binary")


def _summed(blocks: DataFrame, groups: int, of, size: int) -> np.ndarray:
    """The sum of of(f, good, block), an array of `size` numbers, over all blocks. Each task's sum is a row; these meet on the
    executors in `groups` groups, about the root of the number of blocks, so neither a group nor the driver gets all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, last = np.zeros(size), None
        for batch in batches:
            for i in range(batch.num_rows):  # views of the batch, no copies
                last, f, good = batch.column(0)[i].as_py(), batch.column(1)[i].as_buffer(), batch.column(2)[i].as_buffer()
                total += of(np.frombuffer(f, dtype=np.float32).reshape(-1, len(FEATURES)), np.frombuffer(good, dtype=np.uint8).astype(bool), last)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "s"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for k in pc.sort_indices(table.column("block")).to_pylist():
            total += np.frombuffer(table.column("s")[k].as_buffer())
        return pa.table({"block": pa.array([pc.min(table.column("block")).as_py()], pa.int32()), "s": pa.array([total.tobytes()], pa.binary())})

    each = blocks.select("block", "f", "good").mapInArrow(run, "block int, s binary").withColumn("group", F.pmod("block", F.lit(groups)))
    met = each.groupBy("group").applyInArrow(add, "block int, s binary").collect()
    return sum((np.frombuffer(bytes(r.s)) for r in sorted(met)), np.zeros(size))


def _quantile(scores: DataFrame, q: float) -> float:
    """The exact quantile, between two ranks in proportion: bins narrow down to the values around the rank."""
    n, low, high = scores.agg(F.count("*"), F.min("s"), F.max("s")).first()
    place = q * (n - 1)

    def ranked(rank: int) -> float:
        a, b, left = low, high, rank  # values in [a, b], of which the wanted one has rank `left`
        while True:
            inside = scores.where((F.col("s") >= a) & (F.col("s") <= b))
            if a == b:
                return a
            if inside.count() <= 10_000:
                return sorted(r.s for r in inside.collect())[left]
            bins = inside.groupBy(F.least(F.lit(1023), F.floor((F.col("s") - a) / (b - a) * 1024)).alias("bin")).agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"))
            for r in sorted(bins.collect()):  # 1,024 rows at most
                if left < r.n:
                    a, b = r.a, r.b
                    break
                left -= r.n

    floor = ranked(int(np.floor(place)))
    part = place - np.floor(place)
    return floor if part == 0 else floor + part * (ranked(int(np.floor(place)) + 1) - floor)


def fit(labels: DataFrame, docs: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text") -> BradleyTerry:
    """Learn from the texts of all labelled ids. The driver gets sums over them, whose size is that of the features."""
    model, d = _untaught(), len(FEATURES)
    named = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(F.col(key).alias("id"), (F.col(label) > 0).alias("good")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(grows(named), "id").groupBy("id",
        "good").agg(F.min("text").alias("text"))
    rows = stored(features(texts.select(F.struct("id", "good").alias("row"), "text"), "row").select("row.id", "row.good", "f"), "learned")
    blocks = stored(_blocks(rows), "blocks")
    groups = 1 + int(np.sqrt(blocks.count()))
    n, n_up, n_pairs = (int(x) for x in _summed(blocks, groups, lambda f, good, block: np.array([len(good), good.sum(), len(_pairs(good, block)[0])], dtype=float), 3))
    if not n_pairs:
        return model
    mean = _summed(blocks, groups, lambda f, good, block: f.sum(axis=0, dtype=np.float64), d) / n
    spread = np.sqrt(_summed(blocks, groups, lambda f, good, block: np.square(f - mean).sum(axis=0), d) / n)
    spread[spread < 1e-9] = 1.0
    w, ridge = np.zeros(d), 1e-3 * n_pairs

    def newton(f: np.ndarray, good: np.ndarray, block: int) -> np.ndarray:
        (i, j), slope, curve = _pairs(good, block), np.zeros(d), np.zeros((d, d))
        for low in range(0, len(i), 8_192):
            x = (f[i[low : low + 8_192]] - f[j[low : low + 8_192]]) / spread
            p = 1 / (1 + np.exp(np.minimum(x @ w, 500)))
            slope += x.T @ p
            curve += (x * (p * (1 - p))[:, None]).T @ x
        return np.concatenate((slope, curve.reshape(-1)))

    for _ in range(30):  # Newton steps on the logistic loss of all pairs
        found = _summed(blocks, groups, newton, d + d * d)
        step = np.linalg.solve(found[d:].reshape(d, d) + ridge * np.eye(d), found[:d] - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.weights = weights = w / spread

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, good in zip(*(c.to_pylist() for c in batch.columns)):
                s = np.frombuffer(f, dtype=np.float32).reshape(-1, d) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.frombuffer(good, dtype=np.uint8).astype(bool))], names=["s", "good"])

    scores = stored(blocks.select("f", "good").mapInArrow(scored, "s double, good boolean"), "scores")
    model.threshold = _quantile(scores, (n - n_up) / n)
    model.scale = 4.0 / max(1e-6, _quantile(scores.where("good"), 0.5) - model.threshold)
    discard(rows, blocks, scores)
    return model


def score(docs: DataFrame, model: BradleyTerry, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.threshold, model.scale))  # a number a feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _untaught()
        own.weights, own.threshold, own.scale = shared.value
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                found = own.score(measure([t or "" for t in batch.column("text").to_pylist()]))
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.float64())], names=["key", "score"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def op6_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = fit(read(spark, sf_dir, "labels").where(~held), docs)
    return score(docs, model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score").withColumn("predicted",
        (F.col("score") >= CUT_SCORE).cast("int"))
