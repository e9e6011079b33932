"""Mixing sources to target weights by a low-discrepancy source schedule (native).

Golden-ratio points, mapped through the sources' cumulative shares, say which source each slot of the mix takes;
the r-th slot of a source takes the r-th block of BLOCK words of that source's shuffled text stream. A stream is
the source's documents in hash order, twice over, cut into equal blocks regardless of where documents end, so a
document is taken in pieces and at most EPOCHS times.

Counts, ranks and places come from bucketed sums (common.dense_positions): no source is sorted by one task.
Defined results: null and empty texts have size 0 and nothing taken; a null source is a source, the last; repeated
rows are documents of their own; ties in hash order are broken by id and, in repeat, by a hash of all columns, so
rows that still tie are equal; an empty table gives an empty table; only the named columns are read, and
repeat packs the rows while it works, so that no column's name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import cut, dense_positions, pack, read, row_hash
from .quality_rules import words

BLOCK = 128
EPOCHS = 2
SHARE = 1.5
WEIGHTS = (3, 1, 2)
SEED = 17
#: Slots that are ranked together; equal parts of [0, 1) that find a point's source by equality.
SLOT_CHUNK = 1 << 14
PARTS = 1 << 10
_LOW_BITS = 20
#: Fractions of the golden ratio's multiples, to 53 bits: of 1 and of 2**_LOW_BITS.
_GOLDEN = 0.6180339887498949
_GOLDEN_HIGH = (((11400714819323198485 << _LOW_BITS) & ((1 << 64) - 1)) >> 11) / 2**53


def golden_point(i: Column) -> Column:
    """frac(i * golden ratio) with errors below 1e-9 up to 10**13."""
    x = F.shiftright(i, _LOW_BITS).cast("double") * _GOLDEN_HIGH
    y = (x - F.floor(x)) + i.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)).cast("double") * _GOLDEN
    return y - F.floor(y)


def targets(sizes: DataFrame, share: float = SHARE, most: int = EPOCHS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) to (source, source_size, ord, target), one row a source.

    Targets are min(most * size, level * weight) for the level at which they sum to share * all sizes. With sources
    in ascending most * size / weight, the level is the greatest of (what is left) / (weights left).
    """
    by_name = W.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("ord"), F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("ord", F.row_number().over(by_name) - 1).withColumn("w", weight).withColumn("most", F.col("source_size") * float(most))
    rising = W.orderBy(F.col("most") / F.col("w"), "ord")
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(rising.rowsBetween(0, W.unboundedFollowing)))
    level = F.greatest(F.lit(0.0), F.max("level").over(everything))
    return s.select("source", "source_size", "ord", F.least("most", level * F.col("w")).alias("target"))


def schedule(aims: DataFrame, slots: int, spark: SparkSession) -> DataFrame:
    """(slot, ord, rank): the source of each slot and the slot's rank among the source's."""
    up_to = F.sum("target").over(W.orderBy("ord")) / F.sum("target").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    last = F.max("ord").over(W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    spans = aims.where("target > 0").withColumn("hi", up_to).withColumn("hi", F.when(F.col("ord") == last, F.lit(1.0)).otherwise(F.col("hi")))
    spans = spans.withColumn("lo", F.coalesce(F.lag("hi").over(W.orderBy("ord")), F.lit(0.0)))
    spans = spans.where("lo < hi").select("ord", "lo", "hi",
        F.explode(F.sequence(F.floor(F.col("lo") * PARTS), F.least(F.floor(F.col("hi") * PARTS),
                    F.lit(PARTS - 1).cast("long")))).alias("part"))
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("u")).withColumn("part", F.floor(F.col("u") * PARTS))
    dealt = points.join(spans, "part").where((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("slot", "ord")
    return dense_positions(dealt, ["ord"], ["slot"], None, "rank", bucket=F.shiftright("slot", SLOT_CHUNK.bit_length() - 1))


def place_hash(key: str, text: str) -> Column:
    """What shuffles a source's documents: a hash of id and text."""
    return F.xxhash64(F.lit(SEED), F.col(key), F.coalesce(F.col(text), F.lit("")))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, share: float = SHARE,
    epochs: int = EPOCHS, row: str | None = None, tie: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plan, documents); `row` and `tie` may name columns that number the rows and order those equal in id and text. plan: (slot, row, doc_id, epoch, first_word, n_words), the mix's pieces by slot.
    documents: (row, doc_id, h, size, source, source_size, target, taken), a row for each input row."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    number = F.col(row) if row else F.monotonically_increasing_id()
    own = [F.col(key).alias("doc_id"), F.col(source).alias("source"), F.size(words(body)).cast("long").alias("size"), place_hash(key, text).alias("h")]
    base = docs.select(number.alias("row"), *own, (F.col(tie) if tie else F.lit(0)).cast("long").alias("tie"))
    base = cut(base, "mix-documents")
    aims = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    total = aims.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("t")).first()["t"]
    own = aims.select(F.col("source").alias("__source"), "source_size", "ord", "target")
    base = base.join(own, base["source"].eqNullSafe(own["__source"])).drop("__source")
    placed = dense_positions(base.where("size > 0"), ["ord"], ["h", "doc_id", "tie", "row"], "size", "start", rows=base.count())
    at = F.col("start") + F.col("epoch") * F.col("source_size")
    pieces = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))).withColumn("at", at)
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.col("size") - 1) / block))))
    first = F.greatest(F.col("rank") * block - F.col("at"), F.lit(0))
    n = F.least((F.col("rank") + 1) * block - F.col("at"), F.col("size")) - first
    pieces = pieces.select("row", "doc_id", "ord", "rank", "epoch", first.cast("long").alias("first_word"), n.cast("long").alias("n_words"))
    slots = schedule(aims, int(-(-total // block)), spark)
    plan = slots.join(pieces, ["ord", "rank"]).select("slot", "row", "doc_id", "epoch", "first_word", "n_words")
    taken = plan.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return plan, base.join(taken, "row", "left").select("row", "doc_id", "h", "size", "source", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with all their columns, each as often as the mix takes it: 0 to EPOCHS times, taken / size rounded half
    up. Documents without words are not taken."""
    stored = cut(pack(docs, place=F.monotonically_increasing_id(), tie=row_hash(docs)), "mix-rows")
    field = lambda c, name: F.col("row").getField(c).alias(name)
    _, documents = mix(stored.select("place", "tie", field(key, "doc_id"), field(text, "text"), field(source, "source")), row="place", tie="tie")
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    plan = documents.select(F.col("row").alias("place"), times.alias("times")).where("times > 0")
    return stored.join(plan, "place").select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def op8_golden_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, documents = mix(read(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
