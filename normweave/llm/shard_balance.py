"""Sharding by balanced label propagation (native).

Links are (row, key): rows with an equal key are neighbours. Rows start in shards by hash. A row moves with the rows of its
largest key, which are one unit; in each round, joins over the links give every unit the votes of its neighbours, row by row,
for the shards they are in, and it asks for the shard with most votes among those with room for all of it. A shard takes the
units that ask, the largest first, while its quota holds; what it refuses asks again in the next round. Units that have
moved go on voting and may follow their neighbours elsewhere. At the end every shard is brought to its exact share of rows:
rows without links go first, then those of units that found no room. Law `rows`: sizes differ by one row at most.

A key with more rows than a quota is cut into parts that fit, by a hash of the row; no other key is. Votes are counted by
key and shard, and a unit's rows by key, before they meet, so a key that holds a third of all rows sends a few counts a shard.
Defined results: null texts count as size 1 and as equal to each other and to empty texts; null keys link nothing;
repeated rows are rows of their own; ties between shards fall by a hash of the unit and the shard, in proportion to room; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, dense_positions, discard, read

SHARDS = 16
ROUNDS = 8
#: Parts of a key above a quota have this share of it on average, so that chance doesn't lift one over it.
PART = 0.75
SEED = 23
_UNIT = 1 << 20
#: Who stays first: units that found a shard, units that didn't, rows without links.
_CLASSES = 3


def _choose(by: Column, values: list[int]) -> Column:
    """values[by] as an expression; a list as long as the number of shards."""
    return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), by + 1)


def _units(links: DataFrame, quota: int, start: Column) -> tuple[DataFrame, DataFrame]:
    """(row, unit), and (unit, key, shard, n): the rows of a unit that have a key, by the shard they start in."""
    links = links.where("key IS NOT NULL")
    sizes = cut(links.groupBy("key").agg(F.count("*").alias("key_n")).where("key_n > 1"), "shard-keys")
    parts = F.when(F.col("key_n") > quota, F.ceil(F.col("key_n") / (PART * max(1, quota))).cast("int")).otherwise(1)
    part = F.pmod(F.xxhash64(F.lit(SEED + 3), "row"), parts)
    named = links.join(sizes, "key").select("row", F.struct((F.col("key_n") / parts).alias("n"), F.col("key"), part.alias("part")).alias("k"))
    held = cut(named.groupBy("row").agg(F.max("k").alias("unit"), F.collect_set("k").alias("keys")), "shard-members")
    name = lambda k: F.xxhash64(k["key"], k["part"])
    counts = held.select(name(F.col("unit")).alias("unit"), F.explode("keys").alias("k"), start.alias("start")).select("unit", name(F.col("k")).alias("key"), "start")
    return held.select("row", name(F.col("unit")).alias("unit")), counts.groupBy("unit", "key", "start").agg(F.count("*").alias("n"))


def _round(units: DataFrame, counts: DataFrame, own: DataFrame, room: list[int], turn: int) -> DataFrame:
    """units (unit, size, inner, shard) after one round. `inner`: the votes that a unit's rows give each other; they count while
    it is scattered, and not once it is in one shard. room: what the units in its shard leave of each shard's quota."""
    shards = len(room)
    placed = units.where("shard IS NOT NULL").select("unit", "shard")
    now = counts.join(placed, "unit", "left").groupBy("key", F.coalesce("shard", "start").alias("shard")).agg(F.sum("n").alias("there"))
    votes = own.join(now, "key").groupBy("unit", "shard").agg(F.sum(F.col("n") * F.col("there")).alias("votes"))
    ballot = votes.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("shard", "votes"))).alias("votes"))  # `shards` entries at most
    rows = units.join(ballot, "unit")

    def offer(s: Column) -> Column:
        even = (F.pmod(F.xxhash64(F.lit(turn), "unit", s), F.lit(_UNIT)) + 0.5) / _UNIT
        here = F.coalesce(F.col("shard") == s, F.lit(False))
        count = F.coalesce(F.element_at("votes", s.cast("long")), F.lit(0)) - F.when(here, F.col("inner")).otherwise(0)
        return F.struct((here | (_choose(s, room) >= F.col("size"))).alias("fits"), count.alias("votes"), here.alias("here"),
            (F.log(even) / F.greatest(_choose(s, room), F.lit(1))).alias("tie"), s.alias("shard"))

    best = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), offer))
    rows = rows.withColumn("best", best)
    # two units in shards of each other must not just change places, so half of them keep still
    moves = F.col("best.fits") & ~F.col("best.here") & (F.col("shard").isNull() | (F.pmod(F.xxhash64(F.lit(turn), "unit"), F.lit(2)) == 0))
    asked = cut(rows.select("unit", "size", "inner", "shard", F.when(moves, F.col("best.shard").cast("long")).alias("to"),
        F.xxhash64("unit").alias("h"), (40 - F.floor(F.log2("size"))).cast("long").alias("order")), "shard-wishes")
    movers = asked.where("to IS NOT NULL")
    bits = (max(1, movers.count()) // 2_000).bit_length()
    bucket = F.col("order") * (1 << bits) + (F.shiftright("h", 64 - bits) if bits else F.lit(0))
    queue = dense_positions(movers, ["to"], ["order", "h", "unit"], "size", "before", bucket=bucket)
    taken = queue.where(F.col("before") + F.col("size") <= _choose(F.col("to").cast("int"), room)).select("unit", F.col("to").alias("taken"))
    after = cut(asked.join(taken, "unit", "left").select("unit", "size", "inner", F.coalesce("taken", "shard").alias("shard")), "shard-units")
    discard(asked, units)
    return after


def propagate(rows: DataFrame, links: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """rows: (row long, distinct). links: (row, key string). Returns (row, shard int, slot long)."""
    n = rows.count()
    quota = [n // shards + (s < n % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64(F.lit(SEED), "row"), F.lit(shards)).cast("long")
    members, counts = _units(links, max(quota), start)
    counts = cut(counts, "shard-counts")
    own = cut(counts.groupBy("unit", "key").agg(F.sum("n").alias("n")), "shard-own")
    units = cut(members.groupBy("unit").agg(F.count("*").alias("size")).join(own.groupBy("unit").agg(F.sum(F.col("n") * F.col("n")).alias("inner")), "unit").withColumn(
        "shard", F.lit(None).cast("long")), "shard-units")
    for turn in range(rounds):
        held = {r["shard"]: r["n"] for r in units.where("shard IS NOT NULL").groupBy("shard").agg(F.sum("size").alias("n")).collect()}  # a row a shard
        units = _round(units, counts, own, [max(0, quota[s] - held.get(s, 0)) for s in range(shards)], turn)
    linked = members.join(units.select("unit", F.col("shard").alias("moved")), "unit").select("row", "unit", "moved")
    rank = F.when(F.col("unit").isNull(), 2).when(F.col("moved").isNull(), 1).otherwise(0)
    lot = F.when(rank == 1, F.xxhash64(F.lit(SEED + 2), "unit")).otherwise(F.xxhash64(F.lit(SEED + 1), "row"))
    placed = rows.select("row").join(linked, "row", "left").select("row", F.coalesce("moved", start).cast("int").alias("shard"), rank.alias("class"), lot.alias("h"))
    placed = cut(dense_positions(cut(placed, "shard-placed"), ["shard", "class"], ["h", "row"], None, "place", rows=n), "shard-ranked")
    counts = {(r["shard"], r["class"]): r["n"] for r in placed.groupBy("shard", "class").agg(F.count("*").alias("n")).collect()}
    held = [sum(counts.get((s, c), 0) for c in range(_CLASSES)) for s in range(shards)]
    before = [sum(counts.get((s, d), 0) for d in range(c)) for s in range(shards) for c in range(_CLASSES)]
    place = F.col("place") + _choose(F.col("shard") * _CLASSES + F.col("class"), before)
    placed = placed.select("row", "h", "shard", place.alias("slot"), (place < _choose(F.col("shard"), quota)).alias("stays"))
    # by the hash of the lot, so that the rows of a unit that must go fill neighbouring places
    over = dense_positions(placed.where("NOT stays").select("row", "h", F.lit(0).alias("all")),
        ["all"], ["h", "row"], None, "rank", rows=max(1, sum(max(0, held[s] - quota[s]) for s in range(shards))))
    gaps, at = [], 0  # (first rank, shard) of each gap
    for s in range(shards):
        if held[s] < quota[s]:
            gaps.append((at, s))
            at += quota[s] - held[s]
    shard = reduce(lambda e, g: F.when(F.col("rank") >= g[0], F.lit(g[1])).otherwise(e), gaps, F.lit(0))
    first = reduce(lambda e, g: F.when(F.col("rank") >= g[0], F.lit(g[0]).cast("long")).otherwise(e), gaps, F.lit(0).cast("long"))
    filled = over.select("row", shard.alias("shard"), (F.col("rank") - first).alias("from_gap")).select("row", "shard",
        (_choose(F.col("shard"), held) + F.col("from_gap")).alias("slot"))
    return placed.where("stays").select("row", "shard", "slot").unionByName(filled)


def op5_label_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    base = cut(read(spark, sf_dir, "documents").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"), F.md5(text).alias("key"),
    ), "shard-documents")
    dealt = propagate(base.select("row"), base.select("row", "key"))
    return base.join(dealt, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
