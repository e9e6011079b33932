"""N-gram Jaccard self-join by a MinHash LSH forest, with exact verification.

Every text becomes its set of five-word shingles (64-bit hashes); texts of equal sets are copies and stand as one
set from then on. A set has, in each of TREES trees, a path of LONGEST MinHash labels. A tree is kept as the table of
its prefixes that two sets or more share, with the number of sets below each: the inner nodes of a prefix trie, from
SHORTEST labels on (sets alone below a prefix find nobody there, so their rows end at once).

Each set is a query. It starts at its full paths, which already meet a pair at the threshold with the recall FLOOR,
and shortens them label by label in all trees at once for as long as the shorter prefixes bring ENOUGH candidates at
most: a set in a sparse neighbourhood so reaches the recall TARGET, one among many near copies stays at its full
paths. A pair is a candidate if either set finds the other.

Candidates are verified exactly, each pair once. Below small trie nodes they are listed as pairs (CROWD sets a node at
most, so their number grows with the rows, not with a group), and a task gets a set with its partners. Sets below
larger nodes are dealt into blocks by their largest node and their size; blocks that share a node are compared whole by
matrix products, and a task reports for each set its number of links and one set that it is linked with, never the
pairs. So a large group costs comparisons but no rows, and no link inside it is missed. A link is missed only if its
two sets share no prefix of the queries' lengths in any tree and no compared blocks: 1 - FLOOR is the bound at the
threshold, and there is no exact way for these.

Defined results: null text is empty; a text of one to four words has one shingle, all its words; texts without a
word are copies of equal texts only; repeated rows are copies; ties of ids fall to the lowest, nulls last; of rows
equal in id and text, keep_one keeps the first by a hash of all columns; an empty table gives an empty table; only the named columns
are read, and the rows that keep_one gives are packed while it works, so that no column's name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import by_bytes
from .common import cut, discard, pack, read, row_hash
from .shingles import minhash, overlaps, shingle_sets

#: The threshold as a fraction, compared in integers.
SIMILAR, OF = 4, 5
TREES, FLOOR, TARGET = 24, 0.9999, 0.999999
#: A query shortens its prefixes while they bring so many candidates at most.
ENOUGH = 15
#: Sets below a node whose pairs are listed.
CROWD = ENOUGH + 1
BATCH_BYTES = 1_000_000
#: A block of sets: at most so many sets and about so many shingles.
BLOCK_SETS, BLOCK_SHINGLES = 256, 500_000


def recall_of(length: int, trees: int = TREES, similar: float = SIMILAR / OF) -> float:
    """The chance that two sets of that similarity share a prefix of that length in some tree."""
    return 1 - (1 - similar**length) ** trees


def prefix_for(recall: float, trees: int = TREES, similar: float = SIMILAR / OF) -> int:
    """The longest prefix that reaches the recall at the threshold."""
    length = 1
    while recall_of(length + 1, trees, similar) >= recall:
        length += 1
    return length


LONGEST, SHORTEST = prefix_for(FLOOR), prefix_for(TARGET)


def signatures(docs: DataFrame, trees: int = TREES, length: int = LONGEST) -> DataFrame:
    """docs (doc_id, th, text) to (doc_id, th, sfp, n, labels): sfp names the shingle set, n is its size; labels are
    the paths of all trees, one after another."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    per = trees * length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                sets = shingle_sets(batch.column("text").to_pylist())
                full = [i for i, s in enumerate(sets) if len(s)]
                found = minhash([sets[i] for i in full], per) if full else np.zeros((0, per), dtype=np.int16)
                at = np.zeros(len(sets) + 1, dtype=np.int32)
                at[1:] = np.cumsum([per if len(s) else 0 for s in sets])
                th = batch.column("th").to_pylist()
                names = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else f"-{h}" for s, h in zip(sets, th)]
                sizes = pa.array([len(s) for s in sets], pa.int32())
                labels = pa.ListArray.from_arrays(pa.array(at), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(names, pa.string()), sizes, labels],
                    names=["doc_id", "th", "sfp", "n", "labels"])

    return docs.select("doc_id", "th", "text").mapInArrow(run, f"doc_id {kind}, th string, sfp string, n int, labels array<smallint>")


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) longs to (node, label): the least node of each node's component.

    Each round hooks every node to its least neighbour's least neighbour and contracts the graph to the nodes that
    were hooked to, so rounds get shorter; at the end the hooks are followed from the last round back to the first.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    hooks = []
    while not hooks or not edges.isEmpty():
        near = cut(both(edges).groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("up")), "hooks")
        far = near.select(F.col("node").alias("__node"), F.col("up").alias("__far"))
        step = cut(near.join(far, near["up"] == far["__node"]).select("node", F.col("__far").alias("up")), "hooks")
        hooks.append(step)
        left, right = step.select(F.col("node").alias("a"), F.col("up").alias("x")), step.select(F.col("node").alias("b"), F.col("up").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        held, edges = edges, cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        discard(near, held)
    discard(edges)
    out, steps = hooks.pop().select("node", F.col("up").alias("label")), list(hooks)
    while hooks:
        step, after = hooks.pop(), out.select(F.col("node").alias("__node"), F.col("label").alias("__label"))
        out = step.join(after, step["up"] == after["__node"], "left").select("node", F.coalesce("__label", "up").alias("label"))
    out = cut(out, "labels")
    discard(*steps)
    return out


def forest(sets: DataFrame, trees: int = TREES, longest: int = LONGEST, shortest: int = SHORTEST) -> DataFrame:
    """sets (node, labels) to the tries (node, level, key, size): the prefixes of `level` labels of each set that it
    shares, with the number of sets below. A key names its tree, its level and its labels."""
    lengths = range(shortest, longest + 1)
    path = F.slice("labels", F.col("tree") * longest + 1, F.lit(longest))
    rows = sets.select("node", "labels", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("node", "tree", path.alias("path"))
    rows = rows.select("node", *[F.xxhash64("tree", F.lit(k), F.slice("path", 1, k)).alias(f"k{k}") for k in lengths])
    shared = lambda k: rows.groupBy(f"k{k}").agg(F.count("*").alias(f"s{k}")).where(F.col(f"s{k}") > 1)
    rows = cut(rows.join(shared(shortest), f"k{shortest}"), "jaccard-shared")  # below an unshared prefix nothing is shared
    found = rows
    for k in lengths[1:]:
        found = found.join(shared(k), f"k{k}", "left")
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"k{k}").alias("key"), F.col(f"s{k}").alias("size")) for k in lengths])
    found = cut(found.select("node", F.explode(F.filter(places, lambda p: p["size"].isNotNull())).alias("p")).select("node", "p.*"), "jaccard-tries")
    discard(rows)
    return found


def queries(tries: DataFrame, longest: int = LONGEST, shortest: int = SHORTEST, enough: int = ENOUGH) -> DataFrame:
    """(node, key, size): the prefixes at which each set asks: the shortest that bring `enough` candidates at most,
    or else the longest."""
    lengths = range(shortest, longest + 1)
    found = tries.groupBy("node").agg(*[F.sum(F.when(F.col("level") == k, F.col("size") - 1)).alias(f"c{k}") for k in lengths])
    asked = F.coalesce(*[F.when(F.coalesce(F.col(f"c{k}"), F.lit(0)) <= enough, F.lit(k)) for k in lengths], F.lit(longest))
    return tries.join(found.select("node", asked.alias("level")), ["node", "level"]).select("node", "key", "size")


def listed(asked: DataFrame, tries: DataFrame, dealt: DataFrame, near: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b, once each: the candidates below nodes of `crowd` sets at most, without those whose blocks are
    compared anyway."""
    found = asked.where(F.col("size") <= crowd).select("key", F.col("node").alias("x"))
    below = tries.where(F.col("size") <= crowd)  # sets of crowded nodes have no partner here
    pairs = found.join(below.select("key", F.col("node").alias("y")), "key").where("x <> y").select(F.least("x", "y").alias("a"),
        F.greatest("x", "y").alias("b")).distinct()
    own = lambda n: dealt.select(F.col("node").alias(n), F.col("block").alias(f"{n}_block"))
    pairs = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
    pairs = pairs.withColumn("x", F.when(F.col("b_block").isNotNull(), F.least("a_block", "b_block"))).withColumn("y",
        F.when(F.col("a_block").isNotNull(), F.greatest("a_block", "b_block")))
    return pairs.join(near, ["x", "y"], "left_anti").select("a", "b")


def blocks(asked: DataFrame, tries: DataFrame, sizes: DataFrame, crowd: int = CROWD, shortest: int = SHORTEST) -> tuple[DataFrame, DataFrame]:
    """asked: (node, key, size), tries: of forest, sizes: (node, n). Returns (node, block), a row for each set below a node of more
    than `crowd` sets, and (x, y): the blocks, x <= y, that share such a node and whose sizes may be similar.

    A block takes sets of one largest node of the shortest length, which most of a group share, and of one class of
    size, in which sizes differ by the threshold at most.
    """
    keys = asked.where(F.col("size") > crowd).groupBy("node").agg(F.collect_set("key").alias("keys"))  # a key a tree at most
    widest = tries.where(F.col("level") == shortest).groupBy("node").agg(F.max(F.struct("size", "key"))["key"].alias("main"))
    main = keys.join(widest, "node")
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(OF / SIMILAR)) + 1e-9).cast("int")
    main = main.join(sizes, "node").withColumn("class", step)
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).cast("long")
    main = main.join(main.groupBy("main", "class").agg(parts.alias("parts")), ["main", "class"])
    dealt = main.select("node", "class", "keys", F.xxhash64("main", "class", F.pmod(F.xxhash64("node"), "parts")).alias("block"))
    dealt = cut(dealt, "jaccard-blocks")
    seen = dealt.select("block", "class", F.explode("keys").alias("key")).distinct()
    other = seen.select("key", F.col("block").alias("y"), F.col("class").alias("y_class"))
    near = seen.join(other, "key").where((F.col("block") <= F.col("y")) & (F.abs(F.col("class") - F.col("y_class")) <= 1))
    return dealt.select("node", "block"), near.select(F.col("block").alias("x"), "y").distinct()


def similar(common: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Jaccard of at least SIMILAR / OF, from common elements and sizes."""
    either = left + right - common
    return (common * OF >= SIMILAR * either) & (either > 0)


_FOUND = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("head", pa.int64())])


def verify_pairs(placed: DataFrame) -> DataFrame:
    """placed: (a, node, text), a set a itself and its partners, to (node, links, head). A task holds one set a and
    one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, own, links = None, None, 0
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                out: list[tuple[int, int, int]] = []
                a, node = batch.column("a").to_pylist(), batch.column("node").to_pylist()
                for i, s in enumerate(shingle_sets(batch.column("text").to_pylist())):
                    if node[i] == a[i]:  # a is the least of its group, so it comes first
                        if links:
                            out.append((head, links, head))
                        head, own, links = a[i], s, 0
                    elif similar(np.float64(len(np.intersect1d(own, s, assume_unique=True))), len(own), len(s)):
                        links += 1
                        out.append((node[i], 1, head))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)] or [pa.array([], pa.int64())] * 3, schema=_FOUND)
        if links:
            yield pa.RecordBatch.from_pydict({"node": [head], "links": [links], "head": [head]}, schema=_FOUND)

    return placed.select("a", "node", "text").repartition("a").sortWithinPartitions("a", "node").mapInArrow(run, "node long, links long, head long")


def _report(one: bool, nodes: list[int], sides: list[int], sets: list[np.ndarray]) -> tuple[list[int], list[int], list[int]]:
    """Of one pair of blocks: the nodes, their links, and the least node that each is linked with in steps."""
    side, n = np.array(sides), np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    left = np.arange(len(sets)) if one else np.flatnonzero(side == 0)
    right = left if one else np.flatnonzero(side == 1)
    near = similar(overlaps(sets, left, right), n[left][:, None], n[right][None, :])
    if one:
        np.fill_diagonal(near, False)
    links = np.zeros(len(sets), dtype=np.int64)
    links[left] += near.sum(axis=1)
    if not one:
        links[right] += near.sum(axis=0)
    label = np.argsort(np.argsort(nodes))  # labels compare by node
    i, j = np.nonzero(near)
    i, j = left[i], right[j]
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        if (new == label).all():
            break
        label = new
    linked = links > 0
    return np.array(nodes)[linked].tolist(), links[linked].tolist(), np.sort(nodes)[label][linked].tolist()


def verify_blocks(placed: DataFrame) -> DataFrame:
    """placed: (x, y, side, node, text) to (node, links, head), a row for each linked set in each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, nodes, sides, sets = None, [], [], []

        def close() -> pa.RecordBatch:
            found = _report(pair[0] == pair[1], nodes, sides, sets) if len(nodes) > 1 else ([], [], [])
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], schema=_FOUND)

        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                x, y, side, node = (batch.column(c).to_pylist() for c in ("x", "y", "side", "node"))
                for i, s in enumerate(shingle_sets(batch.column("text").to_pylist())):
                    if (x[i], y[i]) != pair:
                        if pair:
                            yield close()
                        pair, nodes, sides, sets = (x[i], y[i]), [], [], []
                    nodes.append(node[i])
                    sides.append(side[i])
                    sets.append(s)
        if pair:
            yield close()

    return placed.select("x", "y", "side", "node", "text").repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(run,
        "node long, links long, head long")


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.md5(F.col("text").cast("binary")))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, sets). rows: (doc_id, th, sfp) of each input row, th its text's md5, sfp its shingle set's name.
    sets: (sfp, doc_id, th, n_copies, n_links, keep), doc_id and th of the set's first row, keep those of the first
    row of its class."""
    named = _named(docs, key, text)
    signed = cut(signatures(named), "jaccard-signatures")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    # rows of one set have the same n and labels
    sets = signed.groupBy("sfp").agg(F.min(first).alias("own"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("labels").alias("labels"))
    sets = cut(sets.select(F.monotonically_increasing_id().alias("node"), "sfp", "own.doc_id", "own.th", "n_copies", "n", "labels"), "jaccard-sets")
    tries = forest(sets.where("n > 0"))
    asked = cut(queries(tries), "jaccard-queries")
    dealt, near = blocks(asked, tries, sets.select("node", "n"))
    near = cut(near, "jaccard-block-pairs")
    pairs = cut(listed(asked, tries, dealt, near), "jaccard-pairs")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(dealt.select("node")).distinct()
    whole = sets.select("node", F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).join(wanted, "node")
    texts = named.join(whole, (named["th"] == whole["__th"]) & named["doc_id"].eqNullSafe(whole["__doc"])).select("node", "text").dropDuplicates(["node"])
    texts = cut(texts, "jaccard-texts")
    grouped = pairs.select("a", F.col("b").alias("node")).unionByName(pairs.select("a", F.col("a").alias("node")).distinct())
    of_block = lambda side: dealt.select("node", F.col("block").alias(side))
    sides = near.join(of_block("x"), "x").withColumn("side", F.lit(0)).unionByName(near.where("x < y").join(of_block("y"), "y").withColumn("side", F.lit(1)))
    found = verify_pairs(grouped.join(texts, "node")).unionByName(verify_blocks(sides.join(texts, "node")))
    seen = cut(found, "jaccard-links")
    discard(texts, near, pairs, asked, tries)
    degree = seen.groupBy("node").agg(F.sum("links").alias("n_links"))
    classes = connected(seen.select(F.col("node").alias("a"), F.col("head").alias("b")))
    least = sets.join(classes, "node").groupBy("label").agg(F.min(first).alias("keep"))
    keep = classes.join(least, "label").select("node", "keep")
    sets = sets.drop("labels").join(degree, "node", "left").join(keep, "node", "left")
    return signed.select("doc_id", "th", "sfp"), sets.select("sfp", "doc_id", "th", "n_copies",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("keep", first).alias("keep"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, copy_id, n_copies), a row for each input row.

    class_id: the least doc_id of the documents linked with it in any number of steps; n_links: the different
    shingle sets that its own is linked with; copy_id and n_copies: the least doc_id and the rows of its own set.
    """
    rows, sets = link(docs, key, text)
    of_set = sets.select("sfp", F.col("keep.doc_id").alias("class_id"), "n_links", F.col("doc_id").alias("copy_id"), "n_copies")
    return rows.select("doc_id", "sfp").join(of_set, "sfp").select("doc_id", "class_id", "n_links", "copy_id", "n_copies")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The first document of each class, with all its columns: the one of the least id, then of the least text hash,
    then by a hash of all columns."""
    _, sets = link(docs, key, text)
    kept = sets.select(F.col("keep.doc_id").alias("kept_id"), F.col("keep.th").alias("kept_th")).distinct()
    packed = pack(docs, doc_id=F.col(key), th=F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), tie=row_hash(docs))
    own = packed.join(kept, (packed["th"] == kept["kept_th"]) & packed["doc_id"].eqNullSafe(kept["kept_id"]))
    return own.groupBy("doc_id", "th").agg(F.min_by("row", "tie").alias("row")).select("row.*")


def op2_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"))
