"""Phrase collocation mining with depth-limited count tries.

Words are named by 64-bit hashes of language and text (a hash that two words share is found, and another seed taken). A
shard is about SHARD_BYTES of text. It counts its n-grams in a trie: sorted paths of hashes, serialised level by level
(nodes, then how many rows each spans), cut by range of prefix. The tries of one prefix range are decoded and merged, and
nodes under LEAST occurrences go. Depth grows by passes, for a phrase can't be more frequent than its parts: words;
pairs of frequent words; triples and quadruples of frequent pairs. What is frequent reaches the shards as a bit filter
of fixed size, which may let more pass but loses nothing. In the merged trie the parent gives the left parts of a phrase,
level by level, and the suffix link (the node of its words but the first) the right parts.

Defined results: null text is empty and has no words; a null language is `und`, like that name; repeated rows count
each; ties of score and count fall by the phrase's bytes; very long texts are tokenised whole, alone in their batch; an
empty table gives an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .batches import by_bytes
from .common import cut, read, small_batches

DEPTH, LEAST, TOP = 4, 30, 2000
#: Bytes of text of a shard, and of one tokenised slice of it; bytes of text whose tries meet in one prefix range.
SHARD_BYTES, SLICE_BYTES, RANGE_BYTES = 5_000_000, 1_000_000, 32_000_000
#: Bits of a filter, as a power of two: 8 MB whatever the data.
FILTER_BITS = 26
#: A phrase goes if a longer one around it has so many per cent of its occurrences.
COVERED = 80
SCORE = 2_000_000
_BREAK, _BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte (0 word, 1 blank, 2 break), its lower case, and a random odd number for each."""
    kind, low = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
    kind[list(_BLANK)], kind[list(_BREAK)] = 1, 2
    low[ord("A") : ord("Z") + 1] += 32
    return kind, low, np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * np.uint64(0x2545F4914F6CDD1D) + b)


class Tokens:
    """The words of some texts: hash, piece number (equal inside a piece), text number and place in the bytes."""

    def __init__(self, texts: list[bytes], seeds: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]):
        kind, low, odd = tables
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
        kinds = kind[self.bytes]
        word = np.concatenate(([False], kinds == 0, [False]))
        self.start = np.flatnonzero(word[1:-1] & ~word[:-2])
        self.end = np.flatnonzero(word[1:-1] & ~word[2:]) + 1
        at = np.flatnonzero(word[1:-1])
        size = self.end - self.start
        first = np.cumsum(size) - size
        place = np.arange(len(at)) - np.repeat(first, size)
        self.bytes = low[self.bytes]
        self.piece = np.cumsum(kinds == 2)[self.start] if len(self.start) else self.start
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, side="right")
        if not len(at):
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        power = np.cumprod(np.full(int(size.max()), 0xD1342543DE82EF95, dtype=np.uint64))
        self.hash = _mix(np.add.reduceat(odd[self.bytes[at]] * power[place], first) ^ seeds[self.text])


def _seed_of(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8, salt=seed.to_bytes(8, "big")).digest(), "big")


def _shards(batches: Iterator[pa.RecordBatch], seed: int, shard_bytes: int, slice_bytes: int) -> Iterator[list[tuple[Tokens, list[str]]]]:
    """Batches (lang, text) as shards: lists of slices, each with the languages of its texts."""
    tables, shard, held = _tables(seed), [], 0
    for batch in batches:
        for part in by_bytes(batch, "text", slice_bytes):
            texts, langs = part.column("text").cast(pa.binary()).to_pylist(), part.column("lang").to_pylist()
            known = {g: _seed_of(g, seed) for g in set(langs)}
            shard.append((Tokens(texts, np.array([known[g] for g in langs], dtype=np.uint64), tables), langs))
            held += sum(map(len, texts))
            if held >= shard_bytes:
                yield shard
                shard, held = [], 0
    if shard:
        yield shard


def _words(docs: DataFrame, seed: int) -> DataFrame:
    """(h, lang, word, n) of all words."""
    sizes = SHARD_BYTES, SLICE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, seed, *sizes):
            seen: dict[int, list] = {}
            for tokens, langs in shard:
                hashes, at, counts = np.unique(tokens.hash, return_index=True, return_counts=True)
                text = tokens.bytes.tobytes()
                for h, a, b, k, n in zip(hashes.tolist(), tokens.start[at].tolist(), tokens.end[at].tolist(), tokens.text[at].tolist(), counts.tolist(), strict=True):
                    if h in seen:
                        seen[h][2] += n
                    else:
                        seen[h] = [langs[k], text[a:b].decode("utf-8", "replace"), n]
            rows = list(seen.values())
            for i in range(0, len(rows), 50_000):
                some = rows[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"h": np.fromiter(seen, dtype=np.uint64, count=len(seen))[i : i + 50_000].view(np.int64),
                    "lang": [r[0] for r in some], "word": [r[1] for r in some], "n": pa.array([r[2] for r in some], pa.int64())})

    return docs.mapInArrow(run, "h long, lang string, word string, n long").groupBy("h", "lang", "word").agg(F.sum("n").alias("n"))


def bit_filter(spark: SparkSession, hashes: DataFrame):
    """A broadcast array of 2 ** FILTER_BITS bits, those of the hashes' top bits set."""
    bit = F.shiftrightunsigned("h", 64 - FILTER_BITS)  # bitmap functions count from 1
    parts = hashes.select((bit + 1).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)
    for r in parts.toLocalIterator():  # 2 ** (FILTER_BITS - 15) rows of 4 kB at most
        out[(r["k"] - 1) * 4096 :][: len(r["bits"])] = np.frombuffer(r["bits"], dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(65 - (8 * len(bits)).bit_length())
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def grams(tokens: Tokens, depth: int, bits: np.ndarray) -> list[np.ndarray]:
    """The n-grams that may be frequent, as matrices of hashes: at depth 2 pairs of words that pass the filter, at
    greater depth all from 3 words on whose pairs pass it."""
    h, piece = tokens.hash, tokens.piece
    if len(h) < 2:
        return []
    near = piece[1:] == piece[:-1]
    if depth == 2:
        good = _passes(bits, h)
        at = np.flatnonzero(near & good[1:] & good[:-1])
        return [np.stack([h[at], h[at + 1]], 1)]
    pair = near & _passes(bits, _pair(h[:-1], h[1:]))
    out, run = [], pair
    for n in range(3, depth + 1):
        run = run[:-1] & pair[n - 2 :]
        at = np.flatnonzero(run)
        out.append(np.stack([h[at + k] for k in range(n)], 1))
    return out


def counted(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows once, sorted, with the sums of their counts."""
    order = np.lexsort(paths.T[::-1])
    paths, counts = paths[order], counts[order]
    head = np.flatnonzero(np.concatenate(([True], (paths[1:] != paths[:-1]).any(1))))
    return paths[head], np.add.reduceat(counts, head)


def serialise(paths: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted paths as a trie by levels: its nodes' words and how many rows each spans, then the rows' counts."""
    parts, new = [np.array([*paths.shape], dtype=np.int64)], np.zeros(len(paths), dtype=bool)
    new[:1] = True
    for k in range(paths.shape[1]):
        new[1:] |= paths[1:, k] != paths[:-1, k]
        head = np.flatnonzero(new)
        parts += [np.array([len(head)], dtype=np.int64), paths[head, k], np.diff(np.append(head, len(paths))).astype(np.uint32)]
    return b"".join(p.tobytes() for p in [*parts, counts.astype(np.int64)])


def deserialise(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, depth = np.frombuffer(blob, dtype=np.int64, count=2).tolist()
    paths, at = np.empty((rows, depth), dtype=np.uint64), 16
    for k in range(depth):
        (n,) = np.frombuffer(blob, dtype=np.int64, count=1, offset=at).tolist()
        nodes = np.frombuffer(blob, dtype=np.uint64, count=n, offset=at + 8)
        paths[:, k] = np.repeat(nodes, np.frombuffer(blob, dtype=np.uint32, count=n, offset=at + 8 + 8 * n))
        at += 8 + 12 * n
    return paths, np.frombuffer(blob, dtype=np.int64, count=rows, offset=at)


def _range_of(paths: np.ndarray, ranges: int) -> np.ndarray:
    """The prefix range of each path, by at most three words, so that no frequent word or pair fills one range."""
    key = paths[:, 0]
    for k in range(1, min(3, paths.shape[1])):
        key = _pair(key, paths[:, k])
    return ((key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _merged(docs: DataFrame, depth: int, bits, ranges: int, seed: int, least: int) -> DataFrame:
    """(path array<long>, a, h) of the n-grams of this depth's pass with `least` occurrences; h names the first two words."""
    sizes = SHARD_BYTES, SLICE_BYTES

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, seed, *sizes):
            found = [grams(tokens, depth, bits.value) for tokens, _ in shard]
            for same_depth in zip(*[f for f in found if f], strict=True):
                paths = np.concatenate(same_depth)
                if not len(paths):
                    continue
                paths, counts = counted(paths, np.ones(len(paths), dtype=np.int64))
                own = _range_of(paths, ranges)
                order = np.argsort(own, kind="stable")  # sorted paths stay sorted inside a range
                paths, counts, own = paths[order], counts[order], own[order]
                ends = np.flatnonzero(np.diff(own, append=-1)) + 1
                begin = 0
                for end in ends.tolist():
                    yield pa.RecordBatch.from_pydict({"words": pa.array([paths.shape[1]], pa.int32()), "part": pa.array([own[begin]], pa.int64()),
                        "trie": pa.array([serialise(paths[begin:end], counts[begin:end])], pa.binary())})
                    begin = end

    def merge(rows: pa.Table) -> pa.Table:
        tries = [deserialise(b.as_py()) for b in rows.column("trie")]
        paths, counts = counted(np.concatenate([t[0] for t in tries]), np.concatenate([t[1] for t in tries]))
        often = counts >= least
        paths, words = paths[often], paths.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(paths) + 1) * words, words, dtype=np.int32)), paths.view(np.int64).ravel())
        return pa.table({"path": lists, "a": counts[often], "h": _pair(paths[:, 0], paths[:, 1]).view(np.int64)})

    tries = docs.mapInArrow(shards, "words int, part long, trie binary")
    return tries.groupBy("words", "part").applyInArrow(merge, "path array<long>, a long, h long")


def _level(nodes: DataFrame, shorter: DataFrame, n: int) -> DataFrame:
    """Nodes of n words with what their parent and their suffix link know: (path, a, lang, phrase, last, lefts, rights),
    lefts and rights by the number of words cut off in front."""
    parent = shorter.select(F.col("path").alias("parent"), "lang", F.col("phrase").alias("front"),
        F.concat("lefts", F.array("a")).alias("lefts"))
    link = shorter.select(F.col("path").alias("link"), "last", F.concat(F.array("a"), "rights").alias("rights"))
    rows = nodes.withColumns({"parent": F.slice("path", 1, n - 1), "link": F.slice("path", 2, n - 1)}).join(parent, "parent").join(link, "link")
    return rows.select("path", "a", "lang", F.concat_ws(" ", "front", "last").alias("phrase"), "last", "lefts", "rights")


def _inside(level: DataFrame, n: int, longer: int) -> DataFrame:
    """(path, around): the phrases of n words inside those of `longer` words, with the latter's occurrences."""
    return level.select(F.explode(F.array(*[F.slice("path", k + 1, n) for k in range(longer - n + 1)])).alias("path"), F.col("a").alias("around"))


def _weakest(n: int) -> Column:
    """The cut of lowest score, the first of equals, as a struct (score, k, l, r)."""
    cuts = []
    for k in range(1, n):
        left, right = F.col("lefts")[k - 1], F.col("rights")[k - 1]
        score = F.expr(f"cast(a as decimal(19,0)) * {SCORE}BD div (cast(lefts[{k - 1}] as decimal(19,0)) + rights[{k - 1}])")
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r")))
    return F.array_min(F.array(*cuts))


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP) -> DataFrame:
    """docs to (lang, rank, phrase, a, l, r, n, score), the first `top` of each language."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    for seed in range(1, 100):
        words = cut(_words(docs, seed), "collocation-words")
        count = words.agg(F.count("*").alias("all"), F.count_distinct("h").alias("distinct")).first()
        if count["all"] == count["distinct"]:
            break
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-size // RANGE_BYTES))
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    often = words.where(F.col("n") >= least)
    none = F.array().cast("array<long>")
    level = often.select(F.array("h").alias("path"), F.col("n").alias("a"), "lang", F.col("word").alias("phrase"), F.col("word").alias("last"),
        none.alias("lefts"), none.alias("rights"))
    pairs = cut(_merged(docs, 2, bit_filter(spark, often), ranges, seed, least), "collocation-pairs")
    longer = cut(_merged(docs, DEPTH, bit_filter(spark, pairs), ranges, seed, least), "collocation-longer")
    levels = {}
    for n in range(2, DEPTH + 1):
        nodes = pairs if n == 2 else longer.where(F.size("path") == n)
        level = levels[n] = cut(_level(nodes, level, n), f"collocation-{n}")
    out = None
    for n, rows in levels.items():
        rows = rows.withColumn("weakest", _weakest(n))
        around = [_inside(levels[m], n, m) for m in range(n + 1, DEPTH + 1)]
        if around:
            most = around[0]
            for more in around[1:]:
                most = most.unionByName(more)
            most = most.groupBy("path").agg(F.max("around").alias("around"))
            rows = rows.join(most, "path", "left").where(F.expr(f"around IS NULL OR cast(around as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {COVERED}"))
        rows = rows.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")
        out = rows if out is None else out.unionByName(rows)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT rid, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS (SELECT row_number() OVER () AS pid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
w AS (SELECT pid, lang, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM p),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM w WINDOW o AS (PARTITION BY pid ORDER BY i)),
f AS MATERIALIZED (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM g GROUP BY ALL UNION ALL SELECT lang, 2, w1 || ' ' || w2, count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4, count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= 30),
s AS (SELECT lang, size, phrase, ws, a, unnest(range(1, size)) AS k FROM c),
x AS MATERIALIZED (SELECT s.lang, s.phrase, s.a, s.k, f.f AS l, array_to_string(s.ws[s.k + 1:], ' ') AS rest FROM s JOIN f ON f.lang = s.lang AND f.phrase = array_to_string(s.ws[1:s.k], ' ')),
v AS (SELECT x.lang, x.phrase, x.a, x.k, x.l, f.f AS r, (2000000::HUGEINT * x.a) // (x.l::HUGEINT + f.f::HUGEINT) AS score FROM x JOIN f ON f.lang = x.lang AND f.phrase = x.rest),
b AS (SELECT lang, phrase, a, arg_min(l, (score, k)) AS l, arg_min(r, (score, k)) AS r, min(score) AS score FROM v GROUP BY lang, phrase, a),
i AS (SELECT lang, a, ws, unnest(range(1, size + 1)) AS x, size FROM c WHERE size > 2),
j AS (SELECT lang, a, ws, x, unnest(range(x + 1, size + 1)) AS y, size FROM i),
m AS (SELECT lang, array_to_string(ws[x:y], ' ') AS phrase, max(a) AS around FROM j WHERE y - x + 1 < size GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN t USING (lang) WHERE rank <= 2000
"""
