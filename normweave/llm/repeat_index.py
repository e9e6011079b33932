"""Exact removal of long repeats with run-length indexes over repetitive text.

Each window of LENGTH bytes belongs to the anchor inside it: of its strings of ANCHOR bytes the one of least hash, the
first of equals. Equal windows have equal anchors at equal places, so a window's copies are found among the occurrences
of its anchor. An occurrence's windows are neighbours; the bytes they cover are its segment.

* Anchors that occur once end here. Equal segments count once; if there are several, all their windows are repeated.
* What is left are segments that share an anchor and differ. They go, by anchor, to buckets of about BUCKET_BYTES. A bucket
  builds the run-length Burrows-Wheeler transform of its segments with the suffixes sampled at both ends of each run.
  A position's longest match elsewhere is one less than its predecessor's, save at the sampled run ends, where it is
  compared; so matching statistics stream over the text from the samples, and matches of LENGTH or more are marked.
* An anchor with more than GROUP different segments is split: its windows fall into halves by their distance from the
  anchor, and the bytes common to a half's windows make the new key, until no group is too large. A half of one window
  has one content a key, so this ends, and no pair of segments is ever listed.

Segments and anchors are compared by 64-bit hashes each, so two different ones count as equal with a chance of about
2 ** -128 a pair; windows of different segments are compared byte by byte. Defined results: null text is empty; texts
under LENGTH bytes lose nothing; repeated rows are copies of each other, so they lose all windows, each of them; ties
cannot be; very long texts are cut into pieces that overlap by LENGTH - 1 bytes while anchors are sought; an empty table
gives an empty table; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .batches import by_bytes
from .common import cut, discard, read, small_batches

LENGTH = 400
ANCHOR = 200
#: Bytes of a slice in which anchors are sought (positions take PLACE_BITS bits), and of segments in one index.
SLICE_BYTES, PLACE_BITS, BUCKET_BYTES = 1_000_000, 24, 2_000_000
#: Different segments of one anchor that one index takes.
GROUP = 2_000
_BASE = 0xD1342543DE82EF95


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    h = (h ^ (h >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64, 2 ** bits of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        factors = np.full(1 << bits, base, dtype=np.uint64)
        factors[0] = 1
        out.append(np.cumprod(factors))
    return tuple(out)


@cache
def _odd(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Hashes of any substring of data, from prefix sums."""

    def __init__(self, data: np.ndarray, seed: int):
        power, self.back = _powers(max(1, int(len(data)).bit_length()))
        self.sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(_odd(seed)[data] * power[: len(data)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.back[start])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima of blocks of that width."""
    n = len(v) - width + 1
    blocks = np.full(-(-len(v) // width) * width, np.iinfo(v.dtype).max, dtype=v.dtype)
    blocks[: len(v)] = v
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(pieces: list[bytes], length: int = LENGTH, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """The segments of some pieces of text: piece, start in it, shape (place of the anchor, size), hashes of the anchor
    and of the segment with its shape."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    ends = np.cumsum(sizes)
    n = len(data) - length + 1
    piece = np.repeat(np.arange(len(pieces)), sizes)
    at = np.flatnonzero(piece[:n] == piece[length - 1 :]) if n > 0 else np.zeros(0, dtype=np.int64)  # windows inside a piece
    if not len(at):
        return {k: np.zeros(0, dtype=t) for k, t in (("piece", np.int64), ("start", np.int32), ("shape", np.int32), ("key", np.int64), ("content", np.int64))}
    names = Hashes(data, 1)
    grams = names.of(np.arange(len(data) - anchor + 1), np.arange(anchor, len(data) + 1))
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), length - anchor + 1)
    own = (least[at] & low).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1))))
    start, last, own = at[head], at[np.append(head[1:], len(at)) - 1], own[head]
    end = last + length
    shape = (own - start) * 4 * length + end - start
    content = _mix(Hashes(data, 2).of(start, end) + shape.astype(np.uint64))
    which = piece[start]
    return {"piece": which, "start": (start - (ends - sizes)[which]).astype(np.int32), "shape": shape.astype(np.int32),
        "key": grams[own].view(np.int64), "content": content.view(np.int64)}


class RunIndex:
    """A run-length Burrows-Wheeler transform of some strings, each with an end mark of its own."""

    def __init__(self, strings: list[bytes]):
        marks, size = len(strings), [len(s) + 1 for s in strings]
        kind = np.uint16 if marks + 256 < 1 << 16 else np.uint32
        self.first = np.cumsum([0, *size])
        self.text = np.frombuffer(b"\0".join([*strings, b""]), dtype=np.uint8).astype(kind) + kind(marks)
        self.text[self.first[1:] - 1] = np.arange(marks, dtype=kind)
        order = self._sorted()
        before = self.text[order - 1]  # the transform; position 0 wraps to the last end mark
        new = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.symbols, self.lengths = before[new], np.diff(np.append(new, len(order)))
        last = np.append(new[1:], len(order)) - 1
        # the suffixes at the first and last place of each run, and their neighbours beyond
        self.firsts, self.lasts = order[new], order[last]

    def _sorted(self) -> np.ndarray:
        """The suffixes in order, by doubling; only suffixes that are still tied are sorted again."""
        n = len(self.text)
        wide = np.concatenate((self.text, np.zeros(4, dtype=self.text.dtype))).astype(np.uint64)
        step = 4 if self.text.dtype == np.uint16 else 2
        key = wide[:n]
        for k in range(1, step):
            key = (key << np.uint64(64 // step)) | wide[k : n + k]
        rank, tied = np.zeros(n, dtype=np.int64), np.arange(n)
        while len(tied):
            order = np.argsort(key, kind="stable")
            tied, key, old = tied[order], key[order], rank[tied[order]]
            place = np.arange(len(tied))
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], old[1:] != old[:-1]))
            head = np.maximum.accumulate(np.where(new, place, 0))
            rank[tied] = old + head - np.maximum.accumulate(np.where(group, place, 0))
            tied = tied[~(new & np.append(new[1:], True))]
            key = rank[tied] * (n + 1) + np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
            step *= 2
        order = np.empty(n, dtype=np.int64)
        order[rank] = np.arange(n)
        return order

    def _common(self, a: np.ndarray, b: np.ndarray, width: int = 32) -> np.ndarray:
        """Lengths of the common prefixes of suffixes a and b; end marks differ, so none goes beyond one."""
        text = np.concatenate((self.text, np.zeros(width, dtype=self.text.dtype)))
        out, live = np.zeros(len(a), dtype=np.int64), np.arange(len(a))
        reach = np.arange(width)
        while len(live):
            still = []
            for part in np.array_split(live, -(-len(live) // 20_000)):
                x, y = a[part] + out[part], b[part] + out[part]
                same = text[x[:, None] + reach] == text[y[:, None] + reach]
                whole = same.all(1)
                out[part] += np.where(whole, width, same.argmin(1))
                still.append(part[whole])
            live = np.concatenate(still)
        return out

    def matches(self) -> np.ndarray:
        """For each position the length of its longest match that begins elsewhere, streamed from the samples."""
        place = np.arange(len(self.text))
        best = np.zeros(len(self.text), dtype=np.int64)
        ways = ((self.firsts[1:], self.lasts[:-1], self.firsts[0]), (self.lasts[:-1], self.firsts[1:], self.lasts[-1]))
        for at, beside, edge in ways:  # with the suffix before in order, and with the one after
            ends = np.full(len(self.text), -1, dtype=np.int64)
            ends[at] = at + self._common(at, beside)
            ends[edge] = edge
            sample = np.maximum.accumulate(np.where(ends >= 0, place, 0))
            best = np.maximum(best, ends[sample] - place)
        return best


def _found(texts: DataFrame) -> DataFrame:
    """(row, text binary) to (row, start, shape, key, content): all segments."""
    slice_bytes, widest = SLICE_BYTES, 1 << PLACE_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch, "text", slice_bytes):
                rows, texts = part.column("row").to_numpy(), part.column("text").to_pylist()
                for group in _pieces(texts, widest):
                    s = segments([texts[k][a:b] for k, a, b in group])
                    which = np.array([k for k, _, _ in group], dtype=np.int64)[s["piece"]]
                    start = s["start"] + np.array([a for _, a, _ in group], dtype=np.int32)[s["piece"]]
                    yield pa.RecordBatch.from_pydict({"row": rows[which], "start": start, "shape": s["shape"], "key": s["key"], "content": s["content"]})

    return texts.mapInArrow(run, "row long, start int, shape int, key long, content long")


def _pieces(texts: list[bytes], widest: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of fewer than `widest` bytes; a longer text is cut into pieces whose windows are apart."""
    group, held = [], 0
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), widest // 2):
            b = min(len(text), a + widest // 2 + LENGTH - 1)
            if held and held + b - a >= widest:
                yield group
                group, held = [], 0
            group.append((k, a, b))
            held += b - a
    if group:
        yield group


def _indexed(parts: DataFrame, size: int) -> DataFrame:
    """parts (key, row, start, n, bytes) to (row, start, end): what the indexes mark in the parts that occur once."""
    length = LENGTH

    def mark(rows: pa.Table) -> pa.Table:
        strings = rows.column("bytes").to_pylist()
        index = RunIndex(strings)
        hit = index.matches() >= length
        edge = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2] - 1 + length  # runs of marked windows; none goes over an end mark
        owner = np.searchsorted(index.first, begin, side="right") - 1
        at = rows.column("start").to_numpy()[owner] - index.first[owner]
        once = rows.column("n").to_numpy()[owner] == 1
        return pa.table({"row": rows.column("row").to_numpy()[owner][once], "start": (begin + at)[once], "end": (end + at)[once]})

    buckets = max(1, -(-size // BUCKET_BYTES))
    keyed = parts.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "row", "start", "n", "bytes")
    return keyed.groupBy("bucket").applyInArrow(mark, "row long, start long, end long")


def _counted(parts: DataFrame) -> DataFrame:
    """parts (key, content, n, …) as one row for each content of the keys that occur more than once: (key, content, n, rep,
    kinds), where n sums the content's n, rep is one of its parts and kinds is the number of the key's contents."""
    rest = [c for c in parts.columns if c not in ("key", "content", "n")]
    each = parts.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min(F.struct(*rest)).alias("rep"))
    keys = each.groupBy("key").agg(F.sum("n").alias("of"), F.count("*").alias("kinds")).where("of > 1").select("key", "kinds")
    return each.join(keys, "key")


def _halves(parts: DataFrame) -> DataFrame:
    """parts (key, n, row, start, place, near, far, bytes) with windows between near and far from the anchor, as two parts
    each: the nearer and the farther windows, under a key of the bytes that such windows share."""
    middle = F.floor((F.col("near") + F.col("far")) / 2).cast("int")
    sides = F.array(F.struct(F.col("near").alias("lo"), middle.alias("hi")), F.struct((middle + 1).alias("lo"), F.col("far").alias("hi")))
    rows = parts.select("*", F.explode(sides).alias("side")).select("*", "side.*")
    first = F.greatest(F.lit(0), F.col("place") - F.col("hi"))
    last = F.least(F.col("place") - F.col("lo"), F.octet_length("bytes") - LENGTH)
    rows = rows.withColumns({"first": first, "last": last}).where("first <= last")
    shared = F.substring("bytes", F.col("place") - F.col("lo") + 1, LENGTH - (F.col("hi") - F.col("lo")))
    own = F.substring("bytes", F.col("first") + 1, F.col("last") - F.col("first") + LENGTH)
    rows = rows.select(F.xxhash64("key", "lo", shared).alias("key"), "n", "row", (F.col("start") + F.col("first")).alias("start"),
        (F.col("place") - F.col("first")).alias("place"), F.col("lo").alias("near"), F.col("hi").alias("far"), own.alias("bytes"))
    return rows.withColumn("content", F.xxhash64("place", "bytes"))


def repeated(texts: DataFrame) -> DataFrame:
    """(row, text binary) to (row, start, end): byte ranges whose windows are repeated; they may overlap and touch."""
    small_batches(texts.sparkSession)
    found = cut(_found(texts), "repeat-segments")
    often = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    candidates = cut(found.join(often, "key"), "repeat-candidates")
    discard(found)
    known = cut(_counted(candidates.select("key", "content", F.lit(1).cast("long").alias("n"), "row", "start", "shape")), "repeat-contents")
    size = lambda shape: shape % (4 * LENGTH)
    ranges = lambda rows, end: rows.select("row", F.col("start").cast("long").alias("start"), end.cast("long").alias("end"))
    equal = known.where("n > 1").select("key", "content")
    marks = [ranges(candidates.join(equal, ["key", "content"]), F.col("start") + size(F.col("shape")))]
    # of the anchors with several contents one segment for each, with its bytes
    mixed = known.where("kinds > 1").groupBy("rep.row").agg(F.collect_list(F.struct("key", "n", "rep.start", "rep.shape")).alias("s"))
    with_bytes = F.transform("s", lambda s: F.struct(s["key"].alias("key"), s["n"].alias("n"), s["start"].alias("start"),
        F.floor(s["shape"] / (4 * LENGTH)).cast("int").alias("place"), F.substring("text", s["start"] + 1, size(s["shape"])).alias("bytes")))
    mixed = mixed.join(texts, "row").select("row", F.explode(with_bytes).alias("s")).select("row", "s.*")
    parts = cut(mixed.withColumns({"near": F.lit(0), "far": F.lit(LENGTH - ANCHOR)}), "repeat-parts")
    while True:
        large = cut(parts.groupBy("key").agg(F.count("*").alias("kinds")).where(F.col("kinds") > GROUP).select("key"), "repeat-large")
        split = not large.isEmpty()
        rest = parts.join(large, "key", "left_anti") if split else parts
        total = rest.agg(F.sum(F.octet_length("bytes") + 1)).first()[0]
        if total:
            marks.append(_indexed(rest, total))
        if not split:
            break
        halves = cut(_halves(parts.join(large, "key")), "repeat-halves")
        known = cut(_counted(halves), "repeat-contents")
        equal = known.where("n > 1").select("key", "content")
        marks.append(ranges(halves.join(equal, ["key", "content"]), F.col("start") + F.octet_length("bytes")))
        parts = known.where("kinds > 1").select("key", "n", "rep.*")
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out


def remove_repeats(texts: DataFrame) -> DataFrame:
    """(row, text binary, …), rows distinct and the same on every reading, with two more columns: kept, the bytes that are
    left, and spans, the maximal removed runs (start, end) in order."""
    ranges = repeated(texts.select("row", "text")).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    kind = "array<struct<start:long,end:long>>"

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                depth = np.zeros(len(text) + 1, dtype=np.int64)
                np.add.at(depth, [r["start"] for r in own], 1)
                np.add.at(depth, [r["end"] for r in own], -1)
                gone = np.cumsum(depth[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                spans.append([{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(text, dtype=np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})

    changed = texts.select("row", "text").join(ranges, "row").mapInArrow(strip, f"row long, kept binary, spans {kind}")
    rows = texts.join(cut(changed, "repeat-kept").withColumnRenamed("kept", "__kept"), "row", "left")
    return rows.withColumns({"kept": F.coalesce("__kept", "text"), "spans": F.coalesce("spans", F.array().cast(kind))}).drop("__kept")


def op11_run_length_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = cut(read(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "repeat-documents")
    size = F.octet_length
    return remove_repeats(docs).select("doc_id", size("text").cast("long").alias("n_bytes"), (size("text") - size("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
