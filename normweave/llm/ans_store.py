"""Token ids in files coded by a static range asymmetric numeral system.

One shared frequency table, counted over all ids, codes independent blocks of whole documents. In a block, token t
belongs to lane t mod LANES; all lanes step together in numpy and share one stream of 32-bit words. Every
CHECKPOINT_STEPS steps the lanes' states and the place in the stream are kept, with checksums of the stream and of the
ids up to the next checkpoint. A block of several checkpoints is one long document; its parts decode in tasks of their
own, and their checksums join to that of the document.

A store is a folder: `table` (id, freq), `blocks` (part, seq, documents, first token, lane states, stream, checksums), `offsets`
(part, first token): Spark tables, so any file system that Spark writes serves. Blocks ascend by (part, seq), and so do
document ids over them; null ids come first; rows of one id are ordered by their ids' hash.

Defined results: null and empty texts hold the end id only; very long texts make one long block with checkpoints;
repeated rows are all kept; an empty table makes an empty store; only the named columns are read. A block whose
checksum fails raises an error.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .batches import by_bytes, gather
from .common import cut, read, scratch_path, small_batches

SCALE_BITS = 18
LOW = np.uint64(1 << 31)
LANES = 1024
CHECKPOINT_STEPS = 128
BLOCK_TOKENS = LANES * CHECKPOINT_STEPS
#: Pieces that a worker remembers at most, and pieces in one call of the library.
MEMORY_PIECES, CALL_PIECES = 1_200_000, 2_000
WORD_AND_MARKS = r"(?s)^(?P<word>.*[\p{L}\p{Nd}])(?P<marks>[.,;:!?$&%*#\")\]}]+)$"
BATCH_BYTES = 4_000_000
#: A space between two white-space or control characters, or last after one: there, pieces of a text can't be coded alone.
_TIED_SPACE = r"[\pZ\pC] (?:[\pZ\pC]|\z)"
#: A piece that such a character begins or ends, or that holds a carriage return.
_LOOSE_ENDS = r"^[\pZ\pC]|[\pZ\pC]\z|\r|\A\z"
#: A piece of letters alone, of blocks that have had their letters for long; after a space it is one word of the pattern.
_LETTERS = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2AF}\x{400}-\x{481}\x{4E00}-\x{9FA5}]+\z"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
#: Such pieces in one string of a call.
LETTER_PIECES = 200


def _byte_names() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte; bytes without a visible one follow from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Pool:
    """Id lists by number, in arrays that grow by doubling."""

    def __init__(self, kind: np.dtype):
        self.at, self.ids, self.n = np.zeros(1 << 10, dtype=np.int64), np.zeros(1 << 12, dtype=kind), 0

    def add(self, sizes: np.ndarray, ids: np.ndarray) -> None:
        n, used = self.n + len(sizes), int(self.at[self.n])
        if n >= len(self.at):
            self.at = np.concatenate((self.at[: self.n + 1], np.zeros(2 * n, dtype=np.int64)))
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[:used], np.zeros(used + 2 * len(ids), dtype=self.ids.dtype)))
        np.cumsum(sizes, out=self.at[self.n + 1 : n + 1])
        self.at[self.n + 1 : n + 1] += used
        self.ids[used : used + len(ids)] = ids
        self.n = n

    def keep(self, n: int) -> None:
        """Forget the lists from number n on."""
        self.n = min(self.n, n)

    def lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gather(numbers, self.at[: self.n + 1], self.ids)


class PieceTokenizer:
    """A byte-level tokenizer of the `tokenizers` library, asked once for each distinct piece of text of a worker.

    Its pattern starts a new word at every single space, so pieces cut before spaces code alone as they do within
    the text. Arrow splits a batch and finds its distinct pieces; only these are looked up in Python, and numpy lays
    their ids out in the texts' order. The library codes many unknown pieces in one call, with a carriage return
    between; pieces of letters alone are given to the same merges as words already cut and written by bytes, where a token
    that begins with the space begins a piece. Texts with runs of white space around a space, or with special tokens, are
    coded whole. What comes first stays in the bounded memory, for frequent pieces come early.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.between = self.tokenizer.encode("\r", add_special_tokens=False).ids
        self.cores: dict[str, int] = {}  # of pieces after a space, which the key leaves out: numbers in the pool
        self.marks: dict[str, int] = {}
        self.pool = Pool(self.kind)
        form = json.loads(self.tokenizer.to_str())
        self.words, self.begins = None, np.zeros(0, dtype=bool)
        if form["normalizer"] is None and form["pre_tokenizer"] == _BYTE_LEVEL and form["model"]["type"] == "BPE":
            self.words = Tokenizer(self.tokenizer.model)  # of bytes' names, cut at white space
            self.words.pre_tokenizer = WhitespaceSplit()
            names = _byte_names()
            self.space = names[32]
            self.named = np.array([ord(names[b]) if b not in b" \n" else b for b in range(256)], dtype="<u4")
            self.begins = np.zeros(self.size, dtype=bool)
            self.begins[[k for t, k in self.tokenizer.get_vocab().items() if t.startswith(self.space)]] = True

    def whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids) of the texts."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return sizes, np.fromiter(chain.from_iterable(found), dtype=self.kind, count=int(sizes.sum()))

    def _letters(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(sizes, ids) of pieces of letters alone, each coded as after a space; None if the vocabulary lacks a byte."""
        raw = "\n".join(" ".join(pieces[low : low + LETTER_PIECES]) for low in range(0, len(pieces), LETTER_PIECES)).encode()
        named = self.named[np.frombuffer(raw, dtype=np.uint8)].tobytes().decode("utf-32-le")
        joined = [self.space + part.replace(" ", " " + self.space) for part in named.split("\n")]
        found = [e.ids for e in self.words.encode_batch_fast(joined, add_special_tokens=False)]
        ids = np.fromiter(chain.from_iterable(found), dtype=self.kind, count=sum(map(len, found)))
        starts = np.flatnonzero(self.begins[ids])
        return (np.diff(np.append(starts, len(ids))), ids) if len(starts) == len(pieces) else None

    def _after_space(self, pieces: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(pieces in another order, sizes, ids), each coded as after a space."""
        if self.words is not None:
            plain = pc.match_substring_regex(pieces, _LETTERS)
            names = pieces.filter(plain).to_pylist()
            coded = self._letters(names) if names else None
            if coded:
                more, sizes, ids = self._mixed(pieces.filter(pc.invert(plain)))
                return names + more, np.concatenate((coded[0], sizes)), np.concatenate((coded[1], ids))
        return self._mixed(pieces)

    def _mixed(self, pieces: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """_after_space of pieces that may hold anything."""
        # a piece that neither begins nor ends in white space can't reach into its neighbours
        calm = pc.invert(pc.match_substring_regex(pieces, _LOOSE_ENDS)) if len(self.between) == 1 else pa.array([False] * len(pieces), pa.bool_())
        names, rest = pieces.filter(calm).to_pylist(), pieces.filter(pc.invert(calm)).to_pylist()
        done, sizes, ids = [], [], []
        for low in range(0, len(names), CALL_PIECES):
            part = names[low : low + CALL_PIECES]
            found = self.tokenizer.encode_batch_fast([" " + "\r ".join(part)], add_special_tokens=False)[0].ids
            found = np.fromiter(found, dtype=self.kind, count=len(found))
            ends = np.flatnonzero(found == self.between[0])
            if len(ends) != len(part) - 1:
                rest += part
                continue
            done += part
            sizes.append(np.diff(np.concatenate(([-1], ends, [len(found)]))) - 1)
            ids.append(np.delete(found, ends))
        if rest:
            n, more = self.whole([" " + p for p in rest])
            sizes, ids = [*sizes, n], [*ids, more]
        empty = np.zeros(0, dtype=np.int64)
        return done + rest, np.concatenate([empty, *sizes]), np.concatenate([empty.astype(self.kind), *ids])

    def _alone(self, pieces: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        return pieces.to_pylist(), *self.whole(pieces.to_pylist())

    def _numbers(self, known: dict[str, int], keys: pa.Array, code) -> np.ndarray:
        """The pool's numbers of the keys; new keys are coded into the pool and noted in `known`."""
        distinct = keys.dictionary_encode()
        names = distinct.dictionary
        numbers = np.fromiter(map(known.get, names.to_pylist(), repeat(-1)), dtype=np.int64, count=len(names))
        gaps = np.flatnonzero(numbers < 0)
        if len(gaps):
            asked = names.take(pa.array(gaps))
            new, sizes, ids = code(asked)
            known.update(zip(new, range(self.pool.n, self.pool.n + len(new))))
            self.pool.add(sizes, ids)
            numbers[gaps] = np.fromiter(map(known.__getitem__, asked.to_pylist()), dtype=np.int64, count=len(gaps))
        return numbers[distinct.indices.to_numpy()]

    def _forget(self) -> None:
        """Drop what came into the pool beyond the bound."""
        if self.pool.n > MEMORY_PIECES:
            for known in (self.cores, self.marks):
                while known and next(reversed(known.values())) >= MEMORY_PIECES:  # the latest come last
                    known.popitem()
            self.pool.keep(MEMORY_PIECES)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each with the id `end` behind."""
        tied = pc.match_substring_regex(pa.array(texts, pa.large_string()), _TIED_SPACE).to_pylist()
        heads = [t if tie or any(s in t for s in self.specials) else t.partition(" ")[0] for t, tie in zip(texts, tied)]
        lists = pc.split_pattern(pa.array([t[len(h) :] for t, h in zip(texts, heads)], pa.string()), " ")  # each begins with ''
        found = lists.values.dictionary_encode()
        # a word always ends between a letter or digit and the marks after it, so these code apart
        pieces = found.dictionary
        parts = pc.extract_regex(pieces, WORD_AND_MARKS)
        words = self._numbers(self.cores, pc.coalesce(pc.struct_field(parts, "word"), pieces), self._after_space)
        marks = self._numbers(self.marks, pc.coalesce(pc.struct_field(parts, "marks"), ""), self._alone)
        at, ids = self.pool.lists(np.stack((words, marks), axis=1).reshape(-1))
        self._forget()
        at = at[::2]
        head_sizes, packed = self.whole(heads)
        more = np.append(np.cumsum(head_sizes), head_sizes.sum() + 1)
        starts = lists.offsets.to_numpy().astype(np.int64)
        numbers = found.indices.to_numpy().astype(np.int64)
        numbers[starts[:-1]] = len(at) - 1 + np.arange(len(texts))
        numbers = np.insert(numbers, starts[1:], len(at) - 1 + len(texts))
        flat_at, flat = gather(numbers, np.concatenate((at, at[-1] + more)), np.concatenate((ids, packed, np.array([end], dtype=self.kind))))
        return flat_at[starts + np.arange(len(starts))], flat


_OPEN: dict[str, PieceTokenizer] = {}


def _tokenizer(path: str) -> PieceTokenizer:
    if path not in _OPEN:
        _OPEN[path] = PieceTokenizer(path)
    return _OPEN[path]


def vocabulary(path: str) -> int:
    return _tokenizer(path).size


def encode(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary): little-endian packed ids, 2 bytes each for vocabularies up to 65,536, else 4, and end_id last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(path)
        for whole in batches:
            for batch in by_bytes(whole, "text", BATCH_BYTES):
                at, ids = coder.encode([t or "" for t in batch.column("text").to_pylist()], end_id)
                packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * coder.kind.itemsize), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([batch.column("key"), packed.cast(pa.binary())], names=["key", "ids"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def frequencies(ids: DataFrame, size: int) -> np.ndarray:
    """Counts of all ids, scaled; the driver gets `size` counts at most."""
    kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for part in by_bytes(batch, "ids", BATCH_BYTES):
                n += np.bincount(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=kind), minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"id": at.astype(np.int32), "n": n[at]}, schema=pa.schema([("id", pa.int32()), ("n", pa.int64())]))

    found = ids.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(size)
    n[found["id"].to_numpy()] = found["n"]
    return scaled(n)


def scaled(n: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE_BITS (more bits for larger vocabularies), at least 1 for ids that occur."""
    seen = n > 0
    if not seen.any():
        return np.zeros(len(n), dtype=np.int64)
    bits = max(SCALE_BITS, int(seen.sum()).bit_length() + 1)
    freq = np.where(seen, 1 + np.floor(n / n.sum() * ((1 << bits) - int(seen.sum()))), 0).astype(np.int64)
    freq[int(np.argmax(freq))] += (1 << bits) - int(freq.sum())
    return freq


class Ans:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(self.freq) - self.freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
        self.bits = max(1, len(self.symbol)).bit_length() - 1

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """(stream, lane states at each checkpoint, words before each checkpoint); the coder runs backwards."""
        lanes = min(LANES, max(1, len(ids)))
        steps = -(-len(ids) // lanes)
        grid = np.zeros(steps * lanes, dtype=np.int64)
        grid[: len(ids)] = ids
        freq, start = self.freq[grid].reshape(steps, lanes), self.start[grid].reshape(steps, lanes)
        limit = freq << np.uint64(63 - self.bits)
        state = np.full(lanes, LOW, dtype=np.uint64)
        words, out = np.zeros((steps, lanes), dtype="<u4"), np.zeros((steps, lanes), dtype=bool)
        states = np.zeros((-(-steps // CHECKPOINT_STEPS), lanes), dtype=np.uint64)
        for t in range(steps - 1, -1, -1):
            live = min(lanes, len(ids) - t * lanes)
            x, f = state[:live], freq[t, :live]
            full = x >= limit[t, :live]
            out[t, :live] = full
            words[t, :live] = x & np.uint64(0xFFFFFFFF)
            x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            state[:live] = (q << np.uint64(self.bits)) + (x - q * f) + start[t, :live]
            if t % CHECKPOINT_STEPS == 0:
                states[t // CHECKPOINT_STEPS] = state
        per_step = out.sum(axis=1)
        before = np.concatenate(([0], np.cumsum(per_step)))[:steps:CHECKPOINT_STEPS] if steps else np.zeros(0, dtype=np.int64)
        return words[out].tobytes(), states, before

    def decode(self, n: int, stream: bytes, states: bytes) -> np.ndarray:
        """The n ids from one checkpoint to the next, from its lane states and its part of the stream."""
        state = np.frombuffer(states, dtype="<u8").astype(np.uint64)
        words, lanes, at = np.frombuffer(stream, dtype="<u4"), len(state), 0
        out = np.empty((-(-n // lanes), lanes), dtype="<u4")
        mask = np.uint64((1 << self.bits) - 1)
        for t in range(len(out)):
            live = min(lanes, n - t * lanes)
            x = state[:live]
            slot = x & mask
            s = self.symbol[slot.astype(np.int64)]
            out[t, :live] = s
            x = self.freq[s] * (x >> np.uint64(self.bits)) + slot - self.start[s]
            low = np.flatnonzero(x < LOW)
            x[low] = x[low] << np.uint64(32) | words[at : at + len(low)]
            at += len(low)
            state[:live] = x
        return out.reshape(-1)[:n]


def joined_crc32(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of concatenated parts of (CRC-32, bytes): a part's CRC shifted by n bytes is its product with
    x**(8 n) modulo the polynomial, in the reflected bit order."""

    def times(a: int, b: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            if b >> k & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    total = 0
    for crc, n in parts:
        power, square = 1 << 31, 1 << 23  # 1 and x**8
        while n:
            if n & 1:
                power = times(power, square)
            square, n = times(square, square), n >> 1
        total = times(total, power) ^ crc
    return total


BLOCKS = "part int, seq int, first long, n long, keys array<{kind}>, lens array<int>, states binary, before array<int>, stream binary, stream_crc32 array<long>, ids_crc32 array<long>"


def write(ids: DataFrame, path: str, size: int, key: str = "doc_id") -> None:
    """Write (key, ids) of `encode` as a store in ascending key order. `size`: of the vocabulary."""
    spark = ids.sparkSession
    small_batches(spark)
    freq = frequencies(ids, size)
    spark.createDataFrame(pa.table({"id": np.arange(size, dtype=np.int32), "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)  # as large as the vocabulary
    unpacked = np.dtype("<u2" if size <= 1 << 16 else "<u4")
    key_kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = Ans(shared.value), TaskContext.get().partitionId(), 0
        keys, held, lens, total, first = [], [], [], 0, 0
        schema = None

        def block() -> pa.RecordBatch:
            all_ids = np.frombuffer(b"".join(held), dtype=unpacked).astype("<u4")
            stream, states, before = coder.encode(all_ids)
            ends = [4 * x for x in [*before[1:].tolist(), len(stream) // 4]]
            row = {"part": part, "seq": seq, "first": first, "n": total, "keys": keys, "lens": lens,
                "states": states.astype("<u8").tobytes(), "before": before.tolist(), "stream": stream}
            row["stream_crc32"] = [zlib.crc32(stream[4 * x : y]) for x, y in zip(before.tolist(), ends)]
            row["ids_crc32"] = [zlib.crc32(all_ids[x : x + BLOCK_TOKENS].tobytes()) for x in range(0, total, BLOCK_TOKENS)]
            return pa.RecordBatch.from_pylist([row], schema=schema)

        for batch in batches:
            key_type = batch.schema.field(key).type
            schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n", pa.int64()),
                    ("keys", pa.list_(key_type)), ("lens", pa.list_(pa.int32())), ("states", pa.binary()), ("before", pa.list_(pa.int32())),
                    ("stream", pa.binary()), ("stream_crc32", pa.list_(pa.int64())), ("ids_crc32", pa.list_(pa.int64()))])
            for k, raw in zip(batch.column(key).to_pylist(), batch.column("ids").to_pylist()):
                n = len(raw) // unpacked.itemsize
                if held and total + n > BLOCK_TOKENS:
                    yield block()
                    keys, held, lens, total, seq, first = [], [], [], 0, seq + 1, first + total
                keys.append(k)
                held.append(raw)
                lens.append(n)
                total += n
        if held:
            yield block()

    tie = "__tie"
    order = ids.select(key, "ids", F.xxhash64("ids").alias(tie)).repartitionByRange(F.asc_nulls_first(key),
        tie).sortWithinPartitions(F.asc_nulls_first(key), tie).drop(tie)
    order.mapInArrow(run, BLOCKS.format(kind=key_kind)).write.parquet(f"{path}/blocks")
    parts = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file only
    parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first")).write.parquet(f"{path}/offsets")


def read_store(spark: SparkSession, path: str, key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(key, start, n_tokens, ids_crc32 and, if with_ids, ids: binary of little-endian 32-bit ids) of all documents
    in a store; start counts the ids of all documents before."""
    small_batches(spark)
    # a row for each file of the store, so at most one for each task that wrote it
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/offsets").withColumnRenamed("first", "file_first")), "part")
    # the table is as large as the vocabulary
    freq = spark.sparkContext.broadcast(spark.read.parquet(f"{path}/table").orderBy("id").toPandas()["freq"].to_numpy())
    kind = blocks.schema["keys"].dataType.elementType.simpleString()

    def part_of(coder: Ans, row: dict, n: int, stream: bytes, states: bytes, c: int) -> memoryview:
        name = f"block {row['part']}/{row['seq']}, checkpoint {c}"
        if zlib.crc32(stream) != row["stream_crc32"][c].as_py():
            raise ValueError(f"checksum of {name}")
        ids = memoryview(coder.decode(n, stream, states)).cast("B")
        if zlib.crc32(ids) != row["ids_crc32"][c].as_py():
            raise ValueError(f"checksum of the ids of {name}")
        return ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Ans(freq.value)
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                ids = part_of(coder, row, row["n"].as_py(), row["stream"].as_py(), row["states"].as_py(), 0)
                lens = row["lens"].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lens)
                own = [ids[4 * a : 4 * b] for a, b in zip((ends - lens).tolist(), ends.tolist())]
                arrays = [row["keys"].values, pa.array(ends - lens + row["first"].as_py() + row["file_first"].as_py()), pa.array(lens),
                    pa.array(list(map(zlib.crc32, own)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*arrays, *([pa.array([bytes(x) for x in own], pa.binary())] if with_ids else [])], names=names)

    def run_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Ans(freq.value)
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                c = row["c"].as_py()
                ids = part_of(coder, row, row["part_n"].as_py(), row["stream"].as_py(), row["states"].as_py(), c)
                out = {"key": row["keys"].values[0].as_py(), "start": row["first"].as_py() + row["file_first"].as_py(),
                    "part": row["part"].as_py(), "seq": row["seq"].as_py(), "c": c, "n": len(ids) // 4, "crc": zlib.crc32(ids)}
                yield pa.RecordBatch.from_pylist([out | ({"ids": bytes(ids)} if with_ids else {})], schema=parts_schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(x, key=lambda p: p["c"]) for x in batch.column("parts").to_pylist()]
            crc = [joined_crc32([(p["crc"], 4 * p["n"]) for p in x]) for x in found]
            arrays = [batch.column("key"), batch.column("start"), pa.array([sum(p["n"] for p in x) for x in found], pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array([b"".join(p["ids"] for p in x) for x in found], pa.binary())]
                        if with_ids else [])], names=names)

    names = ["key", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]
    more = ", ids binary" * with_ids
    parts_schema = pa.schema([("key", to_arrow_type(blocks.schema["keys"].dataType.elementType)), ("start", pa.int64()),
            ("part", pa.int32()), ("seq", pa.int32()), ("c", pa.int32()), ("n", pa.int64()), ("crc", pa.int64()),
            *([("ids", pa.binary())] if with_ids else [])])
    schema = f"key {kind}, start long, n_tokens long, ids_crc32 long" + more
    short = blocks.where(F.size("before") <= 1).mapInArrow(run, schema)
    # a block with more checkpoints is one long document; its parts decode in tasks of their own
    c, total = F.col("c"), F.col("n")
    begin, end = F.get("before", c), F.coalesce(F.get("before", c + 1), (F.octet_length("stream") / 4).cast("int"))
    lane_bytes = (F.octet_length("states") / F.size("before")).cast("int")
    long = blocks.where(F.size("before") > 1).withColumn("c", F.explode(F.sequence(F.lit(0), F.size("before") - 1)))
    long = long.withColumns({"part_n": F.least(F.lit(BLOCK_TOKENS), total - c.cast("long") * BLOCK_TOKENS), "stream": F.substring("stream",
                4 * begin + 1, 4 * (end - begin)), "states": F.substring("states", lane_bytes * c + 1, lane_bytes)})
    parts = long.repartition("part", "seq", "c").mapInArrow(run_parts, f"key {kind}, start long, part int, seq int, c int, n long, crc long" + more)
    parts = parts.groupBy("part", "seq", "key", "start").agg(F.collect_list(F.struct("c", "n", "crc", *(["ids"] if with_ids else []))).alias("parts"))
    return short.unionByName(parts.select("key", "start", "parts").mapInArrow(run_joined, schema)).withColumnRenamed("key", key)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


END_ID = 2


def op3_ans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, store = default_path(), scratch_path(spark, "ans-store")
    ids = cut(encode(read(spark, sf_dir, "documents"), path, END_ID), "token-ids")
    write(ids, store, vocabulary(path))
    return read_store(spark, store, with_ids=False)
