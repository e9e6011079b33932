"""BPE encoding and decoding through a minimal acyclic transducer.

The frequent words of the corpus are encoded once by exact merging and compiled into a minimal acyclic automaton
over UTF-8 bytes: equal suffixes share states, every state knows how many words end below it, and so each accepted
word has a number that points at its ids. The file goes to executors with SparkContext.addFile and is memory-mapped
there, so all workers of a machine share its pages. Words that it doesn't accept are merged exactly, all of a
batch in lockstep. The lexicon only decides speed; ids never depend on it.

Serves tokenizer files of the `tokenizers` library with NFC, white-space folding and lower-casing, a word pattern,
byte-level symbols and an end-of-word suffix; the file's path is a parameter and must exist on every machine.

Defined results: null text is empty and gives no ids; empty ids decode to ''; very long texts and words are whole
(words over LOCKSTEP_SYMBOLS symbols merge by a heap); repeated rows stay; an empty table gives an empty table;
only the named column is read and only `ids`/`decoded` are added, replacing columns of these names.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import os
import re
import shutil
import tempfile
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .batches import by_bytes, gather
from .common import read, small_batches

#: Words in the transducer; what the driver holds is bounded by it.
LEXICON_WORDS = 50_000
#: Entries of one task's word counter before lossy counting prunes it, and words that a task reports at most.
COUNTER_ENTRIES = 300_000
REPORTED_WORDS = 60_000
LOCKSTEP_SYMBOLS = 64
BATCH_BYTES = 3_000_000
NO_RANK = np.int32(2**31 - 1)
_CHUNK_SPLIT = re.compile("[\t-\r \x85\xa0  -     　]+")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary, merges and exact merging of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\n")
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int32)
        self.last = np.array([vocab[s + suffix] for s in symbols], dtype=np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def words(self, chunks: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all chunks (no chunk holds white space), and how many each chunk has."""
        text = unicodedata.normalize("NFC", "\n".join(chunks)).replace("Σ", "σ").lower()
        found = self.pattern.findall(text)
        ends = np.flatnonzero(np.fromiter((w == "\n" for w in found), dtype=bool, count=len(found)))
        bounds = np.concatenate(([-1], ends, [len(found)]))
        return [w for w in found if w != "\n"], np.diff(bounds) - 1 if chunks else np.zeros(0, dtype=np.int64)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words by exact merging, as (offsets, ids)."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out: list[np.ndarray | None] = [None] * len(raw)
        short = np.flatnonzero(lens <= LOCKSTEP_SYMBOLS)
        for i in np.flatnonzero(lens > LOCKSTEP_SYMBOLS):
            out[i] = self._merge_long(raw[i])
        if len(short):
            starts, ids = self._lockstep([raw[i] for i in short], lens[short])
            for k, i in enumerate(short):
                out[i] = ids[starts[k] : starts[k + 1]]
        sizes = np.fromiter((len(x) for x in out), dtype=np.int64, count=len(out))
        return np.concatenate(([0], np.cumsum(sizes))), np.concatenate(out) if out else np.zeros(0, dtype=np.int32)

    def _symbols(self, raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        ids = self.inner[raw]
        ids[ends] = self.last[raw[ends]]
        return ids

    def _lockstep(self, raw: list[bytes], lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each round merges the leftmost best pair of every word that still has one."""
        total = len(raw)
        wid = np.repeat(np.arange(total), lens)
        sym = self._symbols(np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum(lens) - 1)
        rank = np.full(len(sym), NO_RANK, dtype=np.int32)
        inside = np.flatnonzero(wid[1:] == wid[:-1])
        rank[inside] = self.rank(sym[inside], sym[inside + 1])
        done_wid, done_sym = [], []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], wid[1:] != wid[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            best_here = np.repeat(best, sizes)
            over = best_here == NO_RANK
            if over.any():
                done_wid.append(wid[over])
                done_sym.append(sym[over])
                keep = ~over
                wid, sym, rank, best_here = wid[keep], sym[keep], rank[keep], best_here[keep]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == best_here)
            hits = hits[np.concatenate(([True], wid[hits[1:]] != wid[hits[:-1]]))]
            sym[hits] = self.merged[rank[hits]]
            keep = np.ones(len(sym), dtype=bool)
            keep[hits + 1] = False
            at = hits - np.arange(len(hits))  # the places after removal
            wid, sym, rank = wid[keep], sym[keep], rank[keep]
            after = (at + 1 < len(sym)) & (wid[np.minimum(at + 1, len(sym) - 1)] == wid[at])
            rank[at] = NO_RANK
            rank[at[after]] = self.rank(sym[at[after]], sym[at[after] + 1])
            before = at[(at > 0) & (wid[np.maximum(at - 1, 0)] == wid[at])]
            rank[before - 1] = self.rank(sym[before - 1], sym[before])
        wid, sym = np.concatenate(done_wid), np.concatenate(done_sym)
        order = np.argsort(wid, kind="stable")
        return np.concatenate(([0], np.cumsum(np.bincount(wid, minlength=total)))), sym[order]

    def _merge_long(self, raw: bytes) -> np.ndarray:
        sym = self._symbols(np.frombuffer(raw, dtype=np.uint8), np.array([len(raw) - 1])).tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.rank(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(int(r), i, sym[i], sym[i + 1]) for i, r in enumerate(first) if r != NO_RANK]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.rank(np.array([sym[i]]), np.array([sym[j]]))[0])
            if r != NO_RANK:
                heapq.heappush(heap, (r, i, sym[i], sym[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else -1
            if j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([s for s in sym if s >= 0], dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


class Transducer:
    """Minimal acyclic automaton with numbered words and their ids, over one memory-mapped file of int32."""

    MAGIC = 0x4D415431

    @staticmethod
    def compile(words: list[str], offsets: np.ndarray, ids: np.ndarray, path: str) -> None:
        """words: sorted by their UTF-8 bytes and distinct. Sorted input lets each finished suffix be shared at once."""
        register: dict[tuple, int] = {}
        edges: list[tuple[tuple[int, int], ...]] = []
        final: list[bool] = []

        def freeze(is_final: bool, out: list[tuple[int, int]]) -> int:
            key = (is_final, tuple(out))
            if key not in register:
                register[key] = len(edges)
                edges.append(key[1])
                final.append(is_final)
            return register[key]

        path_nodes: list[list] = [[False, []]]  # of the word before: [final, finished edges]
        labels: list[int] = []

        def shorten(to: int) -> None:
            while len(labels) > to:
                is_final, out = path_nodes.pop()
                path_nodes[-1][1].append((labels.pop(), freeze(is_final, out)))

        for word in words:
            raw = word.encode()
            same = 0
            while same < min(len(raw), len(labels)) and raw[same] == labels[same]:
                same += 1
            shorten(same)
            for b in raw[same:]:
                labels.append(b)
                path_nodes.append([False, []])
            path_nodes[-1][0] = True
        shorten(0)
        root = freeze(*path_nodes[0])
        below = [0] * len(edges)  # targets come before their sources
        for s, out in enumerate(edges):
            below[s] = final[s] + sum(below[t] for _, t in out)
        key, target, skip = [], [], []
        for s, out in enumerate(edges):
            before = int(final[s])
            for b, t in out:
                key.append(s << 8 | b)
                target.append(t)
                skip.append(before)
                before += below[t]
        parts = [np.array(x, dtype=np.int32) for x in (key, target, skip, final, offsets, ids)]
        head = np.array([Transducer.MAGIC, root, *map(len, parts)], dtype=np.int32)
        with open(path, "wb") as file:
            for part in (head, *parts):
                file.write(part.tobytes())

    def __init__(self, path: str):
        whole = np.memmap(path, dtype=np.int32, mode="r")
        assert whole[0] == self.MAGIC, "not a transducer file"
        self.root = int(whole[1])
        bounds = np.cumsum([8, *whole[2:8].tolist()])
        self.key, self.target, self.skip, self.final, self.offsets, self.ids = (whole[a:b] for a, b in zip(bounds, bounds[1:]))

    def numbers(self, words: list[str]) -> np.ndarray:
        """Each word's number, -1 where it isn't accepted; all words walk together, byte by byte."""
        raw = [w.encode() for w in words]
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        starts = np.cumsum(lens) - lens
        number, state = np.zeros(len(raw), dtype=np.int64), np.full(len(raw), self.root, dtype=np.int64)
        live, step = np.arange(len(raw)), 0
        out = np.full(len(raw), -1, dtype=np.int64)
        while len(live) and len(self.key):
            ended = live[lens[live] == step]
            accepted = ended[self.final[state[ended]] == 1]
            out[accepted] = number[accepted]
            live = live[lens[live] > step]
            key = state[live] << 8 | data[starts[live] + step]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            known = self.key[at] == key
            live, at = live[known], at[known]
            number[live] += self.skip[at]
            state[live] = self.target[at]
            step += 1
        return out


_OPEN: dict[tuple[str, str], object] = {}


def _model(path: str) -> WordBpe:
    key = ("model", path)
    if key not in _OPEN:
        _OPEN[key] = WordBpe(path)
    return _OPEN[key]


def _transducer(name: str) -> Transducer:
    key = ("transducer", name)
    if key not in _OPEN:
        _OPEN[key] = Transducer(SparkFiles.get(name))
    return _OPEN[key]


def chunks_of(text: str) -> list[str]:
    if _ODD_SPACE.search(text):
        return [c for c in _CHUNK_SPLIT.split(text) if c]
    return text.split()


def encode_texts(model: WordBpe, lexicon: Transducer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts as (offsets, ids)."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    codes, lens = [], []
    for text in texts:
        text = text or ""
        parts = [text] if model.special_split is None or "<" not in text else model.special_split.split(text)
        found: list = []
        for k, part in enumerate(parts):
            found += [(model.specials[part],)] if k % 2 else chunks_of(part)
        codes.append(np.fromiter(map(index.__getitem__, found), dtype=np.int64, count=len(found)))
        lens.append(len(found))
    plain = ["" if isinstance(c, tuple) else c for c in index]
    words, per_chunk = model.words(plain)
    numbers: defaultdict = defaultdict()
    numbers.default_factory = numbers.__len__
    word_codes = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    distinct = list(numbers)
    known = lexicon.numbers(distinct)
    seen, unseen = np.flatnonzero(known >= 0), np.flatnonzero(known < 0)
    # the batch's distinct words only: the mapped file is read where they lie, and never copied whole
    seen_at, seen_ids = gather(known[seen], lexicon.offsets, lexicon.ids)
    more, more_ids = model.merge([distinct[i] for i in unseen])
    place = np.empty(len(distinct), dtype=np.int64)
    place[np.concatenate((seen, unseen))] = np.arange(len(distinct))
    word_at, word_ids = gather(place[word_codes], np.concatenate((seen_at, seen_at[-1] + more[1:])), np.concatenate((seen_ids, more_ids)))
    chunk_at = word_at[np.concatenate(([0], np.cumsum(per_chunk)))]
    special = {k: c[0] for k, c in enumerate(index) if isinstance(c, tuple)}
    if special:
        sizes = np.diff(chunk_at)
        sizes[list(special)] = 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.empty(at[-1], dtype=np.int32)
        where = np.zeros(at[-1], dtype=bool)
        where[at[list(special)]] = True
        ids[where] = [special[k] for k in sorted(special)]
        ids[~where] = word_ids
        chunk_at, word_ids = at, ids
    flat_at, ids = gather(np.concatenate(codes) if codes else np.zeros(0, dtype=np.int64), chunk_at, word_ids)
    return flat_at[np.concatenate(([0], np.cumsum(lens))).astype(np.int64)], ids


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): counts over all texts. Each task counts lossily in bounded memory: a word whose share of the task
    is below 1 / COUNTER_ENTRIES may be missing or low, a more frequent one never is missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, chunks, floor = _model(path), Counter(), 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                chunks.update(chunks_of(x or ""))
                if len(chunks) > COUNTER_ENTRIES:
                    floor += 1
                    while len(chunks) > COUNTER_ENTRIES // 2:
                        chunks = Counter({c: n for c, n in chunks.items() if n > floor})
                        floor += len(chunks) > COUNTER_ENTRIES // 2
        words: Counter = Counter()
        kept = [c for c, n in chunks.most_common(REPORTED_WORDS)]
        found, per_chunk = model.words(kept)
        for w, n in zip(found, np.repeat([chunks[c] for c in kept], per_chunk).tolist() if kept else []):
            words[w] += n
        yield pa.RecordBatch.from_pydict({"word": list(words), "n": list(words.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

    small_batches(docs.sparkSession)
    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = LEXICON_WORDS) -> str:
    """Compile the `words` most frequent words of docs; returns the name under which SparkFiles has the transducer."""
    spark = docs.sparkSession
    top = [r["word"] for r in word_counts(docs, path, text).orderBy(F.desc("n"), "word").limit(words).collect()]
    top = sorted(top, key=str.encode)
    offsets, ids = _model(path).merge(top)
    folder = os.path.realpath(tempfile.mkdtemp(prefix="normweave-lexicon-"))
    atexit.register(shutil.rmtree, folder, True)  # executors fetch the file from the driver until it ends
    local = f"{folder}/new"
    Transducer.compile(top, offsets, ids, local)
    with open(local, "rb") as file:
        name = f"lexicon-{hashlib.sha256(file.read()).hexdigest()[:24]}.mat"
    os.rename(local, f"{folder}/{name}")
    if not any(f.endswith("/" + name) for f in spark.sparkContext.listFiles):
        spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode(docs: DataFrame, path: str, lexicon: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with `out`: array<int> of the text's ids; with `decoded`, also the text that these ids decode to, in the
    same pass."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*[c for c in (out, decoded) if c and c != text])
    added = [T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, automaton = _model(path), _transducer(lexicon)
        for whole in batches:
            for batch in by_bytes(whole, text, BATCH_BYTES):
                offsets, ids = encode_texts(model, automaton, batch.column(text).to_pylist())
                new = [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))]
                if decoded:
                    new.append(pa.array([model.decode(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *[f.name for f in added]])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out`: the text of the ids, tokens joined by one space as a tokenizer without decoder does."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(path)
        for batch in batches:
            texts = [model.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())]))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, build_lexicon(docs, path), decoded="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
