"""Removal of repeats against a count of all windows, and the index against plain comparison."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from normweave.llm import registry, repeat_index


def by_hand(texts, length=400):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8))).reshape(-1, 2)
        out.append((len(t), int(gone.sum()), [tuple(e) for e in edge.tolist()], np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()))
    return out


def removed(spark, texts, parts=3):
    df = spark.createDataFrame([(i, bytearray(t), "x", i % 3) for i, t in enumerate(texts)], "row long, text binary, start string, key int").repartition(parts)
    rows = repeat_index.remove_repeats(df).collect()
    assert all((r["start"], r["key"]) == ("x", r["row"] % 3) for r in rows)
    return [(len(r["text"]), len(r["text"]) - len(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in sorted(rows, key=lambda r: r["row"])]


def noise(rng, n):
    return bytes(rng.choices(b"abcdefgh \n", k=n))


def mixed_texts(seed):
    rng = random.Random(seed)
    passages = [noise(rng, n) for n in (399, 400, 401, 650, 3000)]
    base = noise(rng, 2500)
    out = [b"", b"a" * 399, b"a" * 400, b"a" * 401, b"ab" * 900, base, base, noise(rng, 700) * 4]
    for _ in range(25):  # passages among other text, more than once and at the edges too
        out.append(b"".join(rng.choice([rng.choice(passages), noise(rng, rng.randrange(300))]) for _ in range(rng.randrange(1, 5))))
    for _ in range(12):  # near copies
        copy = bytearray(base)
        for _ in range(rng.randrange(1, 6)):
            copy[rng.randrange(len(copy))] = 42
        out.append(bytes(copy[rng.randrange(30) :]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    texts = mixed_texts(seed)
    assert removed(spark, texts) == by_hand(texts)


def test_groups_are_split(spark, monkeypatch):
    """With groups of three segments at most, halves down to single windows give the same."""
    monkeypatch.setattr(repeat_index, "GROUP", 3)
    monkeypatch.setattr(repeat_index, "BUCKET_BYTES", 5000)
    rng = random.Random(3)
    shared = noise(rng, 500)
    texts = [noise(rng, rng.randrange(300)) + shared + noise(rng, rng.randrange(300)) for _ in range(20)] + mixed_texts(4)[:20]
    assert removed(spark, texts) == by_hand(texts)


def test_long_texts_in_pieces():
    rng = random.Random(5)
    text = noise(rng, 3000)
    pieces = list(repeat_index._pieces([b"", text, b"x" * 10], 1000))
    windows = [(k, i) for group in pieces for k, a, b in group for i in range(a, b - 400 + 1)]
    assert sorted(windows) == [(1, i) for i in range(2601)] and all(sum(b - a for _, a, b in g) < 1000 or len(g) == 1 for g in pieces)


def test_registered_query(spark, sf):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = sorted((i, n, gone, len(spans), hashlib.sha256(kept).hexdigest()) for (i, _), (n, gone, spans, kept) in zip(docs, by_hand([t for _, t in docs]), strict=True))
    got = registry.queries()["op11_run_length_repeats"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == want and any(w[2] for w in want)


def test_empty_table_and_null_texts(spark, tmp_path):
    for name, rows in (("none", []), ("nulls", [(1, None), (None, ""), (2, "y" * 500), (2, "y" * 500)])):
        spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("mine")).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = sorted(map(tuple, registry.queries()["op11_run_length_repeats"](spark, f"{tmp_path}/{name}").collect()), key=repr)
        empty = hashlib.sha256(b"").hexdigest()
        assert got == ([] if name == "none" else sorted([(1, 0, 0, 0, empty), (None, 0, 0, 0, empty), (2, 500, 500, 1, empty), (2, 500, 500, 1, empty)], key=repr))


def test_index_against_plain_comparison():
    rng = random.Random(6)
    for _ in range(20):
        strings = [bytes(rng.choices(b"ab", k=rng.randrange(0, 40))) for _ in range(rng.randrange(1, 8))]
        index = repeat_index.RunIndex(strings)
        assert index.lengths.sum() == len(index.text) and (index.symbols[1:] != index.symbols[:-1]).all()
        every = [(k, i) for k, s in enumerate(strings) for i in range(len(s))]

        def common(x, y):
            (a, i), (b, j) = x, y
            n = 0
            while i + n < len(strings[a]) and j + n < len(strings[b]) and strings[a][i + n] == strings[b][j + n]:
                n += 1
            return n

        got = index.matches()
        for k, i in every:
            assert got[index.first[k] + i] == max((common((k, i), y) for y in every if y != (k, i)), default=0)
