"""Collocations against a plain count, and the tries' round trip. The registered query runs against DuckDB beside the others."""

import collections
import random
import re

import numpy as np
import pytest

from normweave.llm import collocations

SCHEMA = "text string, lang string, path string, n int, h string"


def plain_mine(docs, least, top):
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                counts.update((lang, *w[i : i + n]) for i in range(len(w) - n + 1))
    often = {k: a for k, a in counts.items() if len(k) > 2 and a >= least}
    around = collections.Counter()
    for (lang, *w), a in often.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                key = (lang, *w[i : i + n])
                around[key] = max(around[key], a)
    rows = collections.defaultdict(list)
    for key, a in often.items():
        lang, *w = key
        score, k = min((2_000_000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k) for k in range(1, len(w)))
        if 100 * around[key] < 80 * a:
            phrase = " ".join(w)
            rows[lang].append((-score, -a, phrase.encode(), phrase, counts[lang, *w[:k]], counts[lang, *w[k:]]))
    return {(lang, i, p, -a, l, r, total[lang], -s) for lang, found in rows.items() for i, (s, a, _, p, l, r) in enumerate(sorted(found)[:top], 1)}


def mined(spark, docs, **more):
    df = spark.createDataFrame([(t, g, "p", 1, "x") for t, g in docs], SCHEMA)
    return {tuple(r) for r in collocations.mine(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def texts(seed, n):
    rng = random.Random(seed)
    words = "the The a of été É straße x y #1 \U0001f600 long-word THE".split(" ")
    ends = [".", ",", "\n", "\x0b", "\r\n", "! ", "\t", "  ", ";;", " ? "]
    return [("".join(rng.choice(words) + (rng.choice(ends) if rng.random() < 0.2 else " ") for _ in range(rng.randrange(0, 60))),
        rng.choice(["en", "de", None, "und", ""])) for _ in range(n)]


@pytest.mark.parametrize(("seed", "shard", "top"), [(1, 10**9, 2000), (2, 300, 2000), (3, 2000, 7)])
def test_against_plain_counts(spark, monkeypatch, seed, shard, top):
    monkeypatch.setattr(collocations, "SHARD_BYTES", shard)
    monkeypatch.setattr(collocations, "SLICE_BYTES", shard // 2)
    monkeypatch.setattr(collocations, "RANGE_BYTES", 4000)
    docs = [*texts(seed, 150), (None, None), ("", "en"), (" . ", "fr"), ("of the " * 3000, "en")]
    assert mined(spark, docs, least=4, top=top) == plain_mine(docs, 4, top)


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With 2 ** 15 bits for many hashes the filter lets nearly all pass; the results stay."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 15)
    docs = texts(9, 80)
    assert mined(spark, docs, least=3) == plain_mine(docs, 3, 2000)


def test_clashing_hashes_are_found(spark, monkeypatch):
    real, seeds = collocations._words, []

    def clashing(docs, seed):
        seeds.append(seed)
        rows = real(docs, seed)
        return rows.unionByName(rows.limit(1).selectExpr("h", "lang", "'other' AS word", "n")) if seed == 1 else rows

    monkeypatch.setattr(collocations, "_words", clashing)
    docs = texts(4, 60)
    assert mined(spark, docs, least=3) == plain_mine(docs, 3, 2000) and seeds == [1, 2]


def test_empty(spark):
    assert mined(spark, []) == set() and mined(spark, [("", "en"), (None, None)]) == set()


def test_trie_round_trip():
    rng = np.random.default_rng(3)
    for depth in (2, 3, 4):
        paths, counts = collocations.counted(rng.integers(0, 5, (300, depth)).astype(np.uint64), rng.integers(1, 9, 300))
        back = collocations.deserialise(collocations.serialise(paths, counts))
        assert (back[0] == paths).all() and (back[1] == counts).all()
