"""Whitening against numpy over the whole table, and its edge cases."""

import math

import numpy as np
import pytest

from normweave.llm import registry, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def by_hand(rows, k=4):
    """{vec_id: [(deviation, |whitened|, explained)]}; ids distinct."""
    kept = {i: [math.floor(256 * float(c)) for c in v] for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    fit = sorted(set(map(tuple, kept.values())))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    f = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(f.T @ f / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in kept.items():
        dev = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        w = (np.array(x) - np.array(sums) / n) @ vectors[:, :k] / np.sqrt(values[:k])
        out[i] = [(dev, abs(w[c]), values[c] / values.sum()) for c in range(min(k, len(values)))]
    return n, out


def test_whole_table(spark, sf):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, want = by_hand(table)
    got = registry.queries()["op13_tiled_whitening"](spark, sf).collect()
    assert len(got) == 4 * len(want)
    for r in got:
        dev, w, share = want[r["vec_id"]][r["component"] - 1]
        assert r["n"] == n and r["deviation"] == dev
        assert abs(r["whitened"]) == pytest.approx(w, rel=1e-6, abs=1e-7)
        assert r["explained"] == pytest.approx(share, rel=1e-9)
        assert r["identity_error"] < 1e-9
    signs = {}
    for r in got:  # one sign a component: products of two rows agree with the recomputed ones
        signs.setdefault(r["component"], []).append(r["whitened"])
    assert all(abs(sum(v)) < len(v) for v in signs.values())


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    v = [list(map(float, rng.normal(size=3))) for _ in range(40)]
    rows = [(i, x) for i, x in enumerate(v)] + [(100, v[0]), (101, None), (102, []), (103, [1.0, None, 2.0]), (104, [1.0, math.nan, 2.0]),
        (105, [1.0, math.inf, 2.0]), (106, [1.0, 2.0]), (None, v[1])]
    df = spark.createDataFrame([(i, x, "c", 7) for i, x in rows], SCHEMA)
    got = whitening.whiten(df).collect()
    ids = [r["vec_id"] for r in got]
    assert sorted(i for i in ids if i is not None) == sorted([*range(40), 100] * 3) and ids.count(None) == 3
    _, want = by_hand([(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)])
    for r in got:
        dev, w, share = want[{100: 0, None: 1}.get(r["vec_id"], r["vec_id"])][r["component"] - 1]
        assert (r["n"], r["deviation"]) == (40, dev) and abs(r["whitened"]) == pytest.approx(w, rel=1e-6, abs=1e-7)


def test_flat_and_empty(spark):
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0])], "vec_id long, embedding array<float>")).collect()
    assert len(one) == 4 and all(r["whitened"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    for rows in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_tiles_and_large_numbers(spark, monkeypatch):
    """Tiles that don't divide the dimensions, and whole numbers whose squares pass 64 bits on the way."""
    monkeypatch.setattr(whitening, "TILE", 4)
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=11) * [10.0 ** (k % 4) for k in range(11)]]) for i in range(60)]
    n, want = by_hand(rows)
    for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)).collect():
        dev, w, share = want[r["vec_id"]][r["component"] - 1]
        assert r["deviation"] == dev and abs(r["whitened"]) == pytest.approx(w, rel=1e-5, abs=1e-6)
    far = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception):  # noqa: B017  a deviation of 2 * (2 * 256e12) ** 2 has no 64 bits
        whitening.whiten(far).collect()
