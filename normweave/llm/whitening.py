"""Embedding whitening by a tiled covariance.

Vectors become whole numbers x = floor(256 * c); every distinct x counts once (the fit list). Dimensions are cut into
blocks of TILE; a pair of blocks is a tile. Batches of the fit list are row blocks: each sends its centred column blocks
to the tiles that need them, keyed by row block and tile, where the two blocks are multiplied; the products are summed
a tile. The covariance, d x d for d dimensions, is assembled and eigendecomposed on the driver, and one more pass
projects all rows.

Sums, the means' numerators and the deviation are exact in whole numbers; a deviation beyond 64 bits is an error.
Defined results: rows whose vector is null, empty or holds a null or non-finite entry go, and so do those whose length
is not the commonest of the fit list (ties: the longer one); repeated vectors count once in the fit and have equal
results; repeated or null ids are rows of their own; an eigenvalue of zero, within rounding, gives a null `whitened` and
no part in identity_error; an empty table, or one without usable rows, gives an empty table; only the named columns are
read. There are min(components, d) rows a vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, read

SCALE = 256
#: Dimensions of a tile's side.
TILE = 32
COMPONENTS = 4
#: Eigenvalues below this part of the greatest count as zero.
FLAT = 1e-12
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whole(vector: Column) -> Column:
    """The vector in whole numbers, or null if it has none or holds an entry that is null or not finite."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.when((F.size(vector) > 0) & ~bad, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum, least and greatest entry of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, low, high = [0] * d, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), d)
            # halves of 32 bits, so that a batch's sums cannot overflow
            total = [t + (int(h) << 32) + int(l) for t, h, l in zip(total, (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), strict=True)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"k": pa.array(range(d), pa.int32()), "s": pa.array(map(str, total)), "low": low, "high": high})

    rows = fit.mapInArrow(run, "k int, s string, low long, high long").groupBy("k").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).collect()  # d rows
    rows.sort(key=lambda r: r["k"])
    return tuple(np.array([int(r[c]) for r in rows], dtype=object) for c in ("s", "low", "high"))


def _tile_sums(fit: DataFrame, mean: np.ndarray) -> DataFrame:
    """(a, b, place, v): the entries of the tiles, sums of products of centred columns over the fit list."""
    d = len(mean)
    sides = [(k, min(d, k + TILE)) for k in range(0, d, TILE)]

    def column_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            x = _matrix(batch.column("x"), d) - mean
            blocks = [np.ascontiguousarray(x[:, a:b]).tobytes() for a, b in sides]
            keys = [(a, b, side) for a in range(len(sides)) for b in range(a, len(sides)) for side in {a, b}]
            yield pa.RecordBatch.from_pydict({
                "row_block": pa.array([(task << 32) + number] * len(keys), pa.int64()), "a": pa.array([k[0] for k in keys], pa.int32()),
                "b": pa.array([k[1] for k in keys], pa.int32()), "side": pa.array([k[2] for k in keys], pa.int32()),
                "block": pa.array([blocks[k[2]] for k in keys], pa.binary())})

    def multiply(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, a, b = key
        block = {s: np.frombuffer(v).reshape(-1, sides[s][1] - sides[s][0]) for s, v in zip(rows["side"], rows["block"], strict=True)}
        product = block[a].T @ block[b]
        return pd.DataFrame({"a": a, "b": b, "place": np.arange(product.size, dtype=np.int32), "v": product.ravel()})

    blocks = fit.mapInArrow(column_blocks, "row_block long, a int, b int, side int, block binary")
    products = blocks.groupBy("row_block", "a", "b").applyInPandas(multiply, "a int, b int, place int, v double")
    return products.groupBy("a", "b", "place").agg(F.sum("v").alias("v"))


def _covariance(fit: DataFrame, mean: np.ndarray, n: int) -> np.ndarray:
    d, width = len(mean), lambda k: min(TILE, len(mean) - k * TILE)
    out = np.zeros((d, d))
    for r in _tile_sums(fit, mean).toLocalIterator():  # d x d entries at most
        i, j = r["a"] * TILE + r["place"] // width(r["b"]), r["b"] * TILE + r["place"] % width(r["b"])
        out[i, j] = out[j, i] = r["v"] / n
    return out


def _components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues, unit eigenvectors as columns and shares of the trace, by falling eigenvalue; of either sign the one
    whose entry farthest from zero is positive."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    trace = np.trace(covariance)
    return values, vectors, values / trace if trace else np.zeros_like(values)


def _project(rows: DataFrame, column: str, d: int, fill) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fill(batch, _matrix(batch.column("x"), d))

    return rows.mapInArrow(run, column)


def whiten(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """rows to (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = rows.sparkSession
    base = cut(rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole(F.col(vector)).alias("x")).where("x IS NOT NULL"), "whitening-rows")
    every = cut(base.select("x").distinct(), "whitening-fit")
    length = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], OUT)
    d, n = length["d"], length["n"]
    base, fit = base.where(F.size("x") == d), every.where(F.size("x") == d)
    sums, low, high = _sums(fit, d)
    mean = np.array([float(s / n) if abs(s) < 1 << 52 else s / n for s in map(int, sums)])
    values, vectors, share = _components(_covariance(fit, mean, n), components)
    solid = values > FLAT * max(values[0], 0)
    axes = np.where(solid, vectors / np.sqrt(np.where(solid, values, 1)), 0)
    k = len(values)
    # exact in 64 bits if the farthest possible row is
    small = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in zip(low, high, sums, strict=True)) < 1 << 63

    def moments(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        w = (x - mean) @ axes
        return pa.RecordBatch.from_pydict({"place": pa.array(range(k * k + k), pa.int32()), "v": np.concatenate([(w.T @ w).ravel(), w.sum(0)])})

    got = dict(_project(fit, "place int, v double", d, moments).groupBy("place").agg(F.sum("v")).collect())  # k * k + k rows
    first = np.array([got[k * k + i] for i in range(k)]) / n
    error = np.abs(np.array([got[i] for i in range(k * k)]).reshape(k, k) / n - np.outer(first, first) - np.eye(k))[np.ix_(solid, solid)]
    identity_error = float(error.max()) if error.size else 0.0

    def result(batch: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        rows = len(x)
        far = n * x.astype(np.int64 if small else object) - sums.astype(np.int64 if small else object)
        w = (x - mean) @ axes
        return pa.RecordBatch.from_pydict({
            "vec_id": batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows), "n": pa.array([n] * (rows * k), pa.int64()),
            "deviation": pa.array(np.repeat((far * far).sum(1), k).tolist(), pa.int64()),
            "whitened": pa.array(w.ravel(), mask=np.tile(~solid, rows)), "explained": np.tile(share, rows),
            "identity_error": pa.array([identity_error] * (rows * k)),
        })

    return _project(base, OUT, d, result)


def op13_tiled_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
