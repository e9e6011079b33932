"""Sets of five-word shingles as sorted 64-bit hashes, and their MinHash labels."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import xxhash

WORDS = 5
SEED = 5
_SPACES = "\t\n\x0b\x0c\r"
_MULTIPLY = np.random.default_rng(SEED).integers(1, 2**63, size=WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str) -> list[str]:
    """Runs of other than the six ASCII white-space characters."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in _SPACES:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    index: defaultdict = defaultdict()
    index.default_factory = index.__len__
    codes, lens = [], []
    for t in texts:
        w = words_of(t or "")
        codes.append(np.fromiter(map(index.__getitem__, w), dtype=np.int32, count=len(w)))
        lens.append(len(w))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, index), dtype=np.uint64, count=len(index))
    h = hashes[np.concatenate(codes)] if codes else hashes
    rolled = np.zeros(max(0, len(h) - WORDS + 1), dtype=np.uint64)
    for k in range(WORDS):
        rolled += h[k : k + len(rolled)] * _MULTIPLY[k]
        rolled ^= rolled >> np.uint64(29)
    out, at = [], 0
    for n in lens:
        if n >= WORDS:
            out.append(np.unique(rolled[at : at + n - WORDS + 1]))
        elif n:
            out.append(np.array([xxhash.xxh64_intdigest(h[at : at + n].tobytes(), seed=n)], dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def minhash(sets: list[np.ndarray], functions: int) -> np.ndarray:
    """(sets, functions) of int16: the low bits of each function's least value over each non-empty set."""
    rng = np.random.default_rng(SEED + 1)
    a = rng.integers(0, 2**31, size=functions, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = rng.integers(0, 2**32, size=functions, dtype=np.uint32)
    x = np.concatenate(sets)
    x = ((x >> np.uint64(32)) ^ (x & np.uint64(0xFFFFFFFF))).astype(np.uint32)
    lens = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    starts = np.cumsum(lens) - lens
    out = np.empty((len(sets), functions), dtype=np.uint16)
    v = np.empty_like(x)
    for k in range(functions):
        np.multiply(x, a[k], out=v)
        np.add(v, b[k], out=v)
        least = np.minimum.reduceat(v, starts)
        out[:, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return out.view(np.int16)


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """(left, right): the number of elements that each two of the sets share. left and right index sets."""
    n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    common = np.zeros((len(left), len(right)))
    _, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[inverse]
    row, column = np.repeat(np.arange(len(sets)), n)[keep], (np.cumsum(shared) - 1)[inverse[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(column, (low, low + columns))
        grid = np.zeros((len(sets), columns), dtype=np.float32)
        grid[row[a:b], column[a:b] - low] = 1
        common += grid[left] @ grid[right].T
    return common
