"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

mu-law and A-law samples expand by 256-entry tables; ADPCM decodes step by step for all blocks of a batch at once;
PCM is resampled by linear interpolation in integers. Everything is per row, in Arrow batches cut by bytes.

Defined results: null text is empty and becomes one block of spaces; a very long text is one media value; a WAV that
is null, cut short or of another format decodes to null columns; repeated rows give equal values; an empty table
gives an empty table; only the named columns are read, and added columns replace columns of their names.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .batches import by_bytes
from .common import cut, read, small_batches

RATE, RATE_OUT = 8_000, 16_000
BLOCK = 192
HEADER, STEPS_MAX = 4, 88
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = tuple(sorted(TAGS))
BATCH_BYTES = 1_000_000
#: Of the stored tables: audio is kept, so its size weighs more than the time to write it.
ZSTD_LEVEL, PAGE_MB = 10, 8
#: Fixed values of the IMA ADPCM format: quantiser steps and index moves by the code's low three bits.
STEP = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157,
        173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707,
        1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635,
        13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 85
    exponent, mantissa = code >> 4 & 7, (code & 15) << 4
    size = np.where(exponent == 0, mantissa + 8, mantissa + 264 << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()
_i, _n = np.meshgrid(np.arange(STEPS_MAX + 1), np.arange(16), indexing="ij")
_size = (STEP[_i] >> 3) + (_n >> 2 & 1) * STEP[_i] + (_n >> 1 & 1) * (STEP[_i] >> 1) + (_n & 1) * (STEP[_i] >> 2)
#: By step index and code: what a code adds to the sample, and the next index.
ADD = np.where(_n & 8, -_size, _size).astype(np.int32).reshape(-1)
NEXT = np.clip(_i + MOVE[_n & 7], 0, STEPS_MAX).astype(np.int32).reshape(-1)


def adpcm_decode(blocks: np.ndarray) -> np.ndarray:
    """(n, block bytes) to (n, samples) of int16; all blocks take each step together."""
    codes = np.empty((2 * (blocks.shape[1] - HEADER), len(blocks)), dtype=np.int32)
    codes[0::2], codes[1::2] = (blocks[:, HEADER:] & 15).T, (blocks[:, HEADER:] >> 4).T
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), STEPS_MAX)
    out = np.empty((len(codes) + 1, len(blocks)), dtype=np.int16)
    out[0] = sample
    for k, code in enumerate(codes, 1):
        at = index * 16 + code
        sample = np.clip(sample + ADD[at], -32768, 32767)
        index = NEXT[at]
        out[k] = sample
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int, rate_out: int) -> np.ndarray:
    """Linear interpolation at rate_out; the last sample holds."""
    if rate == rate_out or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * rate_out // rate, dtype=np.int64) * rate
    left, part = at // rate_out, (at % rate_out)
    x = pcm.astype(np.int64)
    right = x[np.minimum(left + 1, len(x) - 1)]
    return ((x[left] * (rate_out - part) + right * part) // rate_out).astype(np.int16)


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """resample for rate_out = 2 * rate, over rows of (n, samples)."""
    out = np.empty((len(pcm), 2 * pcm.shape[1]), dtype=np.int16)
    out[:, 0::2] = pcm
    out[:, 1:-1:2] = (pcm[:, :-1].astype(np.int32) + pcm[:, 1:]) >> 1
    out[:, -1] = pcm[:, -1]
    return out


def to_planes(pcm: np.ndarray) -> bytes:
    """The same PCM in an order that compresses: a byte for the mode, the even samples, then the odd ones less the mean
    of their neighbours (wrapping at 16 bits), for samples made by interpolation leave zeros. Mode 0 keeps the even
    samples as 16 bits; mode 1, for up to 256 different values, as companding makes them, keeps the number of values
    less one, the values, and a byte for each sample."""
    even = pcm[0::2]
    odd = (pcm[1::2] - _between(even)[: len(pcm) // 2]).astype("<i2").tobytes()
    values = np.unique(even)
    if not 0 < len(values) <= 256:
        return b"\0" + even.astype("<i2").tobytes() + odd
    return bytes((1, len(values) - 1)) + values.astype("<i2").tobytes() + np.searchsorted(values, even).astype(np.uint8).tobytes() + odd


def from_planes(stored: bytes) -> np.ndarray:
    if stored[0]:
        first = 4 + 2 * stored[1]
        n = (len(stored) - first + 2) // 3  # of even samples; the odd ones are as many or one less
        even = np.frombuffer(stored, dtype="<i2", offset=2, count=stored[1] + 1)[np.frombuffer(stored, dtype=np.uint8, offset=first, count=n)]
        odd = np.frombuffer(stored, dtype="<i2", offset=first + n)
    else:
        both = np.frombuffer(stored, dtype="<i2", offset=1)
        even, odd = np.split(both, [(len(both) + 1) // 2])
    out = np.empty(len(even) + len(odd), dtype=np.int16)
    out[0::2] = even
    out[1::2] = odd + _between(even)[: len(odd)]
    return out


def _between(even: np.ndarray) -> np.ndarray:
    return ((even.astype(np.int32) + np.append(even[1:], even[-1:])) >> 1).astype(np.int16)


def wav(payload: bytes, codec: str) -> bytes:
    """A WAV container around encoded samples; ADPCM in blocks of BLOCK bytes."""
    adpcm = codec == "adpcm"
    samples = len(payload) // BLOCK * (2 * (BLOCK - HEADER) + 1) if adpcm else len(payload)
    form = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * BLOCK // (2 * (BLOCK - HEADER) + 1) if adpcm else RATE, BLOCK if adpcm else 1, 4 if adpcm else 8)
    form += struct.pack("<HH", 2, 2 * (BLOCK - HEADER) + 1) if adpcm else struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse(media: bytes | None) -> tuple[str, int, int, bytes] | None:
    """(codec, rate, block bytes, payload) of a WAV; None if it isn't one of these formats or is cut short."""
    if not media or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            return None
        if name == b"fmt " and size >= 16:
            form = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data" and form:
            codec = {t: c for c, t in TAGS.items()}.get(form[0])
            if codec is None or codec == "adpcm" and (form[4] <= HEADER or size % form[4]):
                return None
            return codec, form[2], form[4], media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return None


def payload_of(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (max(1, -(-len(raw) // BLOCK)) * BLOCK - len(raw))


def codec_of(payload: bytes) -> str:
    return CODECS[zlib.crc32(payload) % len(CODECS)]


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes long and media binary: the text's bytes as samples of a WAV, whose codec
    follows from the bytes."""
    small_batches(docs.sparkSession)
    docs = docs.drop("n_bytes", "media")
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, text, BATCH_BYTES):
                made = [payload_of(t) for t in batch.column(text).to_pylist()]
                others = [f.name for f in kept]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in others], pa.array([n for n, _ in made], pa.int64()),
                            pa.array([wav(p, codec_of(p)) for _, p in made], pa.binary())],
                    names=[*others, "n_bytes", "media"],
                )

    return docs.mapInArrow(run, schema)


def decode_batch(media: list[bytes | None]) -> list[tuple[str, int, bytes, np.ndarray] | None]:
    """(codec, source rate, payload, PCM at RATE_OUT) of each value. ADPCM blocks of one size decode together."""
    parsed = [parse(m) for m in media]
    pcm: list[np.ndarray | None] = [None] * len(media)
    sizes = {p[2] for p in parsed if p and p[0] == "adpcm"}
    for size in sizes:
        own = [i for i, p in enumerate(parsed) if p and p[0] == "adpcm" and p[2] == size]
        rows = adpcm_decode(np.frombuffer(b"".join(parsed[i][3] for i in own), dtype=np.uint8).reshape(-1, size))
        bounds = np.cumsum([0, *[len(parsed[i][3]) // size for i in own]])
        for k, i in enumerate(own):
            pcm[i] = rows[bounds[k] : bounds[k + 1]].reshape(-1)
    out: list = []
    for p, samples in zip(parsed, pcm):
        if p is None:
            out.append(None)
            continue
        codec, rate, _, payload = p
        if samples is None:
            samples = (MULAW if codec == "mulaw" else ALAW)[np.frombuffer(payload, dtype=np.uint8)]
        out.append((codec, rate, payload, double_rate(samples[None, :])[0] if RATE_OUT == 2 * rate and len(samples) else resample(samples, rate, RATE_OUT)))
    return out


def describe(codec: str, pcm: np.ndarray) -> str:
    """codec;samples;peak;rms, rounded down;zero crossings;crc32 of the PCM bytes, of the resampled PCM."""
    if not len(pcm):
        return f"{codec};0;0;0;0;0"
    wide = pcm.astype(np.int64)
    sign = pcm < 0
    rms = math.isqrt(int(np.dot(wide, wide)) // len(pcm))
    return f"{codec};{len(pcm)};{int(np.abs(wide).max())};{rms};{int(np.count_nonzero(sign[1:] != sign[:-1]))};{zlib.crc32(pcm.astype('<i2').tobytes())}"


def decode(rows: DataFrame, media: str = "media", pcm: bool = True, feature: bool = True, planes: bool = False) -> DataFrame:
    """rows without the media, with codec, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, if wanted, and, if pcm, pcm: binary of little-endian 16-bit samples at RATE_OUT, as to_planes orders them if
    planes."""
    small_batches(rows.sparkSession)
    added = {"codec": pa.string(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
        "media_bytes": pa.int64(), "media_sha256": pa.string(), **({"feature": pa.string()} if feature else {})}
    rows = rows.drop(*added, "pcm")
    kept = [f for f in rows.schema.fields if f.name != media]
    kinds = {pa.string(): T.StringType(), pa.int64(): T.LongType()}
    schema = T.StructType([*kept, *[T.StructField(n, kinds[k]) for n, k in added.items()], *([T.StructField("pcm", T.BinaryType())] if pcm else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, media, BATCH_BYTES):
                stored = batch.column(media).to_pylist()
                found = decode_batch(stored)
                columns: dict[str, list] = {n: [] for n in [*added, *(["pcm"] if pcm else [])]}
                for m, x in zip(stored, found):
                    if x is None:
                        for c in columns.values():
                            c.append(None)
                        continue
                    codec, _, payload, samples = x
                    values = (codec, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m),
                        hashlib.sha256(m).hexdigest(), *([describe(codec, samples)] if feature else []),
                        *([to_planes(samples) if planes else samples.astype("<i2").tobytes()] if pcm else []))
                    for c, v in zip(columns.values(), values):
                        c.append(v)
                others = [f.name for f in kept]
                arrays = [pa.array(columns[n], k) for n, k in added.items()] + ([pa.array(columns["pcm"], pa.binary())] if pcm else [])
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], *arrays], names=[*others, *columns])

    return rows.mapInArrow(run, schema)


def features(rows: DataFrame, planes: bool = False) -> DataFrame:
    """rows (codec, pcm, ...) of decode without the pcm, with the feature of the stored samples; planes: as in decode."""
    small_batches(rows.sparkSession)
    kept = [f for f in rows.drop("feature").schema.fields if f.name != "pcm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codecs, stored = batch.column("codec").to_pylist(), batch.column("pcm")
            samples = (x.as_py() for x in stored)
            found = [None if x is None else describe(c, from_planes(x) if planes else np.frombuffer(x, dtype="<i2")) for c, x in zip(codecs, samples)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(found, pa.string())], names=[*[f.name for f in kept], "feature"])

    return rows.drop("feature").mapInArrow(run, T.StructType([*kept, T.StructField("feature", T.StringType())]))


def op9_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.substring("media", 21, 2)  # of the WAV's format: samples of one codec compress best side by side
    stored = cut(store(read(spark, sf_dir, "documents").select("doc_id", "text")).sortWithinPartitions(tag), "telephony", ZSTD_LEVEL, PAGE_MB)
    resampled = cut(decode(stored, feature=False, planes=True), "telephony-pcm", ZSTD_LEVEL, PAGE_MB)
    return features(resampled, planes=True).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", F.col("tail_crc32"),
        "media_bytes", "media_sha256", "feature")
