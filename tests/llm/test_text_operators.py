"""Tokens, files, audio, rules, scores and languages against libraries, round trips and held-out rows."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from normweave.llm import ans_store, bpe_lexicon, language_id, quality_ranking, quality_rules, registry, telephony_audio

QUERIES = registry.queries()
HARD = [
    "", " ", "\n\n", "a  b   c", "don't we'll 'S", "x\n y \n", "Σίσυφος ΟΔΟΣ İı ﬁ", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c",
        "٣½ 一二三", "\x1c\x85 \xa0z", "😀👍🏽", "A" * 500, "ab" * 3000, "..!?;", "tab\tsep", "é ́x", "trailing  ", "\r\n x\r y",
]


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "q", [1]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids array<int>")


def texts_of(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_bpe_query(spark, sf):
    lib, texts = Tokenizer.from_file(bpe_lexicon.default_path()), texts_of(spark, sf)
    for r in QUERIES["op1_lexicon_bpe"](spark, sf).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 20, 50_000])
def test_bpe_edges(spark, words):
    """Ids don't depend on the lexicon."""
    path = bpe_lexicon.default_path()
    lib, rng = Tokenizer.from_file(path), random.Random(words)
    mixed = ["".join(rng.choice("ab éΣ'\n\t.1<|>") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    df = docs_of(spark, [*HARD, None, *mixed, *HARD])
    name = bpe_lexicon.build_lexicon(df, path, words=words)
    out = bpe_lexicon.encode(df, path, name, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    again = {r["doc_id"]: r["decoded"] for r in bpe_lexicon.decode(out, path).collect()}
    for r in out.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids, repr(r["text"])
        assert r["decoded"] == again[r["doc_id"]] == lib.decode(ids, skip_special_tokens=False)
    assert bpe_lexicon.encode(df.limit(0), path, name).count() == 0


def test_transducer_is_minimal(tmp_path):
    words = sorted({p + s for p in ("walk", "talk", "jump") for s in ("", "s", "ed", "ing")} | {"é", ""}, key=str.encode)
    offsets = np.arange(len(words) + 1)
    bpe_lexicon.Transducer.compile(words, offsets, np.arange(len(words), dtype=np.int32), str(tmp_path / "t"))
    t = bpe_lexicon.Transducer(str(tmp_path / "t"))
    assert t.numbers([*words, "wal", "walke", "x", "walkingx"]).tolist() == [*range(len(words)), -1, -1, -1, -1]
    assert len(t.final) < 20  # the endings are shared


def test_ans_query(spark, sf):
    lib, texts, at = Tokenizer.from_file(ans_store.default_path()), texts_of(spark, sf), 0
    found = {r["doc_id"]: r for r in QUERIES["op3_ans_token_files"](spark, sf).collect()}
    for k in sorted(texts):
        ids = [*lib.encode(texts[k], add_special_tokens=False).ids, ans_store.END_ID]
        assert (found[k]["start"], found[k]["n_tokens"], found[k]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)


def test_ans_edges(spark, tmp_path, monkeypatch):
    path = ans_store.default_path()
    lib, rng = Tokenizer.from_file(path), random.Random(9)
    mixed = ["".join(rng.choice("ab é'\n\t.1  ") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts = [*HARD, None, *mixed, "long words " * 20_000, "x1 y22 " * 120_000]
    df = docs_of(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") == 3, None).otherwise(F.col("doc_id")))
    df = df.unionByName(df.limit(4))
    ids = ans_store.encode(df, path, 7)
    store = str(tmp_path / "s")
    ans_store.write(ids, store, ans_store.vocabulary(path))
    out = sorted(ans_store.read_store(spark, store).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in out] == sorted([r["doc_id"] for r in df.collect()], key=lambda k: (k is not None, k or 0))
    assert out[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(out, out[1:]))
    for r in out:
        want = [*lib.encode(texts[3 if r["doc_id"] is None else r["doc_id"]] or "", add_special_tokens=False).ids, 7]
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want
    none = str(tmp_path / "e")
    ans_store.write(ids.limit(0), none, ans_store.vocabulary(path))
    assert ans_store.read_store(spark, none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 1023, 1024, 1025, 131_072, 300_001])
def test_ans_blocks(n):
    ids = np.random.default_rng(n).zipf(1.3, size=n).clip(max=60_000)
    coder = ans_store.Ans(ans_store.scaled(np.bincount(ids, minlength=70_000).astype(float)))
    stream, states, before = coder.encode(ids)
    assert len(before) == -(-n // ans_store.BLOCK_TOKENS)
    ends, parts = [*before[1:].tolist(), len(stream) // 4], []
    for c in reversed(range(len(before))):  # each part decodes alone
        own = ids[c * ans_store.BLOCK_TOKENS : (c + 1) * ans_store.BLOCK_TOKENS]
        assert (coder.decode(len(own), stream[4 * int(before[c]) : 4 * ends[c]], states[c].tobytes()) == own).all()
        parts.append((zlib.crc32(own.astype("<u4").tobytes()), 4 * len(own)))
    assert ans_store.joined_crc32(parts[::-1]) == zlib.crc32(ids.astype("<u4").tobytes())


def plain_pcm(codec, payload):
    """The samples of a payload at twice the rate, one by one."""
    if codec == "adpcm":
        samples = [x for at in range(0, len(payload), 192) for x in plain_adpcm(payload[at : at + 192])]
    elif codec == "mulaw":
        samples = []
        for b in payload:
            b ^= 255
            size = (((b & 15) * 2 + 33) << (b >> 4 & 7)) * 4 - 132
            samples.append(-size if b & 128 else size)
    else:
        samples = []
        for b in payload:
            b ^= 85
            size = (b & 15) * 16 + 8 if not b & 112 else (b & 15) * 16 + 264 << (b >> 4 & 7) - 1
            samples.append(size if b & 128 else -size)
    out = []
    for k, x in enumerate(samples):
        out += [x, (x + samples[min(k + 1, len(samples) - 1)]) // 2]
    return out


def test_audio_query(spark, sf):
    """Every field, by plain loops."""
    texts, rows = texts_of(spark, sf), QUERIES["op9_telephony_audio"](spark, sf).collect()
    assert len(rows) == len(texts)
    for k, r in enumerate(sorted(rows, key=lambda r: r["doc_id"])):
        raw = texts[r["doc_id"]].encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded),
            hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        codec = ("adpcm", "alaw", "mulaw")[zlib.crc32(padded) % 3]
        media = telephony_audio.wav(padded, codec)
        assert media.endswith(padded) and (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        if k < 40:
            pcm = plain_pcm(codec, padded)
            squares = sum(x * x for x in pcm) // len(pcm)
            crossings = sum((a < 0) != (b < 0) for a, b in zip(pcm, pcm[1:]))
            want = (codec, len(pcm), max(map(abs, pcm)), int(squares**0.5), crossings, zlib.crc32(struct.pack(f"<{len(pcm)}h", *pcm)))
            assert r["feature"] == ";".join(map(str, want))


def plain_adpcm(block):
    sample, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony_audio.STEP[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + int(telephony_audio.MOVE[code & 7])))
            out.append(sample)
    return out


def test_audio_codecs():
    mu, a = telephony_audio.MULAW, telephony_audio.ALAW
    assert (mu[0], mu[127], mu[128], mu[255]) == (-32124, 0, 32124, 0) and (a[0], a[0x55], a[0xD5], a[0xAA]) == (-5504, -8, 8, 32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256 and (mu[:128].astype(int) == -mu[128:].astype(int)).all()
    blocks = np.random.default_rng(0).integers(0, 256, size=(9, 40), dtype=np.uint8)
    assert telephony_audio.adpcm_decode(blocks).tolist() == [plain_adpcm(b.tobytes()) for b in blocks]
    x = np.random.default_rng(1).integers(-32768, 32768, size=50).astype(np.int16)
    assert (telephony_audio.double_rate(x[None, :])[0] == telephony_audio.resample(x, 8000, 16000)).all()
    assert len(telephony_audio.resample(x, 8000, 12000)) == 75


def test_planes_keep_every_sample():
    for n in (0, 1, 2, 3, 255, 1024, 1025):
        for top in (2, 32767):
            x = np.random.default_rng(n).integers(-top - 1, top + 1, size=n).astype(np.int16)
            assert (telephony_audio.from_planes(telephony_audio.to_planes(x)) == x).all()


def test_audio_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "é" * 500), (3, "é" * 500), (4, "x" * 100_000)],
        "doc_id long, text string").withColumns({"media": F.lit(1), "codec": F.lit(2)})
    out = telephony_audio.decode(telephony_audio.store(df)).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == 5 and by[1]["payload_sha256"] == by[2]["payload_sha256"] == hashlib.sha256(b" " * 192).hexdigest() and by[4]["payload_bytes"] == 100_032
    for r in out:
        assert r["feature"].split(";")[1] == str(len(r["pcm"]) // 2) and zlib.crc32(r["pcm"]) == int(r["feature"].split(";")[5])
    bad = spark.createDataFrame([(1, None), (2, bytearray(b"RIFF")), (3, bytearray(telephony_audio.wav(b"x" * 192, "alaw")[:-1]))], "doc_id long, media binary")
    assert [r["feature"] for r in telephony_audio.decode(bad).collect()] == [None] * 3
    assert telephony_audio.store(df.limit(0)).count() == 0
    for codec in telephony_audio.CODECS:
        assert telephony_audio.parse(telephony_audio.wav(b"y" * 384, codec))[3] == b"y" * 384


def test_rules_edges(spark):
    good = "This is a fine line, with some words in it.\nAnother one follows here; it ends well.\nAnd a third line closes the text."
    rows = {
        1: (None, False), 2: ("", False), 3: (" \n\t", False), 4: (good, True),
            5: ("Home | News | Sport | Contact\n" * 3 + "ok words here", False), 6: ("too short.", False),
            7: (good.upper().replace(" ", "!! "), False), 8: (("same five words again now " * 20), False),
        9: (good + "\nAll rights reserved. © 2020", True), 10: ("word$$$ and&&& more%%% of*** " * 5, False),
            11: (" ".join(f"w{i}." for i in range(30_000)), True),
    }
    df = spark.createDataFrame([(k, t, "clash") for k, (t, _) in rows.items()], "doc_id long, text string, n_words string")
    out = {r["doc_id"]: r["quality"] for r in quality_rules.line_first_clean(df).collect()}
    assert {k: out[k]["kept"] for k in rows} == {k: v for k, (_, v) in rows.items()}
    assert out[9]["clean_text"] == good and out[1]["n_words"] == 0 and out[8]["n_repeat_words"] == 100 and out[11]["n_words"] == 30_000 and out[5]["n_dup_lines"] == 2
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df.limit(0)).count() == 0


def test_ranking(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = QUERIES["op6_pairwise_quality"](spark, sf)
    assert out.count() == 1000 and out.where("score < 0 OR score > 1 OR predicted <> cast(score >= 0.7 AS int)").count() == 0
    held = out.where("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and np.mean([r["predicted"] == r["quality"] for r in held]) >= 0.97


def test_ranking_edges(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a " * 50_000, 1), (3, "a " * 50_000, 1),
            (4, "\ud83d\ude00 \u6f22\u5b57\u3002", 1)], "doc_id long, text string, f int")
    f = quality_ranking.features(df)
    assert f.count() == 5 and f.columns == ["doc_id", "f"] and quality_ranking.features(df.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (None, 1), (4, None), (99, 0)], "doc_id long, quality int")
    model = quality_ranking.fit(labels, df)  # no pair: the only bad label has no document
    assert {round(r["score"], 6) for r in quality_ranking.score(df, model).collect()} == {0.7}
    assert quality_ranking.score(df.limit(0), model).count() == 0
    wrong = quality_ranking.fit(labels.where("doc_id < 3").unionByName(spark.createDataFrame([(3, 0), (3, 1)], "doc_id long, quality int")), df.unionByName(df))
    assert all(0 <= r["score"] <= 1 for r in quality_ranking.score(df, wrong).collect())


def test_measure():
    plain = dict(zip(quality_ranking.FEATURES, quality_ranking.measure(["Ab1 \u0436\u6f22\u5b57\u3002\n!$", ""])[0]))
    share = lambda n: pytest.approx(n / 12, abs=1e-6)  # noqa: E731  eleven characters and the space behind
    assert [plain[c] for c in ("lower", "upper", "letter", "digit", "sentence", "shout", "line", "code")] == [share(n) for n in (2, 1, 2, 1, 1, 1, 1, 1)]
    words = sum(plain[f"word_{k}"] ** 2 for k in range(quality_ranking.WORD_BUCKETS))
    grams = sum(plain[f"gram_{k}"] ** 2 for k in range(quality_ranking.GRAM_BUCKETS))
    assert words == pytest.approx(1, abs=1e-5) and grams == pytest.approx(1, abs=1e-5)


def test_ranking_is_the_optimum_of_the_pair_loss():
    """Brute force: no small step lowers the plain regularised loss over all pairs."""
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    good = x[:, 3] + 0.5 * rng.normal(size=60) < 0.3
    m = quality_ranking.BradleyTerry(x, good)
    spread = x.std(axis=0)

    def loss(w):
        total = m.ridge * sum(v * v for v in w) / 2
        for i, j in zip(*m.pairs):
            total += np.log1p(np.exp(-sum(w[k] * (x[i, k] - x[j, k]) / spread[k] for k in range(4))))
        return total

    best = m.weights * spread
    assert np.argmax(np.abs(best)) == 3 and best[3] < 0
    for k in range(4):
        for step in (-0.01, 0.01):
            moved = best.copy()
            moved[k] += step
            assert loss(moved) > loss(best)
    s = x @ m.weights
    assert (s >= m.threshold).sum() == good.sum() and m.score(np.array(x[np.argmax(s)])) > quality_ranking.CUT_SCORE


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op10_ecoc_language"](spark, sf)
    held = out.where("held_out").join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert out.count() == 1000 and np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.98


def test_language_codes_decode_as_by_hand(spark):
    """Bits, losses and the nearest codeword by plain loops over the trigrams."""
    texts = {"en": ["the cat and the dog went over the hill", "and the other one"],
        "fr": ["le chat et le chien sont dans la maison", "la rue et le pont"],
        "de": ["der hund und die katze gehen nach hause", "und das andere"]}
    rows = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)], "doc_id long, text string, lang string")
    model, names = language_id.fit(rows), sorted(texts)
    assert model.languages == names

    def grams(text):
        raw = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in f"  {text} ".lower().encode()) + b"  "
        return [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 18 for i in range(len(raw) - 2)]

    counts = {x: {} for x in names}
    for x, ts in texts.items():
        got = [g for t in ts for g in grams(t)[: len(f"  {t} ")]]
        for g in got:
            counts[x][g] = counts[x].get(g, 0) + 1
    share = lambda x, g: (counts[x].get(g, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * 2**14)
    for text in ("the dog and the house", "le chat dans la rue", "der hund nach hause", "und the la"):
        own, bits = grams(text)[: len(f"  {text} ")], model.code.shape[1]
        losses = {}
        for n, x in enumerate(names):
            losses[x] = 0
            for b in range(bits):
                one, zero = ([y for m, y in enumerate(names) if model.code[m, b] * side > 0] for side in (1, -1))
                mean = lambda ys, g: sum(share(y, g) for y in ys) / len(ys)
                z = sum(np.log(mean(one, g)) - np.log(mean(zero, g)) for g in own) * min(1, language_id.EVIDENCE / len(own))
                losses[x] += np.log1p(np.exp(-z * model.code[n, b]))
        want = min(names, key=losses.get)
        score = np.exp(-losses[want]) / sum(np.exp(-v) for v in losses.values())
        lang, scores, doubt = model.predict([text])
        assert lang == [want] and scores[0] == pytest.approx(score, rel=1e-3) and doubt[0] == (score < language_id.AMBIGUOUS_BELOW)


def test_language_edges(spark):
    for n in (2, 3, 5, 7, 8, 30):
        code = language_id.codewords(n)
        assert len({tuple(c) for c in code}) == n and (np.abs(code.sum(axis=0)) < n).all()
    train = spark.createDataFrame([(i, "the cat and the dog went over the hill", "en") for i in range(20)]
        + [(i, "le chat et le chien sont dans la maison", "fr") for i in range(20, 40)] + [(50, None, "en"), (51, "x", None)],
        "doc_id long, text string, lang string")
    model = language_id.fit(train)
    rows = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "123 !?", 9), (4, "the dog and the cat", 9),
            (5, "le chien et la maison " * 5000, 9), (6, "the dog le chat the hill la maison", 9)], "doc_id long, text string, score int")
    out = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    assert [out[k]["lang_pred"] for k in range(1, 6)] == ["und", "und", "und", "en", "fr"] and all(0 <= r["score"] <= 1
        for r in out.values()) and out[1]["score"] == 0
    none = language_id.fit(train.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(rows, none).collect()} == {"und"}
    one = language_id.fit(train.where("lang = 'en'"))
    assert language_id.predict(rows, one).where("doc_id = 4").first()["lang_pred"] == "en"
    kept = language_id.keep_identified(train.withColumn("score", F.lit("mine")))
    assert kept.columns == [*train.columns, "score"] and {r["score"] for r in kept.collect()} == {"mine"} and kept.where("doc_id = 50").count() == 0
    assert language_id.predict(rows.limit(0), model).count() == 0


def test_telephony_stores_the_resampled_pcm(spark, sf, monkeypatch):
    tables = {}

    def cut(df, name, level, page, plain=telephony_audio.cut):
        tables[name] = plain(df, name, level, page)
        return tables[name]

    monkeypatch.setattr(telephony_audio, "cut", cut)
    out = {r["doc_id"]: r["feature"] for r in QUERIES["op9_telephony_audio"](spark, sf).collect()}
    pcm = {r["doc_id"]: (r["codec"], telephony_audio.from_planes(r["pcm"])) for t in tables.values() if "pcm" in t.columns for r in t.collect()}
    assert len(out) == len(pcm) and all(f == telephony_audio.describe(*pcm[k]) for k, f in out.items())
    bad = telephony_audio.decode(spark.createDataFrame([(1, None)], "doc_id long, media binary"), feature=False)
    assert [r["feature"] for r in telephony_audio.features(bad).collect()] == [None]


def test_pieces_of_letters_go_to_the_merges_already_cut(monkeypatch):
    """Pieces of letters alone skip the pattern and the byte mapping of the library; all others still go through it, and ids are the same."""
    coder = ans_store.PieceTokenizer(ans_store.default_path())
    asked, real = [], coder._mixed
    monkeypatch.setattr(coder, "_mixed", lambda pieces: (asked.extend(pieces.to_pylist()), real(pieces))[1])
    words = ["Stra\u00dfe", "ci\u00f3nier", "\u6f22\u5b57\u6f22", "\u0416\u0438\u0437\u043d\u044c", "plain", "\u01c0\u02af", *(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(450))]
    others = ["a1", "x\ny", "e\u0301t", "don't", "\u0e01\u0e33", "\U0001f600", "a\u00b7b", "\u00d7", "\u00d7a", "\u00aa"]
    texts = ["head " + " ".join(words + others), "one " + " ".join(others[::-1] + words[::-1]), "", "\u00e9t\u00e9 \u00e9t\u00e9"]
    at, ids = coder.encode(texts, 2)
    for k, text in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == [*coder.tokenizer.encode(text, add_special_tokens=False).ids, 2]
    assert asked and not set(asked) & set(words)
