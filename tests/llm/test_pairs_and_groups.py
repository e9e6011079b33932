"""The Jaccard join, the mix, the shards and the chats against brute force, with their edge cases."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from normweave.llm import chat_events, jaccard_join, registry, shard_balance, source_mixing
from tests.oracle import connect, same

WORD = r"[^\x20\x09-\x0D]+"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    same(QUERIES[name](spark, sf), connect(sf), SQL[name])


def shingles(text):
    w = re.findall(WORD, text or "")
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [("", text or "")])


def brute(docs):
    """Row results of the join by comparing all pairs; docs: (id, text), ids distinct."""
    rep = {}
    for k, t in sorted(docs):
        rep.setdefault(shingles(t), k)
    names = {k: s for s, k in rep.items()}
    links, parent = collections.Counter(), {k: k for k in names}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(names), 2):
        x, y = names[a], names[b]
        if all(w[0] for w in itertools.chain(x, y)) and 5 * len(x & y) >= 4 * len(x | y):
            links[a] += 1
            links[b] += 1
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    copies = collections.Counter(rep[shingles(t)] for _, t in docs)
    return {k: (root(rep[shingles(t)]), links[rep[shingles(t)]], rep[shingles(t)], copies[rep[shingles(t)]]) for k, t in docs}


def found(df):
    return {r["doc_id"]: (r["class_id"], r["n_links"], r["copy_id"], r["n_copies"]) for r in df.collect()}


def test_join_on_the_table(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert found(QUERIES["op2_lsh_forest_join"](spark, sf)) == brute(docs)


def test_join_of_near_copies_in_blocks(spark, monkeypatch):
    """A large group of near copies, cut into many blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 7)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(w[: rng.choice((100, 120, 120))])))
    docs += [(100 + k, docs[k][1]) for k in range(10)] + [(200, None), (201, ""), (202, " \n"), (203, "one two"), (204, "one  two"), (205, "lone " * 3000)]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in docs], "doc_id long, text string, n int, sfp string")
    assert found(jaccard_join.join(df)) == brute(docs)
    kept = {r["doc_id"] for r in jaccard_join.keep_one(df.unionByName(df)).collect()}
    classes = collections.defaultdict(list)
    for k, v in brute(docs).items():
        classes[v[0]].append(k)
    assert kept == {min(v) for v in classes.values()} and jaccard_join.keep_one(df.unionByName(df)).count() == len(kept)
    assert jaccard_join.keep_one(df).columns == df.columns


def test_recall_of_isolated_pairs(spark):
    """300 pairs of a similarity of 0.81 to 0.95, each alone, so that no third set can lead from one to the other."""
    rng, docs, shares = random.Random(3), [], []
    for k in range(300):
        lost = rng.randint(3, 12)
        a = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join([*a[:-lost], *(f"w{rng.randrange(10**9)}" for _ in range(lost))]))]
        shares.append((116 - lost) / (116 + lost))
    assert min(shares) > 0.81 and max(shares) < 0.96
    out = found(jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")))
    linked = sum(out[2 * k + 1][:2] == (2 * k, 1) for k in range(300))
    assert linked >= 299 and all(v[1] <= 1 for v in out.values())


def test_queries_shorten_their_prefixes(spark):
    """A crowd asks at its full paths, a lonely pair at the shortest prefixes."""
    sets = [(k, [1] * jaccard_join.TREES * jaccard_join.LONGEST) for k in range(40)] + [
        (100 + k, [2] * jaccard_join.TREES * jaccard_join.LONGEST) for k in range(2)]
    tries = jaccard_join.forest(spark.createDataFrame(sets, "node long, labels array<smallint>"))
    asked = jaccard_join.queries(tries, enough=jaccard_join.TREES).join(tries.select("key", "level").distinct(),
        "key").groupBy("node").agg(F.collect_set("level").alias("l"), F.count("*").alias("n")).collect()
    assert {r["node"]: (r["l"], r["n"]) for r in asked} == {**{k: ([jaccard_join.LONGEST], jaccard_join.TREES) for k in range(40)},
        100: ([jaccard_join.SHORTEST], jaccard_join.TREES), 101: ([jaccard_join.SHORTEST], jaccard_join.TREES)}


def test_join_edges(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.join(spark.createDataFrame([], schema)).count() == 0
    out = jaccard_join.join(spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, None)], schema)).collect()
    assert sorted((r["class_id"] or -1, r["n_copies"]) for r in out) == [(-1, 1), (1, 3), (1, 3), (1, 3)]
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r["node"]: r["label"] for r in jaccard_join.connected(edges).collect()} == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert jaccard_join.connected(edges.limit(0)).count() == 0
    assert jaccard_join.recall_of(jaccard_join.LONGEST) >= jaccard_join.FLOOR and jaccard_join.recall_of(jaccard_join.SHORTEST) >= jaccard_join.TARGET


def check_mix(rows, docs, block=source_mixing.BLOCK):
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    total = sum(size.values())
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = dict(zip(names, itertools.cycle((3, 1, 2))))
    full = set()
    while True:
        left = 1.5 * total - sum(2 * size[s] for s in full)
        w = sum(weight[s] for s in size if s not in full)
        more = {s for s in size if s not in full and w and left * weight[s] / w > 2 * size[s]}
        if not more:
            break
        full |= more
    for s in size:
        assert target[s] == pytest.approx(2 * size[s] if s in full else left * weight[s] / w, abs=1e-6)
        assert abs(taken[s] - target[s]) <= 4 * block
    assert len(rows) == docs


def test_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("source",
        F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 50 == 1,
            None).otherwise(F.col("source"))).withColumns({"size": F.lit("x"), "target": F.lit(1), "row": F.lit(2)})
    docs = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")))
    plan, rows = source_mixing.mix(docs)
    got = rows.collect()
    check_mix(got, docs.count())
    again = source_mixing.mix(docs)[1].collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in got) == sorted((str(r["doc_id"]), r["taken"]) for r in again)
    assert plan.agg(F.sum("n_words")).first()[0] == sum(r["taken"] for r in got)
    per_slot = plan.groupBy("slot").agg(F.sum("n_words").alias("n")).collect()
    assert max(r["n"] for r in per_slot) <= source_mixing.BLOCK
    out = source_mixing.repeat(docs)
    times = collections.Counter(r["doc_id"] for r in out.collect())
    want = collections.Counter()
    for r in got:
        want[r["doc_id"]] += int(r["taken"] / r["size"] + 0.5) if r["size"] else 0
    assert out.columns == docs.columns and times == +want


def test_positions_in_buckets(spark):
    """Sums over many buckets of few rows against a plain loop, with a hot group and ties."""
    from normweave.llm.common import dense_positions

    rng = random.Random(8)
    rows = [(rng.choice(("hot", "hot", None, "b")), rng.randrange(-(2**63), 2**63) if k % 5 else 7, k, rng.randrange(4)) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, h long, id long, w long")
    out = {r["id"]: (r["sum"], r["n"]) for r in dense_positions(dense_positions(df, ["g"], ["h", "id"], "w", "sum", rows_a_bucket=20), ["g"], ["h", "id"], None, "n", rows_a_bucket=20).collect()}
    total, count = collections.Counter(), collections.Counter()
    for g, _, k, w in sorted(rows, key=lambda r: (r[1], r[2])):
        assert out[k] == (total[g], count[g])
        total[g] += w
        count[g] += 1


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mixing.mix(empty)[1].count() == 0 and source_mixing.repeat(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in source_mixing.mix(blank)[1].collect()] == [(0, 0, 0.0)] * 2
    points = [r["u"] for r in spark.range(2000).select(source_mixing.golden_point(F.col("id")).alias("u")).collect()]
    counts = collections.Counter(int(u * 10) for u in points)
    assert max(counts.values()) - min(counts.values()) <= 6


def check_shards(rows, shards=16):
    held = collections.defaultdict(list)
    for r in rows:
        held[r["shard"]].append(r["slot"])
    sizes = [len(held.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in held.values())
    return held


def test_shards(spark, sf):
    rows = QUERIES["op5_label_shards"](spark, sf).collect()
    check_shards(rows)
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = collections.defaultdict(set)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "rows" and r["grown_shard"] is None
        groups[text[r["doc_id"]]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())  # all groups fit, so no edge is cut


def test_shards_with_a_hot_group(spark):
    n = 960
    rows = spark.range(n).select(F.col("id").alias("row"))
    key = F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string")))
    out = shard_balance.propagate(rows, spark.range(n).select(F.col("id").alias("row"), key.alias("key"))).collect()
    check_shards(out)
    of = {r["row"]: r["shard"] for r in out}
    cut_edges = sum(len({of[i] for i in range(n // 3, n) if i % 100 == k}) - 1 for k in range(100))
    hashed = sum(len({hash((i, 1)) % 16 for i in range(n // 3, n) if i % 100 == k}) - 1 for k in range(100))
    assert cut_edges < hashed / 2
    check_shards(shard_balance.propagate(rows.limit(5), rows.limit(0).select("row", F.lit("x").alias("key"))).collect())
    assert shard_balance.propagate(rows.limit(0), rows.limit(0).select("row", F.lit("x").alias("key"))).count() == 0


def test_a_large_group_that_fits_a_shard_stays_whole(spark):
    n = 3200  # a group of 3 % of the rows; the others are without links, or in pairs
    rows = spark.range(n).select(F.col("id").alias("row"))
    alone = F.when(F.col("row") < 96, "big").otherwise(F.concat(F.lit("k"), F.col("row").cast("string")))
    pairs = F.when(F.col("row") < 288, F.concat(F.lit("big"), (F.col("row") % 3).cast("string"))).otherwise(
        F.concat(F.lit("k"), F.floor(F.col("row") / 2).cast("string")))
    for key in (alone, pairs):
        out = shard_balance.propagate(rows, rows.select("row", key.alias("key"))).collect()
        check_shards(out)
        of = {r["row"]: r["shard"] for r in out}
        groups = [range(96)] if key is alone else [range(k, 288, 3) for k in range(3)]
        assert all(len({of[i] for i in g}) == 1 for g in groups)
    assert sum(of[i] != of[i + 1] for i in range(288, n, 2)) <= 32  # at the edges of shards and gaps only


@pytest.mark.parametrize(("n", "size"), [(200, 3), (200, 6), (1600, 20), (1600, 30), (1600, 50), (10_000, 3), (10_000, 100), (10_000, 312)])
def test_groups_stay_whole(spark, n, size):
    """All rows are linked, in groups of up to half a quota."""
    rows = spark.range(n).select(F.col("id").alias("row"))
    groups = n // size
    key = F.concat(F.lit("g"), F.pmod(F.xxhash64("row"), F.lit(1 << 40)).cast("string"))
    ranked = {r["row"]: i % groups for i, r in enumerate(rows.withColumn("k", key).orderBy("k").collect())}  # members lie anywhere
    links = spark.createDataFrame([(r, f"g{g}") for r, g in ranked.items()], "row long, key string")
    out = shard_balance.propagate(rows, links).collect()
    check_shards(out)
    shards = collections.defaultdict(set)
    for r in out:
        shards[ranked[r["row"]]].add(r["shard"])
    whole = sum(len(s) == 1 for s in shards.values())
    assert whole >= 0.9 * groups, (whole, groups)


def plain_propagation(keys, shards=16, rounds=4):
    """Rows move to the shard that most rows of their key are in, one after another, while there is room: cut keys."""
    n = len(keys)
    quota = -(-n // shards)
    at = [hash((3, i)) % shards for i in range(n)]
    votes, held = collections.defaultdict(collections.Counter), collections.Counter(at)
    for i, k in enumerate(keys):
        votes[k][at[i]] += 1
    for _ in range(rounds):
        for i, k in enumerate(keys):
            best = max(votes[k], key=lambda s: (votes[k][s], -s))
            if best != at[i] and held[best] < quota:
                votes[k][at[i]] -= 1
                votes[k][best] += 1
                held[at[i]] -= 1
                held[best] += 1
                at[i] = best
    return sum(len({at[i] for i in range(n) if keys[i] == k}) > 1 for k in set(keys))


def test_shards_cut_no_more_than_a_plain_propagation(spark):
    rng = random.Random(6)
    keys = [f"k{min(rng.randrange(200), rng.randrange(200))}" for _ in range(900)] + [f"alone{i}" for i in range(300)]
    rows = spark.range(len(keys)).select(F.col("id").alias("row"))
    out = {r["row"]: r["shard"] for r in shard_balance.propagate(rows, spark.createDataFrame(list(enumerate(keys)), "row long, key string")).collect()}
    of = collections.defaultdict(set)
    for i, k in enumerate(keys):
        of[k].add(out[i])
    assert sum(len(s) > 1 for s in of.values()) <= plain_propagation(keys)


@pytest.mark.parametrize(("n", "group"), [(1600, 3), (20_000, 10), (20_000, 100), (20_000, 625)])
def test_propagation_itself_gathers_the_groups(spark, n, group):
    """Also where groups fill every shard to the last row; without rounds hardly any is whole."""
    rows = spark.range(n).select(F.col("id").alias("row"))
    links = rows.select("row", F.concat(F.lit("k"), F.floor(F.col("row") / group).cast("string")).alias("key"))
    whole = {}
    for rounds in (0, shard_balance.ROUNDS):
        out = shard_balance.propagate(rows, links, rounds=rounds).collect()
        check_shards(out)
        shards = collections.defaultdict(set)
        for r in out:
            shards[r["row"] // group].add(r["shard"])
        whole[rounds] = sum(len(s) == 1 for s in shards.values()) / len(shards)
    assert whole[shard_balance.ROUNDS] >= 0.9 and whole[0] < 0.2


def cut_edges(links, of):
    """Pairs of a key's rows in different shards."""
    rows = collections.defaultdict(list)
    for row, key in links:
        rows[key].append(of[row])
    return sum(len(s) * (len(s) - 1) // 2 - sum(c * (c - 1) // 2 for c in collections.Counter(s).values()) for s in rows.values())


def test_rows_with_several_keys(spark):
    """Communities whose rows share several keys, against rows that move one after another to the shard of most neighbours."""
    rng = random.Random(12)
    n, community = 1600, 20
    links = [(i, f"c{i // community}-{rng.randrange(4)}") for i in range(n) for _ in range(2)] + [(i, f"far{rng.randrange(300)}") for i in range(0, n, 10)]
    links = sorted(set(links))
    rows = spark.range(n).select(F.col("id").alias("row"))
    run = lambda rounds: shard_balance.propagate(rows, spark.createDataFrame(links, "row long, key string"), rounds=rounds).collect()
    out = run(shard_balance.ROUNDS)
    check_shards(out)
    members, keys = collections.defaultdict(list), collections.defaultdict(list)
    for row, key in links:
        members[key].append(row)
        keys[row].append(key)
    at, room = {i: hash((5, i)) % 16 for i in range(n)}, collections.Counter()
    room.update(at.values())
    for _ in range(4):
        for i in range(n):
            votes = collections.Counter(at[j] for k in keys[i] for j in members[k] if j != i)
            best = max(range(16), key=lambda s: (votes[s], s == at[i]))
            if best != at[i] and room[best] < n // 16:
                room[at[i]] -= 1
                room[best] += 1
                at[i] = best
    ours, start = cut_edges(links, {r["row"]: r["shard"] for r in out}), cut_edges(links, {r["row"]: r["shard"] for r in run(0)})
    assert ours <= cut_edges(links, at) and ours < start / 2


def test_null_keys_link_nothing(spark):
    rows = spark.range(40).select(F.col("id").alias("row"))
    check_shards(shard_balance.propagate(rows, rows.select("row", F.lit(None).cast("string").alias("key"))).collect())


def test_chats_round_trip(spark):
    hard = ["<|im_end|>", "\\", "\\<|", "<\\|im_start|>", "a\nb", "<", "|>", "\\n", "<<||", "é😀", "", "\\\\<|im_end|>\\"]
    turns = [(1, i, role, t) for i, (role, t) in enumerate(itertools.product(("user", "assistant", "od\nd\\<|x"), hard))] + [
        (2, 0, None, None), (None, None, "assistant", "x"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit(1),
            "kind": F.lit("q")}).select("conv_id", "turn", "role", "text")
    done = chat_events.render(chat_events.fold(chat_events.log_of(df)))
    out = {r["conv_id"]: r for r in done.withColumn("turns", chat_events.parse(F.col("formatted"))).collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [(r, t) for c, _, r, t in turns if c == 1]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")] and len(out[3]["turns"]) == 2 and out[None]["turns"][0]["text"] == "x"
    f = out[1]["formatted"]
    learned = [re.sub(r"(?s)\\(.)", r"\1", f[s["start"] : s["start"] + s["length"]]) for s in out[1]["loss"]]
    assert learned == hard and f.count(chat_events.OPEN) == len(hard) * 3
    assert chat_events.render(chat_events.fold(chat_events.log_of(df.limit(0)))).count() == 0


def test_chat_events(spark):
    log = [
        (1, 0, "start", 1, "user", None), (1, 1, "delta", 1, None, "hel"), (1, 2, "delta", 1, None, "lo"),
            (1, 3, "start", 2, "assistant", None), (1, 4, "delta", 2, None, "bad"), (1, 5, "start", 3, "user", None),
            (1, 6, "delta", 3, None, "why"),
        (1, 7, "regenerate", 2, None, None), (1, 8, "delta", 2, None, "good"), (1, 9, "edit", 1, None, "hi"),
            (1, 10, "delta", 1, None, "!"), (1, 11, "start", 4, "user", None), (1, 12, "delta", 4, None, None),
    ]
    random.Random(2).shuffle(log)
    out = chat_events.fold(spark.createDataFrame(log,
            "conv_id long, seq long, kind string, message long, role string, payload string")).orderBy("message").collect()
    assert [(r["message"], r["role"], r["text"]) for r in out] == [(1, "user", "hi!"), (2, "assistant", "good"), (4, "user", "")]


def told(log):
    """The final messages of one conversation's log, event by event."""
    texts, roles, gone, begun = {}, {}, set(), {}
    rank = {k: i for i, k in enumerate(chat_events.KINDS)}
    for _, seq, kind, message, role, payload in sorted(log, key=lambda e: (e[1], rank[e[2]], e[5] or "", e[4] or "")):
        texts.setdefault(message, "")
        begun.setdefault(message, (seq, rank[kind]))
        if kind == "start":
            roles[message] = role
        elif kind == "delta":
            texts[message] += payload or ""
        else:
            texts[message] = (payload or "") if kind == "edit" else ""
        if kind == "regenerate":
            gone |= {m for m in texts if m > message and begun[m] < (seq, rank[kind])}
    return [(m, roles.get(m) or "", t) for m, t in sorted(texts.items()) if m not in gone]


def test_random_chat_logs(spark):
    """Streamed, edited and regenerated messages, many of them at equal places, against a plain loop."""
    rng = random.Random(4)
    kinds = ("start", "delta", "delta", "delta", "edit", "regenerate")
    log = [(c, rng.randrange(12), rng.choice(kinds), rng.randrange(4), rng.choice(("user", "assistant", None)),
            rng.choice((None, "", "a", "b\\n", "<|", "long words"))) for c in range(60) for _ in range(rng.randint(1, 25))]
    out = collections.defaultdict(list)
    for r in chat_events.fold(spark.createDataFrame(log,
            "conv_id long, seq long, kind string, message long, role string, payload string")).orderBy("conv_id", "message").collect():
        out[r["conv_id"]].append((r["message"], r["role"], r["text"]))
    assert all(out[c] == told([e for e in log if e[0] == c]) for c in range(60))


def test_chat_query_has_the_extra_conversation(spark, sf):
    r = QUERIES["op4_chat_events"](spark, sf).where("conv_id = -1").first()
    text = "<|im_end|><|im_start|>assistant ok"
    assert (r["n_turns"], r["loss_chars"]) == (2, len(text)) and r["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
