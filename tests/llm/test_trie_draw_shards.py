"""Operators 11 to 13 against plain Python: odd rows, ties, hot groups, tiny shards and summaries."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from caseflow.llm import prefix_trie, resampling, sharding
from tests.llm.helpers import CLASHES, frame, null_id, random_docs

# --- 11: prefix trie ------------------------------------------------------------------------------------


def plain_sequences(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            by[conv].append(((turn is not None, turn or 0, key), (role, text)))
    return {c: [t for _, t in sorted(x, key=lambda y: y[0])] for c, x in by.items()}


def plain_rebuilt(seqs):
    out = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = seqs.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(seqs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
        ends[tuple(s)].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def conversations(seed, n=80):
    r = random.Random(seed)
    openings = [[("user", f"hello {i}") for i in range(r.randint(0, 6))] for _ in range(3)]
    rows = []
    for c in range(n):
        turns = list(r.choice(openings)) + [(r.choice(["user", "assistant"]), r.choice(["a", "b", "é", ""])) for _ in range(r.randint(0, 3))]
        if c % 3 == 0:
            turns = [("user", "same"), ("assistant", "same")]  # a third of all are alike
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    return [*rows, (200, None, "user", "late"), (200, 0, None, None), (200, 0, "", ""), (201, 1, "u", None), (None, 0, "user", "x"),
            rows[0], (203, 0, "ab", "c"), (204, 0, "a", "bc"), (206, 0, "user", "hello 0"), *[(207, i, "user", f"long {i % 7}") for i in range(300)]]


@pytest.mark.parametrize("shard", [7, 1 << 18])
@pytest.mark.parametrize("build", ["plain", "rebuilt"])
def test_trie_equals_plain(spark, shard, build):
    rows = conversations(shard)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.selectExpr("*", *[f"'x' as `{c}`" for c in CLASHES.split() if c not in df.columns])
    seqs, want = prefix_trie.sequences(df), plain_sequences(rows)
    if build == "rebuilt":
        seqs, want = prefix_trie.rebuilt(seqs), plain_rebuilt(want)
    got = sorted(tuple(r) for r in prefix_trie.trie(seqs, shard).collect())
    assert got == plain_trie(want)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(empty))).collect() == []


def test_trie_of_one_turnless_conversation(spark):
    df = spark.createDataFrame([(7, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    # crc32("7") % 9 = h turns come from the absent conversation 5
    assert [tuple(r) for r in prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df))).collect()] == plain_trie(
        plain_rebuilt({7: [("user", "x")]}))


def test_tree_is_balanced_by_medians():
    tree = prefix_trie.Tree()
    tree.fill([([i], [1], i, 1, "") for i in range(1, 1024)])
    deepest, todo = 0, [(tree.eq[0], 1)]
    while todo:
        x, d = todo.pop()
        deepest = max(deepest, d)
        todo += [(y, d + 1) for y in (tree.low[x], tree.high[x]) if y]
    assert deepest == 10


# --- 12: importance resampling --------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_draw(rows, target, percent, least):
    s, t = (Counter(f for x in texts for f in plain_features(x)[1]) for texts in ([x[1] for x in rows], target))
    sa, ta = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sa + 10000) / ((s[b] + 1) * (ta + 10000)))) for b in range(10000)]
    out = []
    for i, text in rows:
        n, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    ok = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = Counter()
    for k, r in enumerate(ok[:percent * len(ok) // 100]):
        ranks[(*r, k + 1)] += 1
    drawn = Counter(x[:-1] for x in ranks.elements())
    rest = Counter(tuple(r) for r in out) - drawn
    return sorted([*ranks.elements(), *[(*r, None) for r in rest.elements()]], key=repr)


@pytest.mark.parametrize("samples", [8, 1 << 16])
def test_draw_equals_plain(spark, monkeypatch, samples):
    monkeypatch.setattr(resampling, "SAMPLES", samples)
    rows = null_id(random_docs(5, n=150)) + [(5000, "Alpha " * 30), (5000, "Alpha " * 30)] * 20
    target = ["alpha beta gamma delta " * 3, None, "", "Rho-rho é"]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([(x,) for x in target], "text string"), percent=30)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_draw(rows, target, 30, 20)


def test_draw_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).collect() == []
    got = resampling.resample(spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), none)
    assert sorted((r.doc_id, r.n_features, r.rank) for r in got.collect()) == [(1, 3, None), (2, 0, None)]


def test_features_of_long_text_cross_pieces(monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 5)
    text = "Ab  cd-é漢 x " + "verylongword" * 3 + " y z\x00q" * 9
    found = [x % 10000 for _, f in resampling.features(text) for x in f.tolist()]
    assert Counter(found) == Counter(plain_features(text)[1])
    assert sum(n for n, _ in resampling.features(text)) == plain_features(text)[0]


def test_string_ids_and_ties(spark):
    rows = [(f"d{i}", "one two three " * 10) for i in range(40)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame([("one",)], "text string"), 50)
    ranked = sorted((r.rank, -r.score, r.doc_id) for r in got.collect() if r.rank)
    assert [r[0] for r in ranked] == list(range(1, 21)) and [r[1:] for r in ranked] == sorted(r[1:] for r in ranked)


# --- 13: sharding ---------------------------------------------------------------------------------------

def least_capacity(sizes, shards):
    """Smallest capacity by trying the greedy fill with every number from the lower bound on."""
    c = max([*sizes, -(-sum(sizes) // shards)], default=0)
    while True:
        used, left = 0, 0
        for x in sizes:
            if x > left:
                used, left = used + 1, c
            left -= x
        if used <= shards:
            return c
        c += 1


@pytest.mark.parametrize("cells", [4, 50, 1 << 14])
@pytest.mark.parametrize("shards", [1, 3, 16])
def test_shards_equal_plain(spark, monkeypatch, cells, shards):
    monkeypatch.setattr(sharding, "CELLS", cells)
    monkeypatch.setattr(sharding, "COPIES", 7)
    rows = null_id(random_docs(cells + shards, n=120)) + [(7000 + i, "hot " * 40) for i in range(90)] + [(800, "same row")] * 30
    got = sharding.shard_documents(frame(spark, rows), shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    texts = defaultdict(list)
    for i, t in rows:
        texts[t or ""].append((i, len((t or "").encode()) + 1))
    groups = sorted(texts.items(), key=lambda g: (min((i for i, _ in g[1] if i is not None), default=-1), hashlib.sha256(g[0].encode()).digest()))
    sizes = [sum(s for _, s in g) for _, g in groups]
    held, slots, of = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        held[r.shard] += r.size
        slots[r.shard].append(r.slot)
        of[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None
    assert max(held.values()) == least_capacity(sizes, shards)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and all(len(x) == 1 for x in of.values())
    order = [min(of[zlib.crc32(t.encode())]) for t, _ in groups]
    assert order == sorted(order) and set(order) <= set(range(shards))


def test_shards_of_nothing_and_of_few(spark):
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    got = sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, None), (3, "")], "doc_id long, text string"), 4).collect()
    assert {r.doc_id: r.size for r in got} == {1: 2, 2: 1, 3: 1}
    by = {r.doc_id: r.shard for r in got}
    assert by[2] == by[3] != by[1]


def test_large_group_leaves_the_others_even(spark):
    rows = [(i, f"text {i:04d}" * 5) for i in range(400)] + [(1000 + i, "copy " * 40) for i in range(60)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    held = sorted(sum(r.size for r in got if r.shard == k) for k in range(16))
    assert held[-1] == 60 * 201 and held[0] > 0 and held[-2] < 1.4 * held[0]
