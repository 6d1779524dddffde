"""Operators on texts against brute force, with odd rows, and on empty tables."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from caseflow.llm import anchors, decontam, line_dedup, minhash_forest, packing, tokens
from tests.llm.helpers import BLANK_WORDS, CLASHES, frame, null_id, random_docs


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# ---------------------------------------------------------------- tokens

TEXTS = ["", None, "hello world", "a" * 3000, " " * 500 + "x" + "\n" * 400, "x<|endoftext|>y <|endoftext|> z" * 40,
         "it's we'll  they'd  x　y 12 345" * 30, "café 漢字 " * 200, "no end " * 900, "   a \x85b" * 20]


@pytest.mark.parametrize("cut", [{}, {"huge": 200, "step": 100, "overlap": 33}, {"huge": 50, "step": 400, "overlap": 40}])
def test_token_counts(spark, cut):
    tok = tokens.tokenizer(None)
    rows = [*enumerate(TEXTS), (None, "null id"), (3, TEXTS[3])]
    got = tokens.token_counts(frame(spark, rows), **cut).collect()
    want = Counter((i, len((t or "").encode()), n := len(tok.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t in rows)
    assert Counter(map(tuple, got)) == want


def test_pieces_keep_every_character():
    for t in TEXTS:
        first, rest = tokens.pieces(t or "")
        assert " ".join([first, *rest]) == (t or "")


def test_pieces_are_encoded_as_in_the_text():
    """Also with a cache that starts anew all the time, and special strings as whole or part of a piece."""
    texts = [t or "" for t in TEXTS] + [t or "" for _, t in random_docs(20)] + ["a <|endoftext|> b", "<|endoftext|>", "x <|endoftext|>y"]
    texts += ["word*** word%%% it's% don't.'s x's's end.\nThe ça'll! été's-là Дом's. 9'9'd a_b _c' u²'s =\u0338= e\u0301'll " * 3, "x<|endoftext|>y. z.<|endoftext|>"]
    tok = tokens.tokenizer(None)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for limit in (0, 10, 1000):
        old, tokens.CACHE = tokens.CACHE, limit
        try:
            count, ids = tokens.WordEncoder(None), tokens.WordEncoder(None, ids=True)
            for k in range(0, len(texts), 7):
                part = texts[k:k + 7]
                assert [sum(c) for c in count(part)] == [len(w) for w in want[k:k + 7]]
                assert [np.frombuffer(b"".join(c), "<u4").tolist() for c in ids(part)] == want[k:k + 7]
        finally:
            tokens.CACHE = old


# ---------------------------------------------------------------- decontamination

def brute_decontam(docs, items, window=10):
    word = decontam.re.compile(decontam.WORD) if hasattr(decontam, "re") else __import__("re").compile(decontam.WORD)
    ph = set()
    for i, t in items:
        w = word.findall(lower(t))
        if i is not None and w:
            n = min(window, len(w))
            ph |= {(str(i), tuple(w[s:s + n])) for s in range(len(w) - n + 1)}
    by = {}
    for i, p in ph:
        by.setdefault(p, set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = word.findall(lower(t)) if d is not None else [], set(), set()
        for n in {len(p) for p in by}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in by:
                    hit |= set(range(s, s + n))
                    found |= by[tuple(w[s:s + n])]
        out.append((d, len(w), len(hit), tuple(sorted(found)), bool(hit)))
    return Counter(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed):
    docs = null_id(random_docs(seed))
    r = random.Random(seed)
    items = [(i, " ".join((t or "").split()[r.randrange(4):][:r.choice([3, 10, 14])])) for i, t in docs[:40:4]]
    items += [(77, "tau"), (78, "TAU tau"), (79, None), (80, "?!"), (81, items[0][1]), (None, "alpha beta"), (82, "unseen words here")]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' as term", "1 as pos", "2 as n")
    got = decontam.decontaminate(frame(spark, docs), bench)
    assert "h1" in got.columns
    rows = got.collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_hit"], tuple(x["items"]), x["contaminated"]) for x in rows) == brute_decontam(docs, items)
    for x in rows:
        assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_hit"]


def test_decontamination_by_shuffle_joins(spark, monkeypatch):
    """Beyond the broadcast bound the same rows come from shuffle joins."""
    from caseflow.llm import common

    docs = random_docs(3)
    items = [(1, docs[0][1]), (2, docs[5][1]), (3, "alpha")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    few = decontam.decontaminate(frame(spark, docs, False), bench).collect()
    monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", -1)
    assert Counter(map(str, decontam.decontaminate(frame(spark, docs, False), bench).collect())) == Counter(map(str, few))


def test_proximity(spark):
    docs = random_docs(4, n=30)
    q = [(1, "alpha beta gamma"), (2, "tau"), (3, "nothing"), (4, None), (None, "alpha")]
    got = decontam.proximity(frame(spark, docs), spark.createDataFrame(q, "query_id long, text string"), span=8).collect()
    want = set()
    for i, t in docs:
        w = __import__("re").findall(decontam.WORD, lower(t))
        for k, terms in ((1, {"alpha", "beta", "gamma"}), (2, {"tau"})):
            best = min(((e - s, s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + 8) + 1) if terms <= set(w[s:e])), default=None)
            if best:
                want.add((k, i, best[1], best[2]))
    assert {tuple(x) for x in got} == want


# ---------------------------------------------------------------- lines

def brute_lines(docs, min_key=10):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in docs:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_key:
                held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in docs:
        ls = (t or "").split("\n")
        keep = [x for x in ls if i is None or len(h := held.get(key(x), ())) < 2 or min(h) == i]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return Counter(out)


def test_line_dedup(spark):
    r = random.Random(5)
    pool = ["  Shared Line One ", "shared line one\r", "\x0bshared line two\x0c", "short", "", "ÉCOLE normale", "école normale", "licence text 2024"]
    docs = [(i, "\n".join(r.choice([*pool, f"own line number {i}"]) for _ in range(r.randint(1, 9)))) for i in range(40)]
    docs += [(50, None), (51, ""), (None, "shared line one"), docs[3], docs[3], (4, "shared line two\nanother text of document four"),
             (60, "\n".join(["shared line one"] * 300))]
    rows = line_dedup.line_dedup(frame(spark, docs).selectExpr("*", "'x' AS lines", "'x' AS `a.b`")).collect()
    extra = [*(set(CLASHES.split()) - {"keep"}), "lines", "a.b"]
    assert all(x[c] == "x" for x in rows for c in extra)
    assert Counter((x["doc_id"], x["n_lines"], x["n_dropped"], x["kept_text"]) for x in rows) == brute_lines(docs)
    assert all(sum(k["length"] for k in x["keep"]) == x["n_lines"] - x["n_dropped"] for x in rows)


# ---------------------------------------------------------------- packing

def test_packing_round_trip(spark):
    tok, docs = tokens.tokenizer(None), null_id(random_docs(6))
    got = packing.pack_documents(frame(spark, docs), capacity=64, with_ids=True).collect()
    want = Counter((i, (*tok.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in docs)
    parts, bins = {}, {}
    for x in got:
        ids = np.frombuffer(bytes(x["ids"]), "<u4")
        assert len(ids) == x["length"] and zlib.crc32(bytes(x["ids"])) == x["ids_crc32"] and 1 <= len(ids) <= 64
        parts.setdefault(x["doc_id"], Counter())[x["piece"], x["start"], tuple(ids.tolist())] += 1
        bins.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for i, ids in want:
        cuts = [0, *range((len(ids) - 1) % 64 + 1, len(ids) + 1, 64)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            assert parts[i][k, s, ids[s:e]] >= want[i, ids]
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert len(bins) <= 1.03 * total / 64 + 1


def test_plans_are_bounded():
    """Lengths that a bin takes several times are used up within a logarithm of their uses."""
    for seed in range(4):
        r = np.random.default_rng(seed)
        histogram = {int(n): int(c) for n, c in zip(r.integers(1, 200 if seed % 2 else 2049, 300), r.integers(1, 10**9, 300), strict=True)}
        plans = packing.plan_bins(histogram)
        assert len(plans) <= 11 * len(histogram)
        used = Counter()
        for times, lengths in plans:
            for x in lengths:
                used[x] += times
        assert used == histogram


def test_bins_never_worse_than_greedy():
    r = np.random.default_rng(1)
    for _ in range(20):
        hist = {int(k): int(v) for k, v in zip(r.choice(np.arange(1, 101), 30, replace=False), r.integers(1, 50, 30))}
        plans, used = packing.plan_bins(hist, 100), Counter()
        for times, lengths in plans:
            assert sum(lengths) <= 100
            for x in lengths:
                used[x] += times
        assert used == Counter(hist)
        assert sum(t for t, _ in plans) <= 1.25 * sum(k * v for k, v in hist.items()) / 100 + 1
    assert packing.plan_bins({}, 100) == []


# ---------------------------------------------------------------- near duplicates

def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("seed,words", [(7, 4), (8, 5)])
def test_near_duplicates(spark, seed, words):
    docs = null_id(random_docs(seed, n=120))
    sets = []
    for i, t in docs:
        w = BLANK_WORDS.findall(lower(t))
        sets.append((i, {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    known = [(i, s) for i, s in sets if i is not None and s]
    links = [(a, b) for k, (a, s) in enumerate(known) for b, z in known[k + 1:] if a != b and 100 * len(s & z) >= 80 * len(s | z)]
    comp = brute_components({i for i, _ in docs if i is not None}, links)
    got = minhash_forest.near_duplicates(frame(spark, docs), words=words).collect()
    assert Counter(map(tuple, got)) == Counter((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets)
    assert len(links) > 20


def test_large_group_of_near_copies(spark):
    """A group far larger than the neighbours looked at is one component."""
    base = [f"w{k}" for k in range(200)]
    docs = [(i, " ".join([*base[:i % 190], f"edit{i}", *base[i % 190 + 1:]])) for i in range(400)]
    got = minhash_forest.near_duplicates(frame(spark, docs, False)).collect()
    assert {x["component_id"] for x in got} == {0} and sum(x["kept"] for x in got) == 1


def test_star_of_copies_of_one_original(spark):
    """Copies near to their original alone, more than all orders' neighbours: one component; a crowd with common boilerplate."""
    r = random.Random(4)
    base, docs = [f"w{k}" for k in range(300)], []
    for i in range(700):
        w = list(base)
        for k in range(6):
            w[50 * k + r.randrange(3, 46)] = f"edit{i}x{k}"
        docs.append((i, " ".join(base if i == 350 else w)))
    for i in range(60):  # 70 % boilerplate; each even one and the next are near
        docs.append((1000 + i, " ".join([f"b{k}" for k in range(140)] + [f"own{i // 2}x{k}" for k in range(56)] + [f"end{i}x{k}" for k in range(4)])))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = brute_components(ids, links)
    assert sum(350 in x for x in links) == 699 and len({comp[i] for i in range(700)}) == 1 and len(links) < 1000
    got = minhash_forest.near_duplicates(frame(spark, docs, False)).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == comp


# ---------------------------------------------------------------- substring dedup

def brute_substrings(docs, window=13):
    first = {}
    cut = [(i, BLANK_WORDS.findall(t or "")) for i, t in docs]
    for i, w in cut:
        for s in range(len(w) - window + 1):
            if i is not None:
                g = tuple(w[s:s + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for i, w in cut:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s:s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("seed,window", [(9, 13), (10, 13), (11, 6)])
def test_substring_dedup(spark, seed, window):
    docs = null_id(random_docs(seed))
    got = anchors.substring_dedup(frame(spark, docs), window).collect()
    assert Counter((x["doc_id"], x["n_words"], x["n_removed"], x["kept_text"]) for x in got) == brute_substrings(docs, window)
    assert any(x["n_removed"] for x in got)
    for x in got:
        assert sum(s["end"] - s["start"] for s in x["removed"]) == x["n_removed"]


# ---------------------------------------------------------------- empty tables

@pytest.mark.parametrize("run", [tokens.token_counts, line_dedup.line_dedup, packing.pack_documents, minhash_forest.near_duplicates,
                                 anchors.substring_dedup], ids=lambda f: f.__name__)
def test_empty_tables(spark, run):
    assert run(frame(spark, [], False)).collect() == []
    assert run(frame(spark, [(None, None)], False)).count() == 1


def test_empty_benchmark_and_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x["n_hit"] for x in decontam.decontaminate(frame(spark, [(1, "a b")], False), none).collect()] == [0]
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminate(frame(spark, [], False), one).collect() == []
