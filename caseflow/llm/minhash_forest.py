"""MinHash near-dedup with an LSH forest.

Method. A document's set is its distinct word shingles; equal sets are collapsed
to one class. A class signature of ``TREES * LANES`` min-hashes is read in
``TREES`` orders, each starting at other lanes and ``DEPTH`` lanes deep. Every
order is range-partitioned and sorted; the next ``NEIGHBOURS`` rows of a row with
a common prefix of ``MIN_PREFIX`` lanes or more are its candidates. So the depth
adapts to each region: where few signatures lie, a short common prefix is
enough; in a crowded region (a large group of near copies, a shared licence) the
nearest rows are those with the longest common prefix. Rows at partition borders
meet in a second pass over the borders alone.

Candidates are confirmed on full shingle sets: first each class with its best
candidates, then, after connected components, only pairs that still join two
components. A confirmed pair inside a component changes nothing, so no pair is
checked in vain.

Crowds are finished exactly. Rows that share ``RUN`` lanes of an order are a run; a
run of more rows than an order's neighbours see, and of more than one component,
is cut into blocks, and every pair of its blocks is a unit. A unit first keeps
the rows with a partner in another component whose signatures agree as often as
a pair over the threshold may, then counts the shared shingles of all its pairs at
once; only links that join two components leave it, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import bounded, components, shuffle_width, stage
from caseflow.llm.hashing import U, by_bytes, mix, window_hashes, word_hashes

TREES, LANES, DEPTH = 24, 4, 32
NEIGHBOURS = 8
MIN_PREFIX = 2   # lanes two rows of an order must share from the front
MIN_AGREE = 22   # of the DEPTH lanes, anywhere; at similarity 0.8 one pair in 40 has fewer in an order, so none in all
BEST = 3         # candidates of a class confirmed first
RUN = LANES      # lanes shared by the rows of a run; those of the orders do not overlap
BLOCK = 1024     # rows of a run's block, about
SHINGLES = 1 << 20  # shingles of a run's block, about
_LANES = TREES * LANES
_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 32, _LANES, dtype=np.uint64).astype(np.uint32)[:, None]
_MUL = (_RNG.integers(0, 1 << 31, _LANES, dtype=np.uint64) * U(2) + U(1)).astype(np.uint32)[:, None]


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """Per text its sorted distinct shingle hashes: ``n`` words, A-Z folded; all words if fewer."""
    words, first = word_hashes(texts, fold=True)
    grams = window_hashes(words, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a:b - n + 1])
            yield g[np.concatenate(([True], g[1:] != g[:-1]))]
        else:
            yield window_hashes(words[a:b], b - a) if b > a else grams[:0]


def _signature(s: np.ndarray) -> bytes:
    low, best = (s >> U(16)).astype(np.uint32), np.full(_LANES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        np.minimum(best, ((low[None, i:i + 1024] ^ _XOR) * _MUL).min(axis=1), out=best)
    # 16 mixed bits of each minimum
    return (mix(best.astype(np.uint64)) & U(0xFFFF)).astype(">u2").tobytes()


def _sign(n: int):
    def run(batches):
        for b in by_bytes(batches):
            size, k1, k2, sig = [], [], [], []
            for s in shingle_sets(b.column("text"), n):
                size.append(len(s))
                k1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                k2.append(int(mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(_signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sig"])
    return run


def _pairs(keys: np.ndarray, ids: np.ndarray, part: np.ndarray | None, begin: int):
    """Candidate pairs of sorted rows; only those whose second row is at ``begin`` or later."""
    out = []
    for j in range(1, min(NEIGHBOURS, len(ids) - 1) + 1):
        same = keys[:-j] == keys[j:]
        ok = same[:, :MIN_PREFIX + 1].all(axis=1) & (same[:, 1:].sum(axis=1) >= MIN_AGREE) & (ids[:-j] != ids[j:])
        if part is not None:
            ok &= part[:-j] != part[j:]
        ok[:max(0, begin - j)] = False
        a, b = ids[:-j][ok], ids[j:][ok]
        out.append((np.minimum(a, b), np.maximum(a, b), same[ok, 1:].sum(axis=1)))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3


def _rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(b.column("key").to_pylist()), ">u2").reshape(b.num_rows, DEPTH + 1)
    return keys, b.column("id").to_numpy(zero_copy_only=False)


_NEIGHBOURS = "a bigint, b bigint, agree bigint, part int, key binary"


def _batch(a, b, agree, part=None, key=None) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int64()),
         pa.array([part] * n, pa.int32()), pa.array(key or [None] * n, pa.binary())], ["a", "b", "agree", "part", "key"])


def _neighbours(batches):
    """Candidate pairs of a sorted partition, then its first and last rows (``part``, ``key`` set)."""
    part, keys, ids, head = TaskContext.get().partitionId(), None, None, None
    for b in batches:
        if not b.num_rows:
            continue
        k, i = _rows(b)
        begin = 0
        if ids is not None:
            begin, k, i = len(ids), np.concatenate([keys, k]), np.concatenate([ids, i])
        if head is None or len(head[1]) < NEIGHBOURS:
            grown = k if head is None else np.concatenate([head[0], k[begin:]])
            grown_i = i if head is None else np.concatenate([head[1], i[begin:]])
            head = grown[:NEIGHBOURS], grown_i[:NEIGHBOURS]
        yield _batch(*_pairs(k, i, None, begin))
        keys, ids = k[-NEIGHBOURS:], i[-NEIGHBOURS:]
    if ids is not None:
        k, i = np.concatenate([head[0], keys]), np.concatenate([head[1], ids])
        yield _batch(i, i, np.zeros(len(i), np.int64), part, [x.tobytes() for x in k])


def _borders(batches):
    """Candidate pairs across partitions, from the sorted border rows (2 * NEIGHBOURS a partition)."""
    t = pa.Table.from_batches(batches)
    if t.num_rows:
        b = t.combine_chunks().to_batches()[0]
        yield _batch(*_pairs(*_rows(b), b.column("part").to_numpy(zero_copy_only=False), 0))


def candidates(classes: DataFrame) -> DataFrame:
    """``classes(id, sig)`` -> distinct candidate pairs ``(a, b, agree)``, a < b."""
    lanes = F.concat("sig", "sig")
    orders = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(
        F.unhex(F.lpad(F.hex(t), 4, "0")), F.substring(lanes, t * (2 * LANES) + 1, F.lit(2 * DEPTH))))).alias("key")
    rows = classes.select("id", orders).repartitionByRange(shuffle_width(classes.sparkSession), "key", "id")
    near = stage(rows.sortWithinPartitions("key", "id").mapInArrow(_neighbours, _NEIGHBOURS), "neighbours")
    edge = near.where("part is not null").select(F.col("a").alias("id"), "part", "key").distinct()
    # bounded by the number of partitions, not by the data
    across = edge.repartition(1).sortWithinPartitions("key", "id").mapInArrow(_borders, _NEIGHBOURS)
    return near.where("part is null").union(across).groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _confirm(n: int, share: int, of: int):
    def run(batches):
        for big in by_bytes(batches, "text_a"):
            for b in by_bytes(iter([big]), "text_b"):
                sets = zip(shingle_sets(b.column("text_a"), n), shingle_sets(b.column("text_b"), n), strict=True)
                ok = []
                for x, y in sets:
                    both = len(x) + len(y) - len(z[np.concatenate(([True], z[1:] != z[:-1]))]) if len(z := np.sort(np.concatenate([x, y]))) else 0
                    ok.append(of * both >= share * (len(x) + len(y) - both) and both > 0)
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return run


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, share: int, of: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets pass, with ``texts(id, text)``."""
    both = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
            .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(n, share, of), "a bigint, b bigint")


def _fewest(share: int, of: int) -> int:
    """Lanes that a pair of the threshold's similarity shares, less six standard deviations."""
    p = share / of
    return int(_LANES * p - 6 * (_LANES * p * (1 - p)) ** 0.5)


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a unit's two blocks (twice the same for a block with itself) and the components of all its rows."""
    mine, c = t.column("mine").to_numpy(), t.column("c").to_numpy()
    i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
    return np.flatnonzero(mine == i), np.flatnonzero(mine == j), c


def _alike(fewest: int):
    def run(t: pa.Table) -> pa.Table:
        left, right, c = _sides(t)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), ">u2").reshape(t.num_rows, _LANES).astype(np.uint16).T.copy()
        agree = np.zeros((len(left), len(right)), np.uint8)
        for lane in sig:
            agree += lane[left][:, None] == lane[right][None, :]
        ok = (agree >= fewest) & (c[left][:, None] != c[right][None, :])
        keep = np.zeros(t.num_rows, bool)
        keep[left[ok.any(axis=1)]] = True
        keep[right[ok.any(axis=0)]] = True
        return t.drop_columns(["sig"]).filter(pa.array(keep))
    return run


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 4096) -> np.ndarray:
    """Number of common shingles of each left with each right row."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[times[column] > 1], column[times[column] > 1]  # others are in one row alone
    order = np.argsort(column, kind="stable")
    row, column = row[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, z = np.searchsorted(column, (at, at + width))
        has = np.zeros((len(sets), width), np.float32)
        has[row[a:z], column[a:z] - at] = 1
        both += (has[left] @ has[right].T).astype(np.int64)
    return both


def _links(n: int, share: int, of: int):
    def run(t: pa.Table) -> pa.Table:
        left, right, c = _sides(t)
        sets, ids, out = list(shingle_sets(t.column("text").combine_chunks(), n)), t.column("id").to_numpy(), []
        size, both = np.array([len(x) for x in sets]), _shared(sets, left, right)
        union = size[left][:, None] + size[right][None, :] - both
        ok = (of * both >= share * union) & (both > 0)
        now = c.copy()
        for k in np.flatnonzero(ok.any(axis=1)):
            me, others = left[k], right[ok[k]]
            names, first = np.unique(now[others], return_index=True)
            for name, other in zip(names.tolist(), others[first].tolist(), strict=True):
                if name != now[me]:
                    out.append((ids[me], ids[other]))
                    now[now == name] = now[me]
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})
    return run


def finished(classes: DataFrame, found: DataFrame, docs: DataFrame, n: int, share: int, of: int) -> DataFrame:
    """Links ``(a, b)`` between components of ``found`` inside the runs that neighbours do not cover.

    ``classes(id, n_shingles, sig)``, ``docs(id, text)``."""
    runs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(
        F.unhex(F.lpad(F.hex(t), 4, "0")), F.substring("sig", t * (2 * LANES) + 1, F.lit(2 * RUN))))).alias("key")
    member = classes.join(found, "id", "left").select("id", "n_shingles", "sig", F.coalesce("component_id", "id").alias("c"))
    rows = member.select("id", "c", runs)
    size = F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / SHINGLES)
    long = (member.select("id", "c", "n_shingles", runs).groupBy("key")
            .agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high"), F.ceil(size).cast("int").alias("blocks"))
            .where((F.col("n") > NEIGHBOURS + 1) & (F.col("low") < F.col("high"))).select("key", "blocks"))
    mine = rows.join(bounded(stage(long, "long-runs")), "key").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    unit = mine.select("id", "c", "key", "mine", other).select(
        "id", "c", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    unit = stage(unit, "units").join(classes.select("id", "sig"), "id")
    kind = "id bigint, c bigint, key binary, mine int, i int, j int"
    alike = stage(unit.select("id", "c", "key", "mine", "i", "j", "sig").groupBy("key", "i", "j")
                  .applyInArrow(_alike(_fewest(share, of)), kind), "alike")
    texts = docs.join(bounded(stage(alike.select("id").distinct(), "alike-ids")), "id", "left_semi")
    texts = stage(texts.dropDuplicates(["id"]), "alike-texts")
    return alike.join(texts, "id").groupBy("key", "i", "j").applyInArrow(_links(n, share, of), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, of: int = 100) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Sets of distinct ``words``-word shingles (words split at blanks, A-Z folded);
    a text of fewer words is one shingle of all its words. Documents link when
    ``of * intersection >= share * union``. ``component_id`` is the smallest
    doc_id reachable by links. Null, empty and wordless texts link with nothing,
    also not with each other: their component is their own id. Rows that repeat
    a doc_id are one node. A null doc_id links with nothing: component null, kept.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(d.mapInArrow(_sign(words), "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, sig binary"), "signatures")
    known = signed.where("n_shingles > 0 and doc_id is not null")
    classes = stage(known.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("id"), F.min("sig").alias("sig")), "classes")

    pairs = stage(candidates(classes.select("id", "sig")), "pairs")
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = stage(d.join(bounded(stage(ends, "ends")), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")

    # first pass: the best candidates of each class, on either side of a pair
    sides = pairs.select("a", "b", "agree", F.col("a").alias("me")).union(pairs.select("a", "b", "agree", F.col("b").alias("me")))
    rank = F.row_number().over(Window.partitionBy("me").orderBy(F.desc("agree"), "a", "b"))
    best = stage(sides.withColumn("k", rank).where(F.col("k") <= BEST).select("a", "b").distinct(), "best")
    found = stage(components(confirmed(best, texts, words, share, of)), "components")

    # second pass: of the other candidates those that would join two components
    of_id = lambda x: found.select(F.col("id").alias(x), F.col("component_id").alias("c" + x))
    rest = pairs.join(best, ["a", "b"], "left_anti").join(of_id("a"), "a", "left").join(of_id("b"), "b", "left")
    rest = rest.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
    more = confirmed(rest, texts, words, share, of)
    found = components(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more))

    # last pass: what the neighbours leave out of crowds
    found = stage(found, "components")
    more = finished(classes.select("id", "n_shingles", "sig"), found, d.withColumnRenamed("doc_id", "id"), words, share, of)
    found = components(found.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(more))

    named = classes.join(found, "id", "left").select("k1", "k2", F.col("n_shingles").alias("n"),
                                                     F.coalesce("component_id", "id").alias("component_id"))
    s = signed.select("doc_id", "n_shingles", F.col("k1").alias("s1"), F.col("k2").alias("s2"))
    out = s.join(named, (s["s1"] == named["k1"]) & (s["s2"] == named["k2"]) & (s["n_shingles"] == named["n"]), "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
