"""Embedding near-dedup: an exact metric range join on the unit sphere.

Method. Equal vectors are one class. Cosine ``c`` or more means a distance of at
most ``r = sqrt(2 - 2c)`` between unit vectors. Pivots (a bounded sample of
classes, no two within ``2r``) partition the classes: each lives in the cell of
its nearest pivot. It also visits an earlier cell if a vector of that cell could
lie within ``r``: by the triangle inequality it is at most the cell's radius plus
``r`` from that pivot, and at most ``r`` beyond the plane between the two pivots.
Cells then join independently, residents with residents and with visitors, so
every pair that can link is compared exactly once. A large cell is cut into units
of ``UNIT`` residents, and visitors come in blocks, so a task's memory is bounded;
a task returns one count and one component root for each linked vector, never
pairs.

Products are taken in single precision first; whatever lies within ``SLACK`` of
the threshold is decided in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import components, stage

PIVOTS = 1024       # at most so many pivots (and four times as many vectors looked at)
CELL = 4_000        # classes a cell should hold, until the pivots run out
UNIT = 8_000        # residents of a task
VISITORS = 64_000   # visitors of a task, on average at most
SLACK = 1e-4
_ROWS = 512         # residents multiplied at a time


def _unit(blobs: list[bytes], kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _pack(kind: str):
    """Classes' arrays as binary."""
    def run(batches):
        for b in batches:
            v = b.column("embedding")
            flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
            step = len(flat) // max(1, b.num_rows)
            blobs = [flat[i * step:(i + 1) * step].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("id"), b.column("n"), pa.array(blobs, pa.binary())],
                                             ["h1", "h2", "id", "n", "vector"])
    return run


def _home(pivots: np.ndarray, kind: str):
    def run(batches):
        for b in batches:
            if b.num_rows:
                d2 = np.maximum(0, 2 - 2 * _unit(b.column("vector").to_pylist(), kind) @ pivots.T)
                home = d2.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(home, pa.int32()), pa.array(np.sqrt(d2[np.arange(len(home)), home]))], ["cell", "d"])
    return run


_DEALT = "unit int, block int, resident boolean, id bigint, n bigint, vector binary"


def _deal(pivots: np.ndarray, kind: str, radius: np.ndarray, units: np.ndarray, blocks: int, r: float):
    """Each class to its own unit (all its blocks) and to the units it visits (one block)."""
    begin = np.concatenate(([0], np.cumsum(units)))
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    eps = 1e-6

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _unit(b.column("vector").to_pylist(), kind)
            d2 = np.maximum(0, 2 - 2 * x @ pivots.T)
            home = d2.argmin(axis=1)
            own = d2[np.arange(len(home)), home][:, None]
            cells = np.arange(len(pivots))
            go = ((cells < home[:, None]) & (np.sqrt(d2) <= radius + r + eps)
                  & (d2 - own <= 2 * (r + eps) * apart[home] + eps) & (units > 0))
            ids = b.column("id").to_numpy(zero_copy_only=False)
            salt = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
            part = (salt % units[home].astype(np.uint64)).astype(np.int64)
            row, unit, block, stay = [], [], [], []
            for i in range(len(ids)):
                u, z = begin[home[i]] + part[i], int(salt[i] % np.uint64(blocks))
                seen = [w for c in np.flatnonzero(go[i]) for w in range(begin[c], begin[c + 1])] + list(range(begin[home[i]], u))
                row += [i] * (blocks + len(seen))
                unit += [u] * blocks + seen
                block += [*range(blocks), *[z] * len(seen)]
                stay += [True] * blocks + [False] * len(seen)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit, pa.int32()), pa.array(block, pa.int32()), pa.array(stay, pa.bool_()),
                 *[b.column(c).take(at) for c in ("id", "n", "vector")]], ["unit", "block", "resident", "id", "n", "vector"])
    return run


def _join(kind: str, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        first = table.column("block")[0].as_py() == 0
        table = table.sort_by([("resident", "descending")])
        ids, n = (table.column(c).to_numpy() for c in ("id", "n"))
        x = _unit(table.column("vector").to_pylist(), kind)
        y, here = x.astype(np.float32), int(table.column("resident").to_numpy().sum())
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for a in range(0, here, _ROWS):
            z = min(a + _ROWS, here)
            lo = a if first else here  # residents meet residents in the first block only
            if lo >= len(ids):
                continue
            c = y[a:z] @ y[lo:].T
            hit = c >= cosine
            i, j = np.nonzero(np.abs(c - cosine) < SLACK)
            hit[i, j] = np.einsum("ij,ij->i", x[a + i], x[lo + j]) >= cosine
            if first:
                hit[:, :z - a] &= np.tri(z - a, dtype=bool).T
                hit[np.arange(z - a), np.arange(z - a)] = False
            some = np.flatnonzero(hit.any(axis=1))
            links[a + some] += hit[some] @ n[lo:]
            links[lo:] += n[a + some] @ hit[some]
            for k in some:
                near = lo + np.flatnonzero(hit[k])
                roots = np.unique(np.append(label[near], label[a + k]))
                if len(roots) > 1:
                    label[np.isin(label, roots)] = roots[0]
        root = ids.copy()
        np.minimum.at(root, label, ids)
        ok = links > 0
        return pa.table({"id": ids[ok], "links": links[ok], "root": root[label[ok]]})
    return run


def _pivots(classes: DataFrame, kind: str, count: int, r: float) -> np.ndarray:
    """At most ``count`` pivots out of a bounded hash-ordered sample, no two within 2r."""
    rows = classes.orderBy(F.xxhash64("id"), "id").limit(4 * count).select("vector").collect()  # bounded sample
    x, chosen = _unit([bytes(r0["vector"]) for r0 in rows], kind), []
    for v in x:
        if len(chosen) < count and (not chosen or float(np.max(np.array(chosen) @ v)) < 1 - 2 * r * r):
            chosen.append(v)
    return np.array(chosen)


def range_join(classes: DataFrame, kind: str, cosine: float) -> DataFrame:
    """``classes(id, n, vector)`` of one dimension -> ``(id, links, root)`` partial results of all tasks.

    ``links`` sums the sizes ``n`` of linked classes, ``root`` is a smallest id
    reachable inside the task.
    """
    r = math.sqrt(2 - 2 * cosine)
    total = classes.count()
    pivots = _pivots(classes, kind, min(PIVOTS, math.ceil(total / CELL)), r)
    cells = classes.select("vector").mapInArrow(_home(pivots, kind), "cell int, d double").groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("d").alias("d")).collect()  # one row for each pivot
    radius, units = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for c in cells:
        radius[c["cell"]], units[c["cell"]] = c["d"], math.ceil(c["n"] / UNIT)
    blocks = math.ceil(total / VISITORS)
    dealt = classes.select("id", "n", "vector").mapInArrow(_deal(pivots, kind, radius, units, blocks, r), _DEALT)
    return dealt.groupBy("unit", "block").applyInArrow(_join(kind, cosine), "id bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(vec_id, n_links, component_id, kept)``, one row per input row.

    Two rows link when their cosine, in double precision, is ``cosine`` or more;
    ``n_links`` counts other rows. ``component_id`` is the smallest vec_id
    reachable. Vectors that are null, empty, all zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Rows that
    repeat a vec_id are vectors of their own, in one component. A null vec_id
    links with nothing: component null, kept.
    """
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    v = v.select("vec_id", "embedding", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(7), "embedding").alias("h2"))
    fine = F.expr("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) "
                  "and exists(embedding, x -> x <> 0)")
    some = v.where("vec_id is not null").where(fine)
    grouped = some.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding"))
    sizes = [x[0] for x in some.select(F.size("embedding")).distinct().collect()]  # a handful of dimensions

    parts, classes = [], None
    for size in sorted(sizes):
        own = grouped.where(F.size("embedding") == size).mapInArrow(_pack(kind), "h1 bigint, h2 bigint, id bigint, n bigint, vector binary")
        own = stage(own, "classes")
        parts.append(stage(range_join(own, kind, cosine), "links"))
        own = own.select("h1", "h2", "id", "n")
        classes = own if classes is None else classes.union(own)
    if not parts:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).withColumn("kept", F.lit(True))

    joined = parts[0]
    for p in parts[1:]:
        joined = joined.union(p)
    found = stage(components(joined, "id", "root"), "components")
    links = joined.groupBy("id").agg(F.sum("links").alias("links"))
    facts = classes.join(links, "id", "left").join(found, "id", "left").select(
        F.col("h1").alias("c1"), F.col("h2").alias("c2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"))
    tagged = v.select("vec_id", "h1", "h2", (F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).alias("ok"))
    out = tagged.join(facts, tagged["ok"] & (tagged["h1"] == facts["c1"]) & (tagged["h2"] == facts["c2"]), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
