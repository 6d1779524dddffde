"""Best-two-fit packing of tokenised documents into fixed-size sequences.

Method. A bin is filled greedily, always with the longest piece that fits; then
its smallest piece is replaced by two unpacked pieces if the two fill the
expanded gap more tightly, again and again while that helps. Bins are planned on
the histogram of piece lengths, at most ``capacity`` rows whatever the input:
equal bins are planned once with a multiplicity, and a plan leaves fewer pieces
of some length than a bin takes, so the next plan differs and a length that a
bin takes ``u`` times is used up within a logarithm of ``u`` plans. Each piece then finds its place from its
length and its rank among the pieces of that length. Ranks come from a window
over ``(length, bucket)`` with hashed buckets and the buckets' running counts,
so one very common length is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import shuffle_width, stage
from caseflow.llm.tokens import SLICE, WordEncoder, slices

CAPACITY = 2048
END_ID = 0


def _cut(path: str | None, capacity: int, end_id: int, with_ids: bool = True):
    """Cut texts into pieces; the ids leave Python themselves or as their checksum alone."""
    def run(batches):
        end = np.array([end_id], "<u4").tobytes()
        enc = WordEncoder(path, ids=True)
        for b in slices(batches, 4 * SLICE):
            rows = []
            for i, parts in enumerate(enc(b.column("text").to_pylist())):
                ids = b"".join(parts) + end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * s:4 * e]
                    rows.append((i, k, s, e - s, zlib.crc32(part), part if with_ids else None))
            i, piece, start, length, crc, ids = zip(*rows, strict=True) if rows else ((),) * 6
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(i, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])
    return run


def cut_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
               with_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, piece, start, length, ids_crc32[, ids])``.

    A document's ids (no special tokens added) end with ``end_id``; a document
    of more than ``capacity`` ids is cut, only its first piece may be shorter.
    ``ids`` is little-endian unsigned 32-bit binary, ``ids_crc32`` its checksum. Null or empty text: one
    piece holding the end id. Null and repeated doc_ids are packed like others.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    kinds = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if with_ids else "")
    return d.mapInArrow(_cut(path, capacity, end_id, with_ids), kinds)


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Length histogram -> bins as ``(multiplicity, lengths)``, lengths in falling order."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    sizes, plans = np.arange(capacity + 1), []
    while left.any():
        free = left.copy()
        at_most = np.maximum.accumulate(np.where(free > 0, sizes, 0))  # longest free length up to a size

        def take(length):
            free[length] -= 1
            if not free[length]:
                at_most[:] = np.maximum.accumulate(np.where(free > 0, sizes, 0))

        gap, bin_ = capacity, []
        while best := int(at_most[gap]):
            bin_.append(best)
            gap -= best
            take(best)
        while gap:
            small = min(bin_)
            room = gap + small
            a = sizes[1:room]
            a = a[free[1:room] > 0]
            b = at_most[np.minimum(a, room - a)]
            b = np.where((b == a) & (free[b] < 2), at_most[np.maximum(a - 1, 0)], b)
            both = np.where(b > 0, a + b, 0)
            if not both.size or both.max() <= small:
                break
            k = int(both.argmax())
            bin_.remove(small)
            free[small] += 1
            bin_ += [int(a[k]), int(b[k])]
            free[a[k]] -= 1
            free[b[k]] -= 1
            at_most = np.maximum.accumulate(np.where(free > 0, sizes, 0))
            gap = room - int(both[k])
        lengths, uses = np.unique(bin_, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        plans.append((times, sorted(bin_, reverse=True)))
    return plans


def _places(plans: list[tuple[int, list[int]]]) -> np.ndarray:
    """Plan -> rows (length, first rank, uses in a bin, first sequence, offset), by length and rank."""
    rows, rank, sequence = [], {}, 0
    for times, lengths in plans:
        offset = 0
        for length in dict.fromkeys(lengths):
            uses = lengths.count(length)
            rows.append((length, rank.get(length, 0), uses, sequence, offset))
            rank[length] = rank.get(length, 0) + times * uses
            offset += uses * length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces(doc_id, piece, start, length, ...)`` plus ``sequence_id`` and ``offset``.

    Every length is from 1 to ``capacity``. Sequences are filled from offset 0
    without gaps. ``pieces`` is read twice, so pass a staged table. No row in, no
    row out.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    p = pieces.select(*names)
    counts = {r["length"]: r["n"] for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity rows at most
    places = p.sparkSession.sparkContext.broadcast(_places(plan_bins(counts, capacity)))

    width = shuffle_width(p.sparkSession)
    p = p.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(width)))
    sums = p.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("length", "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    w = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start")
    ranked = p.withColumn("_n", F.row_number().over(w)).join(sums, ["length", "_bucket"])
    ranked = ranked.select(*names, (F.col("_before") + F.col("_n") - 1).alias("_rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = places.value
        key = t[:, 0] << 48 | t[:, 1]
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = t[np.searchsorted(key, length.astype(np.int64) << 48 | rank, side="right") - 1] if len(t) else t
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in names], pa.array(at[:, 3] + nth // at[:, 2]), pa.array(at[:, 4] + nth % at[:, 2] * length)],
                [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in p.select(*names).dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: ``(doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset)``."""
    return pack(stage(cut_pieces(docs, path, capacity, with_ids=with_ids), "pieces"), capacity)
