"""Substring dedup by fixed-block anchors.

Method. Every document's non-overlapping blocks of ``(window + 1) // 2`` words are
the index; every rolling window of that many words probes it. A run of
``window`` repeated words always holds a whole block of its other copy, so each
repeat leaves a hit on both sides. Hits are then extended: the ``window``-word
windows around them are compared across documents, and consecutive windows that
an earlier document also has make up the maximal exact repeats.

Both comparisons move sorted, delta-coded hash lists instead of rows: a task
turns some megabytes of text into one compressed list for each range of hashes,
and a range is matched where its lists meet. Memory there is bounded by the
number of ranges, which follows the size of the text. What a batch can settle
alone stays there: a very common block leaves it as two entries, a very common
window as one, and nothing is ever paired up.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import bounded, shuffle_width, stage
from caseflow.llm.hashing import U, by_bytes, window_hashes, word_hashes, word_spans

WINDOW = 13
BATCH = 8 << 20           # bytes of text in a list
RANGE_BYTES = 16 << 20    # bytes of text for each range of hashes

def _squeeze(a: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes with their number in front."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return len(a).to_bytes(8, "little") + bytes([a.itemsize]) + (pa.compress(planes, "zstd", asbytes=True) if len(a) else b"")


def _unsqueeze(b: bytes) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), b[8]
    if not n:
        return np.zeros(0, f"<u{size}")
    planes = np.frombuffer(pa.decompress(b[9:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(n)


def _deltas(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


_LISTS = "range int, docs binary, versions binary, hashes binary, marks binary"
_LIST_NAMES = ["range", "docs", "versions", "hashes", "marks"]


def _lists(hashes: np.ndarray, marks: np.ndarray, docs: np.ndarray, versions: np.ndarray, bits: int, ranges: int, fold):
    """One row for each range of hashes: sorted hashes as deltas, their marks, and the batch's documents.

    ``fold`` settles what the batch can settle alone, so that a very common hash
    leaves a batch as one or two entries; what it found is one more row (no marks)."""
    order = np.argsort(hashes, kind="stable")
    hashes, marks = hashes[order], marks[order]
    place = (marks >> U(32)).astype(np.int64)
    rows = []
    if len(hashes):
        keep, marks, found, values = fold(hashes, marks, docs[place])
        i = np.flatnonzero(found)
        i = i[np.argsort(place[i], kind="stable")]
        if len(i):
            rows.append((int(order.sum() + versions.view(np.uint64).sum() % U(1 << 31)) % ranges, _squeeze(docs[place[i]].view(np.uint64)),
                         _squeeze(versions[place[i]].view(np.uint64)), _squeeze(values[i]), None))
        hashes, marks = hashes[keep], marks[keep]
    cuts = np.array([-(-(r << bits) // ranges) for r in range(ranges)], np.uint64)
    at = np.searchsorted(hashes, cuts).tolist() + [len(hashes)]
    d, v = _squeeze(_deltas(docs.view(np.uint64))), _squeeze(versions.view(np.uint64))
    rows += [(r, d, v, _squeeze(_deltas(hashes[a:b])), _squeeze(marks[a:b]))
             for r, (a, b) in enumerate(zip(at, at[1:], strict=False)) if b > a]
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], _LIST_NAMES)


def _groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each group of equal hashes begins, its size)."""
    at = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
    return at, np.diff(np.append(at, len(hashes)))


def _met(match, buckets: int):
    """All lists of a range, matched by ``match(hashes, marks, documents)`` -> (found, values), with what batches found alone."""
    def run(table: pa.Table) -> pa.Table:
        parts, done = [], []
        for r in table.to_pylist():
            docs, versions = _unsqueeze(r["docs"]), _unsqueeze(r["versions"]).view(np.int64)
            if r["marks"] is None:
                done.append((docs.view(np.int64), versions, _unsqueeze(r["hashes"])))
                continue
            docs, marks = np.cumsum(docs, dtype=np.uint64).view(np.int64), _unsqueeze(r["marks"])
            i = (marks >> U(32)).astype(np.int64)
            parts.append((np.cumsum(_unsqueeze(r["hashes"]), dtype=np.uint64), marks, docs[i], versions[i]))
        if parts:
            hashes, marks, docs, versions = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(hashes, kind="stable")
            hashes, marks, docs, versions = hashes[order], marks[order], docs[order], versions[order]
            found, values = match(hashes, marks, docs)
            done.append((docs[found], versions[found], values[found]))
        return _returned(*(np.concatenate(x) for x in zip(*done, strict=True)), buckets)
    return run


_RETURNED = "bucket int, docs binary, versions binary, found binary"
_FOUND = "doc_id bigint, version bigint, found binary"


def _sorted(docs, versions, values):
    order = np.lexsort((values, versions, docs))
    return docs[order], versions[order], values[order]


def _returned(docs, versions, values, buckets: int) -> pa.Table:
    """What was found, on its way back: one row for each bucket of documents, not for each document."""
    bucket = (docs.view(np.uint64) * U(0x9E3779B97F4A7C15) >> U(33)) % U(buckets)
    rows = []
    for k in np.unique(bucket):
        d, v, x = _sorted(*(y[bucket == k] for y in (docs, versions, values)))
        rows.append((int(k), _squeeze(_deltas(d.view(np.uint64))), _squeeze(_deltas(v.view(np.uint64))), _squeeze(_deltas(x))))
    cols = list(zip(*rows, strict=True)) if rows else [()] * 4
    return pa.table({"bucket": pa.array(cols[0], pa.int32()), **{
        name: pa.array(c, pa.binary()) for name, c in zip(("docs", "versions", "found"), cols[1:], strict=True)}})


def _gather(table: pa.Table) -> pa.Table:
    """A bucket's rows -> one row for each document, its values sorted and distinct (as 64-bit integers)."""
    parts = [[np.cumsum(_unsqueeze(r[c]), dtype=np.uint64) for c in ("docs", "versions", "found")] for r in table.to_pylist()]
    docs, versions, values = _sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    same = np.zeros(len(docs), bool)
    same[1:] = (docs[1:] == docs[:-1]) & (versions[1:] == versions[:-1])
    keep = np.ones(len(docs), bool)
    keep[1:] = ~same[1:] | (values[1:] != values[:-1])
    docs, versions, values, same = docs[keep], versions[keep], values[keep], same[keep]
    at = np.flatnonzero(~same)
    found = [values[a:b].tobytes() for a, b in zip(at, [*at[1:], len(docs)], strict=False)]
    return pa.table({"doc_id": docs[at].view(np.int64), "version": versions[at].view(np.int64), "found": pa.array(found, pa.binary())})


def _back(lists: DataFrame, match, buckets: int) -> DataFrame:
    """Lists -> ``(doc_id, version, found)``: matched by range of hashes, gathered by document."""
    found = lists.groupBy("range").applyInArrow(_met(match, buckets), _RETURNED)
    return found.groupBy("bucket").applyInArrow(_gather, _FOUND)


_LOW = U(0xFFFFFFFF)


def _shared(hashes, marks, docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(groups that are an index block somewhere and lie in two documents, by entry; first; size of each group)."""
    at, n = _groups(hashes)
    hit = ((np.bitwise_or.reduceat(marks, at) & U(1)).astype(bool)
           & (np.minimum.reduceat(docs, at) != np.maximum.reduceat(docs, at)))
    return np.repeat(hit, n), at, n


def _fold_shared(hashes, marks, docs):
    """Shared within the batch: all found here; one entry of the smallest and one of the largest document go on, as blocks."""
    hit, at, n = _shared(hashes, marks, docs)
    ends = (docs == np.repeat(np.minimum.reduceat(docs, at), n)) | (docs == np.repeat(np.maximum.reduceat(docs, at), n))
    again = np.zeros(len(docs), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    return ~hit | ends & ~again, np.where(hit, marks | U(1), marks), hit, hashes


def _smallest(hashes, docs) -> np.ndarray:
    at, n = _groups(hashes)
    return np.repeat(np.minimum.reduceat(docs, at), n)


def _fold_repeats(hashes, marks, docs):
    """Windows that a smaller document of the batch has are found here; those of the smallest go on."""
    gone = docs > _smallest(hashes, docs)
    return ~gone, marks, gone, marks & _LOW


def _probe_lists(block: int, bits: int, ranges: int):
    """Text batches -> lists of rolling block hashes; mark = document's place << 32 | 1 if an index block."""
    def run(batches):
        for b in by_bytes(batches, most=BATCH):
            words, first = word_hashes(b.column("text"))
            h = window_hashes(words, block) >> U(64 - bits)
            size = np.diff(first)
            doc = np.repeat(np.arange(b.num_rows), size)[:len(h)]
            pos = np.arange(len(h)) - first[doc]
            ok = pos + block <= size[doc]
            mark = doc.astype(np.uint64) << U(32) | (pos % block == 0).astype(np.uint64)
            docs, versions = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            yield _lists(h[ok], mark[ok], docs, versions, bits, ranges, _fold_shared)
    return run


def _shared_blocks(hashes, marks, docs):
    """Hashes that are an index block somewhere and occur in two documents, for each of their documents."""
    return _shared(hashes, marks, docs)[0], hashes


def _window_lists(window: int, block: int, bits: int, ranges: int):
    """Documents with hits -> lists of the windows around each hit; mark = place << 32 | first word."""
    def run(batches):
        for b in by_bytes(batches, most=BATCH):
            words, first = word_hashes(b.column("text"))
            h, size = window_hashes(words, block) >> U(64 - bits), np.diff(first)
            full, near = window_hashes(words, window), np.zeros(len(words) + 1, np.int64)
            for i, found in enumerate(b.column("found").to_pylist()):
                n = int(size[i]) - window + 1
                if n < 1 or not found:
                    continue
                f = int(first[i])
                hit = np.flatnonzero(np.isin(h[f:f + size[i] - block + 1], np.frombuffer(found, "<u8")))
                # a hit at p lies in the windows that begin at p - (window - block) .. p
                np.add.at(near, f + np.clip(hit - (window - block), 0, n), 1)
                np.add.at(near, f + np.clip(hit + 1, 0, n), -1)
            take = np.flatnonzero(np.cumsum(near[:len(full)]) > 0)
            doc = np.searchsorted(first, take, side="right") - 1
            mark = doc.astype(np.uint64) << U(32) | (take - first[doc]).astype(np.uint64)
            docs, versions = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "version"))
            yield _lists(full[take], mark, docs, versions, 64, ranges, _fold_repeats)
    return run


def _repeats(hashes, marks, docs):
    """First words of windows that a document with a smaller id also has, for each document."""
    return docs > _smallest(hashes, docs), marks & _LOW


def _remove(window: int):
    def run(batches):
        for b in by_bytes(batches, most=BATCH):
            data, starts, ends, first = word_spans(b.column("text"))
            data = data.tobytes()
            kept, spans, gone = [], [], []
            for i, found in enumerate(b.column("found").to_pylist()):
                words = data[starts[first[i]]:ends[first[i + 1] - 1]].split() if first[i + 1] > first[i] else []
                runs = []
                if found:
                    s = np.frombuffer(found, "<u8").astype(np.int64)
                    cut = np.flatnonzero(np.diff(s) > window)
                    runs = list(zip(s[np.append(0, cut + 1)].tolist(), (s[np.append(cut, len(s) - 1)] + window).tolist(), strict=True))
                    edges = [0, *[x for r in runs for x in r], len(words)]
                    words = [w for a, z in zip(edges[::2], edges[1::2], strict=True) for w in words[a:z]]
                kept.append(b" ".join(words).decode())
                spans.append([{"start": a, "end": z} for a, z in runs])
                gone.append(sum(z - a for a, z in runs))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(first), pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_removed, removed, kept_text)``, one row per input row.

    Words are split at blanks and compared as they are. A word goes if a window
    of ``window`` consecutive words covers it whose word sequence also occurs in
    a document with a smaller doc_id. ``removed`` = maximal removed runs
    ``(start, end)`` in words, end excluded; ``kept_text`` = kept words joined by
    one space. Null or empty text: no words, kept ''. Rows that repeat a doc_id
    are one document. A row with a null doc_id is compared with nothing.
    """
    spark = docs.sparkSession
    block, width = (window + 1) // 2, shuffle_width(spark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # rows of one doc_id are told apart by their texts; without any, lists need not carry that
    twice = d.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    d = d.withColumn("version", F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text"))
    known = d.where("doc_id is not null")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(2 * width, math.ceil(size / RANGE_BYTES))
    bits = min(64, 16 + max(16, math.ceil(math.log2(size + 2)) - 2))  # odds of a chance hit stay near 2^-16

    buckets = max(1, ranges // 3)  # of documents, on the way back

    probes = known.mapInArrow(_probe_lists(block, bits, ranges), _LISTS)
    hits = stage(_back(probes, _shared_blocks, buckets), "anchors")

    some = known.join(bounded(hits.select("doc_id").distinct()), "doc_id", "left_semi").join(hits, ["doc_id", "version"])
    lists = some.select("doc_id", "version", "text", "found").mapInArrow(_window_lists(window, block, bits, ranges), _LISTS)
    gone = stage(_back(lists, _repeats, buckets), "repeats")

    final = d.join(gone, ["doc_id", "version"], "left").select("doc_id", "text", "found")
    return final.mapInArrow(_remove(window), "doc_id bigint, n_words bigint, n_removed bigint, "
                            "removed array<struct<start:int,end:int>>, kept_text string")
