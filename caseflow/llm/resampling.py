"""Importance resampling towards a target distribution, with exact ranks by regular sampling.

Method. A document's features are its runs of one to three words; a feature's bucket is
its CRC-32 modulo ``BUCKETS``. Counts of both tables by bucket give one array of gains
(logarithm of the target's smoothed share over the documents'), and a document's weight
is the sum of the array's entries over its features. Gumbel noise from a hash of the
doc_id makes the highest scores a draw without replacement in proportion to the weights'
exponentials. Ranks are exact by parallel sorting by regular sampling: every task writes
its rows as a sorted run, evenly spaced rows of all runs give the splitters, segments
between splitters are exchanged and each is put in order by itself, and the running sum of
the segments' counts turns places into ranks. A row's place in its run is the last sort key,
so no two rows are equal and ties never fill a segment. Only segments that hold drawn ranks
are exchanged.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import shuffle_width, stage
from caseflow.llm.hashing import by_bytes

BUCKETS = 10000
WORDS = 3  # most words of a feature
SEED = 42
PERCENT = 5
LEAST_WORDS = 20
SAMPLES = 1 << 16  # rows of all runs that choose the splitters, besides one for each run
PIECE = 1 << 20  # bytes of a text cut into words at a time

#: A-Z become a-z; bytes outside 0-9, a-z and 80-FF part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, about ``PIECE`` bytes at a time."""
    data, at = (text or "").encode().translate(_FOLD), 0
    while at < len(data):
        to = data.find(b" ", at + PIECE)
        to = len(data) if to < 0 else to
        if words := data[at:to].split():
            yield words
        at = to


def features(text: str | None) -> Iterator[tuple[int, np.ndarray]]:
    """(words, CRC-32 of every feature that ends in them), piece by piece; a feature's value continues that of the one a word shorter."""
    last: list[list[int]] = [[] for _ in range(WORDS)]  # of each length, the value that the word before ended
    for words in _pieces(text):
        spaced = [b" " + w for w in words]
        found = values = list(map(crc32, words))
        ends = [values[-1:]]
        for k in range(1, WORDS):
            before = last[k - 1] + values[:-1]
            values = list(map(crc32, spaced[len(spaced) - len(before):], before))
            ends.append(values[-1:] or last[k])
            found = found + values
        last = ends
        yield len(words), np.array(found, np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for b in by_bytes(batches):
        for text in b.column("text"):
            for _, f in features(text.as_py()):
                total += np.bincount(f % BUCKETS, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many features of ``texts(text)`` fall into each bucket; a task sends one row a bucket at most."""
    rows = texts.select("text").mapInArrow(_count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:  # BUCKETS rows at most
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all)))
                     for t, s in zip(target, source, strict=True)], np.int64)


def _score(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            out = np.zeros((4, b.num_rows), np.int64)
            for i, text in enumerate(b.column("text")):
                for words, f in features(text.as_py()):
                    out[:3, i] += words, len(f), gain[f % BUCKETS].sum()
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in b.column("h").to_pylist()]
            out[3] = out[2] + np.array(noise, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, out)], ["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def _key(score: int, doc_id, at: int) -> tuple:
    """Sort key: higher scores, then smaller doc_ids (null last), then the place in the runs."""
    return -score, doc_id is None, 0 if doc_id is None else doc_id, at


def _segments(splitters: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = zip(b.column("score").to_pylist(), b.column("doc_id").to_pylist(), b.column("at").to_pylist(), strict=True)
            yield b.append_column("segment", pa.array([bisect_right(splitters, _key(*k)) for k in keys], pa.int32()))
    return run


def ranked(runs: DataFrame, chosen, draw: int) -> DataFrame:
    """``runs(doc_id, score, at, ...)`` plus ``rank``: 1 to ``draw`` for the highest scores among ``chosen`` rows, else null.

    ``at`` tells rows apart and counts up from a multiple of 2^33 along each run, ``chosen`` rows first and in order."""
    rest = runs.where(~chosen).withColumn("rank", F.lit(None).cast("long"))
    rows = runs.where(chosen)
    n = rows.count()
    if not draw:
        return runs.withColumn("rank", F.lit(None).cast("long"))
    stride = max(1, n // SAMPLES)
    sample = rows.where(F.col("at").bitwiseAND((1 << 33) - 1) % stride == 0).select("score", "doc_id", "at").collect()
    sample = sorted(_key(*r) for r in sample)  # SAMPLES rows and one for each run at most
    parts = min(len(sample), SAMPLES // 4, -(-shuffle_width(runs.sparkSession) * n // draw))
    splitters = [sample[len(sample) * i // parts] for i in range(1, parts)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    rows = stage(rows.mapInArrow(_segments(splitters), f"{kinds}, segment int"), "resample-segments")
    before, offsets = 0, []
    for segment, count in sorted(rows.groupBy("segment").count().collect()):  # a row for each segment
        offsets.append((segment, before))
        before += count
    offsets = [x for x in offsets if x[1] < draw]
    last = offsets[-1][0]
    starts = runs.sparkSession.createDataFrame(offsets, "segment int, before bigint")
    w = Window.partitionBy("segment").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "at")
    top = rows.where(F.col("segment") <= last).withColumn("place", F.row_number().over(w))
    top = top.join(F.broadcast(starts), "segment").withColumn("rank", F.col("place") + F.col("before"))
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    names = [*runs.columns, "rank"]
    low = rows.where(F.col("segment") > last).withColumn("rank", F.lit(None).cast("long"))
    return top.select(*names).union(low.select(*names)).union(rest.select(*names))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             seed: int = SEED) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_words, n_features, weight, score, rank)``.

    ``target(text)`` shows the distribution to draw towards. Of the documents with at least
    ``least_words`` words, ``percent`` in a hundred (rounded down) get ranks 1, 2, 3, ... by
    falling score, ties by smaller doc_id; all others have a null rank. A null or empty text
    has no feature and weight 0, so its score is its noise. Null doc_ids share one hash (of
    ``<seed>:``) and come last among ties; a repeated doc_id is as many documents. An empty
    ``target`` leaves smoothing only; an empty ``docs`` gives no row. Every feature of whole
    texts is counted. Other input columns are not read or returned, whatever their names.
    """
    gain = gains(bucket_counts(target), bucket_counts(docs))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", h.alias("h")).mapInArrow(
        _score(gain), f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint, score bigint")
    chosen = F.col("n_words") >= least_words
    runs = rows.sortWithinPartitions(chosen.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    runs = stage(runs.withColumn("at", F.monotonically_increasing_id()), "resample-runs")
    draw = percent * runs.where(chosen).count() // 100
    return ranked(runs, chosen, draw).drop("at")
