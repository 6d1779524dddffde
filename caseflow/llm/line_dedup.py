"""Line dedup: range-partitioned line hashes, first occurrences, keep bitmaps.

Method. Every long line becomes ``(hash, document, position)``. The rows are
range-partitioned by hash with the document's salt as second key and sorted by
document and position inside a partition, so the first occurrence of a hash is
found by streaming over sorted runs; the runs of one hash (several when a hot
line was cut at a salt) merge by a min / max that combines on the map side. What
comes back to a document is not text but a run-length compressed bitmap of the
lines it keeps. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ascii_lower, shuffle_width, stage

#: Both ends of a line lose these: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
MIN_KEY = 10
SALTS = 64


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_lines(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Line numbers lost, for the documents that lose a line.

    ``docs(doc_id, text)`` -> ``(doc_id, version, gone)``, ``gone`` = sorted line
    numbers (from 0), ``version`` = hash of the text, which tells rows of one
    doc_id apart. Documents that keep all lines have no row.

    A key (line stripped of blanks, A-Z lower-cased) of at least ``min_key`` code
    points found in two or more documents stays only in the smallest doc_id
    holding it. Rows that repeat a doc_id are one document. A null text is one
    empty line; a row with a null doc_id takes no part and keeps all its lines.
    """
    width = shuffle_width(docs.sparkSession)
    d = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("version"),
                                                F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    d = d.select("doc_id", "version", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    d = d.where(F.length("key") >= min_key).select("doc_id", "version", "pos", ascii_lower(F.col("key")).alias("key"))
    lines = stage(d.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"),
                           "doc_id", "version", "pos"), "lines")

    runs = lines.select("h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt"), "doc_id", "pos")
    runs = runs.repartitionByRange(width, "h1", "h2", "salt")
    w = Window.partitionBy("h1", "h2", "salt").orderBy("doc_id", "pos")
    # one row for each document of a run: its first occurrence of the line
    first = runs.withColumn("before", F.lag("doc_id").over(w)).where("before is null or before <> doc_id")
    twice = (first.groupBy("h1", "h2").agg(F.min("doc_id").alias("holder"), F.max("doc_id").alias("last"))
             .where("holder < last").select("h1", "h2", "holder"))
    # staged, so that the join reads two plain exchanges and a hot line's rows can be split
    twice = stage(twice, "holders")

    dropped = lines.join(twice, ["h1", "h2"]).where("doc_id > holder").select("doc_id", "version", "pos")
    # identical rows repeat a position, so positions are a set
    return dropped.groupBy("doc_id", "version").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def keep_runs(gone: Column, n_lines: Column) -> Column:
    """Sorted dropped line numbers -> run-length bitmap [(start, length)] of kept lines."""
    edges = F.zip_with(F.concat(F.array(F.lit(-1)), gone), F.concat(gone, F.array(n_lines)),
                       lambda a, b: F.struct((a + 1).alias("start"), (b - a - 1).alias("length")))
    return F.filter(edges, lambda r: r["length"] > 0)


def line_dedup(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """``docs`` plus ``n_lines``, ``n_dropped``, ``keep`` (run-length bitmap) and ``kept_text``.

    One row per input row; all input columns are kept as they are, but for columns of
    the four names, which are replaced. Null or empty text: one empty line, kept text ''.
    Defined cases as in :func:`dropped_lines`.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "keep", "kept_text")]
    gone = dropped_lines(docs.select("doc_id", "text"), min_key).select(
        F.col("doc_id").alias("gone_doc"), F.col("version").alias("gone_version"), "gone")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("version"))
    j = d.join(gone, (F.col("row.doc_id") == F.col("gone_doc")) & (F.col("version") == F.col("gone_version")), "left")
    text = F.col("row.text")
    j = j.withColumn("lines", _lines(text)).withColumn("n_lines", F.size("lines"))
    j = j.withColumn("keep", F.when(F.col("gone").isNotNull(), keep_runs(F.col("gone"), F.col("n_lines"))))
    kept = F.array_join(F.flatten(F.transform("keep", lambda r: F.slice("lines", r["start"] + 1, r["length"]))), "\n")
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("n_lines").alias("length")))
    own = F.struct(F.col("n_lines").cast("long").alias("n_lines"),
                   F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
                   F.coalesce("keep", whole).alias("keep"),
                   F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(kept).alias("kept_text"))
    return j.select("row", own.alias("own")).select("row.*", "own.*")
