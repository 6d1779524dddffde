"""Incremental forms of ingest, gold, trend and state.

Every stream reuses the batch transforms (no second implementation), keeps its
checkpoint in the shared folder from ``spark.checkpoint.dir``, and writes
through ``foreachBatch`` into ``<sink>/epoch=<id>`` with overwrite, so a
re-played micro-batch after a failure replaces its own output instead of
duplicating it (exactly-once on a plain file sink).
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import checkpoint_dir
from caseflow.sources import files as FL
from caseflow.sources import landing as LD


def stream_dirs(spark: SparkSession, name: str, run_id: str | None = None) -> tuple[str, str]:
    """``(checkpoint, sink)`` folders for one stream under the shared folder."""
    base = os.path.join(checkpoint_dir(spark), "caseflow-streams", name, run_id or uuid.uuid4().hex)
    return os.path.join(base, "_checkpoint"), os.path.join(base, "sink")


def epoch_writer(sink: str, transform: Callable[[DataFrame], DataFrame] | None = None):
    """foreachBatch function: transform the micro-batch, overwrite its epoch folder."""
    def write(batch: DataFrame, epoch_id: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(os.path.join(sink, f"epoch={epoch_id}"))
    return write


def run_available_now(stream: DataFrame, checkpoint: str, sink: str,
                      transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything available, then stop (``trigger(availableNow)``)."""
    q = (stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
         .foreachBatch(epoch_writer(sink, transform)).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def read_sink(spark: SparkSession, sink: str, schema=None) -> DataFrame:
    """What a stream has written; with a ``schema`` empty if there was no micro-batch yet."""
    if schema is None:
        return spark.read.parquet(sink)
    try:
        return spark.read.schema(schema).parquet(sink)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream: as a pattern the path may be either."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


# --- T1: landing folder -> bronze, each file once ---------------------------------------

def ingest_stream(spark: SparkSession, folder: str, parser: FL.Parser = FL.text_parser,
                  glob: str = "*", run_id: str | None = None) -> DataFrame:
    """Incremental pickup of the documents landed in ``folder`` (:mod:`caseflow.sources.landing`):
    each published load is parsed once; a name landed again replaces its row."""
    ckpt, sink = stream_dirs(spark, "ingest", run_id)

    def parsed(batch: DataFrame) -> DataFrame:
        out = FL.with_reference(FL.parsed_text(FL.parse_documents(batch.select(F.col("name").alias("path"), "content"), parser)))
        return out

    run_available_now(LD.arriving(spark, folder, glob), ckpt, sink, parsed)
    rows = read_sink(spark, sink, "path string, case_ref string, parsed_text string, parse_error string, epoch bigint")
    names = ["case_ref", "parsed_text", "parse_error"]
    return rows.groupBy("path").agg(F.max_by(F.struct(*names), "epoch").alias("r")).select("path", "r.*")


# --- T2: incremental gold ----------------------------------------------------------------------

def gold_stream(spark: SparkSession, bronze_dir: str, schema, transform: Callable[[DataFrame], DataFrame],
                key: str = "case_ref", max_files: int = 100, run_id: str | None = None) -> DataFrame:
    """Each new bronze file is enriched once by ``transform`` and appended; the current
    gold is one row per key: of the file landed last, by ``(modification time, path, row)``. Rows
    without a key reach no gold; :func:`gold_rejects` returns them. A ``transform`` that passes the
    columns ``_mtime`` and ``_path`` on saves the join that otherwise brings them back."""
    ckpt, sink = stream_dirs(spark, "gold", run_id)
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(bronze_dir).select(
        "*", F.col("_metadata.file_modification_time").alias("_mtime"), F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.row_index").alias("_row"))

    def enrich(batch: DataFrame) -> DataFrame:
        order = F.struct("_mtime", "_path", "_row")
        newest = batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), order).alias("_r"))
        rows = newest.select(key, "_r.*").drop("_row")
        out = transform(rows)
        if {"_mtime", "_path"} <= set(out.columns):
            return out
        return out.join(rows.select(F.col(key).alias("_k"), "_mtime", "_path"), out[key] == F.col("_k")).drop("_k")

    def batch(rows: DataFrame, epoch: int) -> None:
        rejected = rows.where(F.col(key).isNull()).select(F.col("_path").alias("path"), F.col("_row").alias("row"), F.lit("no reference").alias("reason"))
        rejected.write.mode("overwrite").parquet(f"{sink}-rejects/epoch={epoch}")
        enrich(rows.where(F.col(key).isNotNull())).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    q = src.writeStream.option("checkpointLocation", ckpt).foreachBatch(batch).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(sink)
    names = [c for c in out.columns if c not in (key, "_mtime", "_path", "epoch")]
    return out.groupBy(key).agg(F.max_by(F.struct(*names), F.struct("_mtime", "_path", "epoch")).alias("_r")).select(key, "_r.*")


def gold_rejects(spark: SparkSession, run_id: str) -> DataFrame:
    """``(path, row, reason)`` of the bronze rows that a run of :func:`gold_stream` could not key."""
    _, sink = stream_dirs(spark, "gold", run_id)
    return read_sink(spark, f"{sink}-rejects", "path string, row bigint, reason string, epoch bigint").drop("epoch")


# --- T3: live flag / event trend -----------------------------------------------------------------

def trend_stream(spark: SparkSession, events: DataFrame, ts_col: str, key_col: str,
                 run_id: str | None = None) -> DataFrame:
    """Event-time counts per day and key of the stream ``events``.

    Each micro-batch appends its own partial counts, and reading sums them: no
    state is kept between batches, an event however late is counted on its day,
    and nothing written is ever overwritten."""
    ckpt, sink = stream_dirs(spark, "trend", run_id)
    day = F.date_format(F.col(ts_col), "yyyy-MM-dd")

    def counts(batch: DataFrame) -> DataFrame:
        return batch.groupBy(day.alias("day"), F.col(key_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))

    run_available_now(events, ckpt, sink, counts)
    kind = events.schema[key_col].dataType.simpleString()
    return read_sink(spark, sink, f"day string, key {kind}, n bigint, epoch bigint").groupBy("day", "key").agg(F.sum("n").alias("n"))


# --- T4: event log as a stream, fold on read ------------------------------------------------------

def event_log_stream(spark: SparkSession, events: DataFrame, id_col: str, run_id: str | None = None) -> DataFrame:
    """Append a streaming event log whole, late events too; replays are dropped on read by ``id_col``."""
    ckpt, sink = stream_dirs(spark, "events", run_id)
    run_available_now(events, ckpt, sink)
    return read_sink(spark, sink, T.StructType([*events.schema.fields, T.StructField("epoch", T.LongType())])).drop("epoch").dropDuplicates([id_col])
