"""Current tables out of keyed streaming state, and flag counts by event time.

``latest_stream`` keeps the newest event of every key in a RocksDB state store
(``transformWithState``), by hash parts of the keys, so that Python is called for a part's rows and
not for each key. Only events that are newer than the state leave it, so late and
repeated events cost nothing further on, and what leaves is merged into a versioned table, once
for each micro-batch. State of keys that are quiet for long expires; the table then still refuses
older events, by the same order.

``flag_trend`` counts flags in event-time windows under a watermark. The watermark drops late
rows without a trace, so they are told apart first, by the same rule, and kept as corrections.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from caseflow.sources.versioned import VersionedTable
from caseflow.streaming.stream import read_sink, stream_dirs

#: State in RocksDB, for many keys. No batches without data: with processing time Spark would run them
#: without end, and expiry can wait for the next data.
_STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
               "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


@contextmanager
def state_conf(spark: SparkSession):
    """``_STATE_CONF`` for queries started inside; the session's own settings come back after."""
    before = {k: spark.conf.get(k, None) for k in _STATE_CONF}
    for k, v in _STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def micros(ts: str) -> Column:
    """Microseconds of a zoneless time, the same in every session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_EPOCH}, `{ts}`)")


def from_micros(us: str) -> Column:
    return F.expr(f"timestampadd(MICROSECOND, `{us}`, {_EPOCH})")


# --- T4: newest event of each key --------------------------------------------------------------------

PARTS = 1024  # hash parts of the keys: one state entry, and one call a micro-batch, for each that has rows
_HELD = pa.schema([("key", pa.string()), ("at", pa.int64()), ("seq", pa.int64()), ("payload", pa.string()), ("seen", pa.int64())])


def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """The newest row of each key; of equal ones the first."""
    return rows.sort_values(["at", "seq"], ascending=False, kind="stable").drop_duplicates("key")


class Newest(StatefulProcessor):
    """Keeps ``(key, at, seq, payload)`` of the keys of a part, as one Arrow table; emits a key's row when a newer
    event comes. A key that is not renewed for ``idle_ms`` is forgotten, with the next rows of its part or, by the
    time to live of the state store, with the whole part."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.state = handle.getValueState("newest", "keys binary", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self.state.get()
        best = (pa.ipc.open_stream(held[0]).read_all() if held else _HELD.empty_table()).to_pandas()
        best = best[best["seen"] + self.idle_ms > now].assign(new=False)
        for batch in rows:
            best = _newest(pd.concat([best, _newest(batch[["key", "at", "seq", "payload"]]).assign(seen=now, new=True)], ignore_index=True))
        out = best[best["new"].astype(bool)]
        if len(out):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _HELD) as w:
                w.write_table(pa.Table.from_pandas(best[_HELD.names], _HELD, preserve_index=False))
            self.state.update((sink.getvalue().to_pybytes(),))
            yield out[["key", "at", "seq", "payload"]]

    def close(self) -> None:
        """Nothing is held outside the state."""


IDLE_MS = 90 * 24 * 3600 * 1000


def latest_stream(events: DataFrame, table: VersionedTable, run_id: str, at: str = "at", seq: str = "seq",
                  idle_ms: int = IDLE_MS) -> VersionedTable:
    """Streams ``events`` (the table's columns; ``at`` timestamp_ntz, ``seq`` bigint) into ``table``: the newest row
    of each key by ``(at, seq)``, equal to the batch fold of all events so far after every micro-batch.

    ``run_id`` names the checkpoint; starting again under it goes on where the last run stopped. Events
    without ``at`` or ``seq`` have no place in the order and are left out."""
    spark, keys = events.sparkSession, list(table.keys)
    ckpt, _ = stream_dirs(spark, "latest", run_id)
    shape = T.StructType([f for f in table.schema.fields if f.name not in (at, seq)])
    src = events.where(F.col(at).isNotNull() & F.col(seq).isNotNull()).select(
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("key"), micros(at).alias("at"), F.col(seq).cast("long").alias("seq"),
        F.to_json(F.struct(*shape.fieldNames()), {"ignoreNullFields": "false"}).alias("payload"))
    newest = src.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS))).groupBy("part").transformWithStateInPandas(
        Newest(idle_ms), "key string, at bigint, seq bigint, payload string", "Update", "ProcessingTime")

    def merge(batch: DataFrame, epoch: int) -> None:
        rows = batch.select(F.from_json("payload", shape).alias("p"), "at", "seq")
        rows = rows.select("p.*", from_micros("at").alias(at), F.col("seq").alias(seq))
        table.merge(rows, order=[at, seq], batch=(run_id, epoch))

    with state_conf(spark):
        q = (newest.writeStream.outputMode("update").option("checkpointLocation", ckpt)
             .foreachBatch(merge).trigger(availableNow=True).start())
        q.awaitTermination()
    return table


# --- T3: flags by event-time window -------------------------------------------------------------------

DAY_US = 86_400_000_000


_ROW = "id string, flag string, ts timestamp, epoch bigint"
_MARK = "newest bigint, epoch bigint"
_CLOSED = "day timestamp, flag string, n bigint, epoch bigint"


def flag_trend(cases: DataFrame, run_id: str, delay_days: int = 31) -> DataFrame:
    """Streams ``cases(id, created timestamp_ntz, flags array)`` and returns ``(month, flag, n, n_late)`` of all so far.

    Days are windows that close when the newest time seen before a micro-batch is ``delay_days``
    past their end. A first query sends rows of open days on and keeps rows of closed days (and
    rows without a time) as late; the second drops repeats within the watermark, counts windows
    and appends each when it closes. Reading adds the days still open, from the rows sent on, and
    the late rows that are no repeats. ``delay_days`` is at least 1. The same ``id`` counts once a flag.
    """
    spark = cases.sparkSession
    ckpt, base = stream_dirs(spark, "flags", run_id)
    rows = cases.select(F.col("id").cast("string").alias("id"), F.explode("flags").alias("flag"), micros("created").alias("us"))
    delay = delay_days * DAY_US
    end = (F.floor(F.col("us") / DAY_US) + 1) * DAY_US

    def split(batch: DataFrame, epoch: int) -> None:
        newest = read_sink(spark, f"{base}/marks", _MARK).where(F.col("epoch") < epoch).agg(F.max("newest")).first()[0]
        late = F.col("us").isNull() | ((end <= newest - delay) if newest is not None else F.lit(False))
        stamped = batch.withColumn("ts", F.timestamp_micros("us"))
        for name, keep in (("open", ~late), ("late", late)):
            stamped.where(keep).select("id", "flag", "ts").write.mode("overwrite").parquet(f"{base}/{name}/epoch={epoch}")
        mark = batch.agg(F.greatest(F.max("us"), F.lit(newest)).alias("newest"))
        mark.write.mode("overwrite").parquet(f"{base}/marks/epoch={epoch}")

    q = rows.writeStream.option("checkpointLocation", f"{ckpt}-split").foreachBatch(split).trigger(availableNow=True).start()
    q.awaitTermination()
    if read_sink(spark, f"{base}/marks", _MARK).limit(1).count():
        opened = spark.readStream.schema(_ROW).parquet(f"{base}/open").drop("epoch")
        counts = (opened.withWatermark("ts", f"{delay_days} days").dropDuplicatesWithinWatermark(["id", "flag"])
                  .groupBy(F.window("ts", "1 day").alias("w"), "flag").agg(F.count(F.lit(1)).alias("n"))
                  .select(F.col("w.start").alias("day"), "flag", "n"))

        def close(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/closed/epoch={epoch}")

        with state_conf(spark):
            q = (counts.writeStream.outputMode("append").option("checkpointLocation", f"{ckpt}-count")
                 .foreachBatch(close).trigger(availableNow=True).start())
            q.awaitTermination()
    return trend_so_far(spark, base)


def trend_so_far(spark: SparkSession, base: str) -> DataFrame:
    """Closed windows, days still open and late corrections as one monthly trend."""
    closed, sent = read_sink(spark, f"{base}/closed", _CLOSED), read_sink(spark, f"{base}/open", _ROW)
    last = closed.agg(F.max("day")).first()[0]  # windows close in order, so all days up to it are closed
    still = sent if last is None else sent.where(F.col("ts") >= F.lit(last) + F.expr("INTERVAL 1 DAY"))
    late = read_sink(spark, f"{base}/late", _ROW).select("id", "flag", "ts").distinct()
    late = late.join(sent.select("id", "flag"), ["id", "flag"], "left_anti")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    parts = closed.select("day", "flag", "n", none.alias("late")).unionByName(
        still.select("id", "flag", "ts").distinct().select(F.col("ts").alias("day"), "flag", one.alias("n"), none.alias("late"))).unionByName(
        late.select(F.col("ts").alias("day"), "flag", one.alias("n"), one.alias("late")))
    utc = F.expr(f"timestampadd(MICROSECOND, unix_micros(day), {_EPOCH})")
    month = F.date_format(F.date_trunc("month", utc), "yyyy-MM-dd")
    return parts.groupBy(month.alias("month"), "flag").agg(F.sum("n").alias("n"), F.sum("late").alias("n_late"))
