"""Keyed tables with versions, a change log and copy-on-write merges (K5, V4, M1-M6).

Rows lie in ``buckets`` by a hash of their key. A merge reads only the buckets that its keys fall
into, rewrites those whose rows really change, logs what changed, and is published
by one small manifest that names the folder of every bucket. Readers take a manifest, so
they see a commit whole or not at all, and every earlier commit stays readable.

    <folder>/data/<attempt>/bucket=<b>/    rows of a bucket as an attempt left them; ``change`` marks its inserts and updates
    <folder>/log/<attempt>/                the rows it replaced (before) and deleted; the change feed is both together
    <folder>/commits/<number>.json         a published commit

A large merge takes its buckets in passes, one after the other, so its shuffles need a part of the disk only.

An attempt that dies leaves folders that no manifest names. Manifests are published by a
rename that fails if the number is taken, so of two writers at once one gets an error.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence
from contextlib import nullcontext
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import shuffles_dropped, stored

CHANGES = ("insert", "update_before", "update_after", "delete")
PASSES, PASS_ROWS = 8, 250_000   # a merge takes up to so many passes, each of so many old and new rows at least
PART_ROWS = 50_000               # old and new rows of a file, about; a task has two of them on average


class Conflict(RuntimeError):
    """Another writer published the same commit first."""


@dataclass(frozen=True)
class Commit:
    number: int
    buckets: dict[str, str]  # bucket -> attempt whose folder holds it
    log: str | None          # attempt that wrote the changes; None if there are none
    counts: dict[str, int]
    applied: dict[str, int]  # source -> its last batch that is in the table


@dataclass(frozen=True)
class VersionedTable:
    """``keys`` identify a row; ``schema`` holds all columns. ``buckets`` is fixed when the table is made."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: Sequence[str]
    buckets: int = 64

    # --- manifests ------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._path("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def commit(self, version: int | None = None) -> Commit:
        """The manifest of a version (default: the newest; before the first commit an empty one)."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return Commit(0, {}, None, {}, {})
        if version not in known:
            raise ValueError(f"no version {version} of {self.folder}")
        p, fs = self._path("commits", f"{version:012d}.json")
        stream = fs.open(p)
        try:
            return Commit(**json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, c: Commit) -> None:
        p, fs = self._path("commits", f"{c.number:012d}.json")
        beside, _ = self._path("commits", f".{c.number:012d}.{uuid.uuid4().hex}")
        out = fs.create(beside)
        out.write(bytearray(json.dumps(c.__dict__).encode()))
        out.close()
        if fs.exists(p) or not fs.rename(beside, p):
            fs.delete(beside, False)
            raise Conflict(f"version {c.number} of {self.folder} is taken")

    # --- reading --------------------------------------------------------------------------------------

    def _rows(self, c: Commit, only: Sequence[int] | None = None) -> DataFrame:
        held = [(b, a) for b, a in c.buckets.items() if only is None or int(b) in only]
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder.rstrip('/')}/data/{a}/bucket={b}" for b, a in held])

    def read(self, version: int | None = None) -> DataFrame:
        """All rows as of a version."""
        return self._rows(self.commit(version))

    def lookup(self, *key) -> DataFrame:
        """The row of one key: reads its bucket."""
        one = self.spark.createDataFrame([key], T.StructType([self.schema[k] for k in self.keys]))
        bucket = one.select(self._bucket()).first()[0]
        same = F.lit(True)
        for k, v in zip(self.keys, key, strict=True):
            same &= F.col(k) == F.lit(v)
        return self._rows(self.commit(), [bucket]).where(same)

    def changes(self, after: int, upto: int | None = None) -> DataFrame:
        """The log of commits ``after`` < number <= ``upto``: ``commit``, ``change`` (one of ``CHANGES``) and the row."""
        logged = T.StructType([T.StructField("commit", T.LongType()), T.StructField("change", T.StringType()), *self.schema.fields])
        paths = []
        for c in map(self.commit, self.versions()):
            if c.log and after < c.number and (upto is None or c.number <= upto):
                p, fs = self._path("log", c.log)
                paths += [f"log/{c.log}"] * fs.exists(p) + [f"data/{a}/bucket={b}" for b, a in c.buckets.items() if a == c.log]
        if not paths:
            return self.spark.createDataFrame([], logged)
        return self.spark.read.schema(logged).parquet(*[f"{self.folder.rstrip('/')}/{p}" for p in paths]).where("change IS NOT NULL")

    # --- writing --------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def merge(self, rows: DataFrame, deleted: str | None = None, order: Sequence[str] = (),
              batch: tuple[str, int] | None = None, applied: dict[str, int] | None = None, again: bool = False) -> Commit:
        """Upserts ``rows``, one for each key; where the column ``deleted`` holds true, the key goes.

        With ``order`` (columns of the table) several rows of a key may come and an older row never
        replaces a newer one; without it a repeated key is an error. Rows equal to what is there change
        nothing. ``batch`` is ``(source, number)`` of a stream's batch: one that is in already is skipped.
        ``applied``, if given, is published with the commit in place of what it lists as applied.
        ``again`` says that ``rows`` come from stored tables alone and may be computed once a pass;
        otherwise they are computed once and stored meanwhile.
        """
        last = self.commit()
        if batch and last.applied.get(batch[0], -1) >= batch[1]:
            return last
        names = self.schema.fieldNames()
        gone = F.coalesce(F.col(deleted), F.lit(False)) if deleted else F.lit(False)
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], gone.alias("_gone"))
        if order:
            best = F.max_by(F.struct(*names, "_gone"), F.struct(*order))
            typed = typed.groupBy(*self.keys).agg(best.alias("_r")).select("_r.*")
        typed = typed.withColumn("_b", self._bucket())
        number, attempt = last.number + 1, uuid.uuid4().hex
        with shuffles_dropped(self.spark), nullcontext(typed) if again else stored(typed) as new:
            counts = self._write(last, new, order, number, attempt)
        changed = {b for b, change in counts if change}
        held = {b: a for b, a in last.buckets.items() if int(b) not in changed}
        held |= {str(b): attempt for b, change in counts if b in changed and change not in ("update_before", "delete")}
        of = {kind: sum(n for (_, c), n in counts.items() if c == change)
              for kind, change in (("insert", "insert"), ("update", "update_after"), ("delete", "delete"))}
        done = Commit(number, held, attempt if changed else None, {k: n for k, n in of.items() if n} | {"buckets": len(changed)},
                      (last.applied if applied is None else applied) | ({batch[0]: batch[1]} if batch else {}))
        self._publish(done)
        return done

    def _write(self, last: Commit, new: DataFrame, order: Sequence[str], number: int, attempt: str) -> dict[tuple[int, str | None], int]:
        """Writes the buckets that ``new`` changes and their log; returns rows by bucket and change (None: kept)."""
        seen = new.groupBy("_b", *self.keys).agg(F.count(F.lit(1)).alias("_n"))
        seen = seen.groupBy("_b").agg(F.max("_n"), F.sum("_n")).collect()  # a row for each bucket at most
        if not order and any(r[1] > 1 for r in seen):
            raise ValueError("a key comes more than once and no order is given")
        if not seen:
            return {}
        touched = sorted(r[0] for r in seen)
        n = sum(r[2] for r in seen) + self._rows(last, touched).count()
        passes = min(PASSES, len(touched), math.ceil(n / PASS_ROWS))
        parts = math.ceil(n / len(touched) / PART_ROWS)  # of a bucket
        for i in range(passes):
            some = touched[i::passes]
            tasks = max(parts * len(some) // 2, min(parts * len(some), self.spark.sparkContext.defaultParallelism))
            out = self._merged(self._rows(last, some), new.where(F.col("_b").isin(some)), order, parts, tasks)
            out = out.withColumn("commit", F.lit(number).cast("long")).sortWithinPartitions("bucket", *self.keys)
            out.write.mode("append").option("compression", "zstd").partitionBy("bucket").parquet(f"{self.folder.rstrip('/')}/data/{attempt}")
        wrote = self.spark.read.schema("change string, _b int").parquet(f"{self.folder.rstrip('/')}/data/{attempt}")
        counts = {(r[0], r[1]): r[2] for r in wrote.groupBy("_b", "change").count().collect()}  # four rows a bucket at most
        changed = {b for b, change in counts if change}
        for b in touched:
            if b not in changed:
                p, fs = self._path("data", attempt, f"bucket={b}")
                fs.delete(p, True)
        (was, fs), (log, _) = self._path("data", attempt, "bucket=-1"), self._path("log", attempt)
        if fs.exists(was):
            fs.mkdirs(log.getParent())
            if not fs.rename(was, log):
                raise OSError(f"the log of version {number} of {self.folder} was not put in place")
        return counts

    def _merged(self, old: DataFrame, new: DataFrame, order: Sequence[str], parts: int, tasks: int) -> DataFrame:
        """Rows as they are to be, and in bucket -1 those that they replace: ``change``, ``bucket``, true bucket ``_b``, columns."""
        names = self.schema.fieldNames()

        def tagged(df: DataFrame, is_new: bool) -> DataFrame:
            return df.select(F.struct(*names).alias("_row"), F.lit(is_new).alias("_is_new"), (F.col("_gone") if is_new else F.lit(False)).alias("_gone"),
                             self._bucket().alias("_b"), F.pmod(F.xxhash64(F.lit(parts), *self.keys), F.lit(parts)).alias("_part"),
                             F.struct(*self.keys).alias("_k"))

        both = tagged(old, False).unionByName(tagged(new, True)).repartition(tasks, "_b", "_part")  # a part stays whole
        of = lambda is_new: F.first(F.when(F.col("_is_new") == is_new, F.col("_row")), ignorenulls=True)
        j = both.groupBy("_b", "_part", "_k").agg(of(False).alias("_old"), of(True).alias("_new"), F.max("_gone").alias("_gone"))
        newer = F.lit(True)
        if order:
            newer = F.struct(*[F.col(f"_new.{c}") for c in order]) >= F.struct(*[F.col(f"_old.{c}") for c in order])
        kind = (F.when(F.col("_new").isNull(), F.lit("keep"))
                .when(F.col("_old").isNull(), F.when(F.col("_gone"), F.lit("none")).otherwise(F.lit("insert")))
                .when(~newer | (~F.col("_gone") & F.col("_old").eqNullSafe(F.col("_new"))), F.lit("keep"))
                .when(F.col("_gone"), F.lit("delete")).otherwise(F.lit("update")))
        j = j.select("_old", "_new", "_b", kind.alias("_kind")).where("_kind <> 'none'")

        def side(change: str | None, bucket: Column, row: str) -> Column:
            return F.struct(F.lit(change).cast("string").alias("change"), bucket.alias("bucket"), F.col(row).alias("row"))

        b, out = F.col("_b"), F.lit(-1)
        sides = (F.when(F.col("_kind") == "keep", F.array(side(None, b, "_old")))
                 .when(F.col("_kind") == "insert", F.array(side("insert", b, "_new")))
                 .when(F.col("_kind") == "delete", F.array(side("delete", out, "_old")))
                 .otherwise(F.array(side("update_before", out, "_old"), side("update_after", b, "_new"))))
        return j.select("_b", F.explode(sides).alias("_s")).select("_s.change", "_s.bucket", "_b", "_s.row.*")

    def replace(self, rows: DataFrame) -> Commit:
        """Makes ``rows`` the whole content: what differs is merged, keys that ``rows`` lacks go."""
        keys = list(self.keys)
        mark = [F.col(k).alias(f"_{k}") for k in keys]
        here, there = self.read().select(keys), rows.select(mark)
        same = F.lit(True)
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        lost = here.join(there, same, "left_anti").withColumn("_lost", F.lit(True))
        return self.merge(rows.withColumn("_lost", F.lit(False)).unionByName(lost, allowMissingColumns=True), deleted="_lost")
