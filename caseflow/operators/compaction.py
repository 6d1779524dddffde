"""Event logs with compaction: a snapshot of the newest event of every key, and a tail (M1-M6).

Every append is a segment of its own. Compaction folds the segments that the snapshot lacks
into a versioned table; the commit that publishes the rows also lists the segments they came
from, so a reader either takes a segment from the snapshot or from the tail, never both and
never neither. Only then are the segments deleted: if a run dies in between, the next one
finishes. A withdrawn key stays in the snapshot as a tombstone, so that an event older than the
withdrawal, coming late, does not bring it back.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.sources.versioned import Commit, VersionedTable


@dataclass(frozen=True)
class CompactedLog:
    """``schema`` holds the keys, the values, the columns of ``order`` and a boolean ``deleted``."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    keys: Sequence[str]
    order: Sequence[str] = ("at", "seq")
    buckets: int = 64

    @property
    def base(self) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.folder.rstrip('/')}/base", self.schema, self.keys, self.buckets)

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), "segments", *parts]))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def append(self, events: DataFrame) -> None:
        """One more segment. Appending the same events again changes no state."""
        typed = events.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        typed.write.parquet(f"{self.folder.rstrip('/')}/segments/{uuid.uuid4().hex}")

    def segments(self) -> list[str]:
        """Segments whose writing has ended."""
        p, fs = self._path()
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(n for n in names if fs.exists(self._path(n, "_SUCCESS")[0]))

    def _events(self, segments: Sequence[str]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder.rstrip('/')}/segments/{s}" for s in segments])

    def state(self, tombstones: bool = False) -> DataFrame:
        """The newest event of every key. The tail alone is folded; the snapshot is joined to it by key.

        The snapshot's commit is taken before the segments are listed: one that a compaction
        folds in meanwhile is still read as tail, or else the read fails and can be repeated."""
        c = self.base.commit()
        names = self.schema.fieldNames()
        tail = self._events([s for s in self.segments() if s not in c.applied])
        tail = tail.groupBy(*self.keys).agg(F.max_by(F.struct(*names), F.struct(*self.order)).alias("_new")).select("_new")
        old = self.base.read(c.number).select(F.struct(*names).alias("_old"))
        on = F.lit(True)
        for k in self.keys:
            on &= F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}"))
        newer = F.struct(*[F.col(f"_new.{o}") for o in self.order]) > F.struct(*[F.col(f"_old.{o}") for o in self.order])
        row = F.when(F.col("_old").isNull() | (F.col("_new").isNotNull() & newer), F.col("_new")).otherwise(F.col("_old"))
        out = old.join(tail, on, "full_outer").select(row.alias("r")).select("r.*")
        return out if tombstones else out.where(~F.coalesce(F.col("deleted"), F.lit(False)))

    def fold(self) -> Commit:
        """First step of a compaction: the snapshot takes in the tail and says so."""
        last, here = self.base.commit(), self.segments()
        return self.base.merge(self._events([s for s in here if s not in last.applied]), order=self.order, applied={s: 1 for s in here})

    def sweep(self) -> int:
        """Second step: segments that the snapshot holds go; returns how many."""
        p, fs = self._path()
        done = [s for s in self.segments() if s in self.base.commit().applied]
        for s in done:
            fs.delete(self._path(s)[0], True)
        return len(done)

    def compact(self) -> Commit:
        c = self.fold()
        self.sweep()
        return c
