"""Session construction and lineage-cut helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Session settings every caseflow job relies on: UTC so that timestamp_ntz
# formatting is stable, AQE for runtime coalescing and skew splitting, Arrow for
# the few Python plug points, and no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Starting points for a large cluster (about 100 TB input, ~1000 executors),
# passed with ``spark-submit --conf`` or ``build_session(extra=CLUSTER_CONF)``:
# many initial shuffle partitions that AQE coalesces to ~256 MB each, scan
# splits of 256 MB, skew splitting at 3x the median, and a broadcast ceiling
# that Spark checks against measured sizes.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "16000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "caseflow", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the caseflow defaults.

    Under ``spark-submit`` (``spark.master`` already set) the cluster's master
    and shuffle sizing are kept: AQE coalesces the cluster's initial shuffle
    partitions to the data. Without a master (tests, bench) the session is
    ``local[$CASEFLOW_CPUS or 8]`` with one shuffle partition per core.
    """
    from pyspark import SparkConf

    cpus = os.environ.get("CASEFLOW_CPUS", "8")
    submitted = SparkConf().contains("spark.master")
    builder = SparkSession.builder.appName(app_name)
    if master or not submitted:
        builder = builder.master(master or f"local[{cpus}]")
    conf = dict(BASE_CONF)
    if shuffle_partitions or not submitted:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    Reads ``spark.checkpoint.dir`` from the session. Only a local-mode session
    (tests) without that setting gets a private temporary folder; a cluster job
    without a shared folder is refused, since a machine-local folder would not
    survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - key absent
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    local = tempfile.mkdtemp(prefix="caseflow-ckpt-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder.

    Used right after every model call so a lost executor never re-runs the
    model, and so later projections cannot evaluate the call twice.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def stored(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` computed once and read from compressed columns in the shared folder, which go when the block ends."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Each action inside drops its shuffle files when it ends; else they stay until the driver collects its garbage.

    A frame that shuffles is to be run once inside, or else it shuffles again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, was)
