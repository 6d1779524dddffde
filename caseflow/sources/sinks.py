"""Table sinks (K1, K2, K4): overwrite, create-if-absent, append, all parquet.

Gold is partitioned by creation year so reads for a period prune whole
folders; everything goes to a path under a shared (cluster) location.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_created_year(df: DataFrame, created_col: str = "Created_On") -> DataFrame:
    return df.withColumn("created_year", F.year(F.try_to_date(F.col(created_col), "yyyy-MM-dd")))


def overwrite(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """K1: replace the table's contents (dynamic overwrite of written partitions off)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """K4: append rows (event logs are append-only)."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def create_if_absent(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """K2: an empty table with ``schema`` unless one exists; returns it.

    Only a missing path makes one: any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
        return spark.read.schema(schema).parquet(path)


def write_gold(gold: DataFrame, path: str) -> None:
    """Gold by creation year, sorted by reference inside each file; arrays and structs are stored as they are."""
    overwrite(with_created_year(gold).sortWithinPartitions("created_year", "Case_Ref"), path, ("created_year",))
