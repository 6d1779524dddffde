"""Helpers shared by the operators: staged tables, ASCII folding, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor sees, so a lost executor costs
    only its running tasks, and nothing upstream is computed twice.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else; the fast built-in serves pure ASCII strings."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_sample(rows: DataFrame, by: str, n: int | Column) -> DataFrame:
    """The ``n`` rows of each value of ``by`` whose doc_id hashes lowest, for any order of the rows
    (``n`` may be a column that depends on ``by``).

    Chosen first within 64 salts of a value, then among those, so that one very
    common value is not ranked in one task."""
    h = F.xxhash64("doc_id")
    out = rows.withColumn("_h", h).withColumn("_s", F.pmod(h, F.lit(64)))
    for keys in ([by, "_s"], [by]):
        w = Window.partitionBy(*keys).orderBy("_h", "doc_id")
        out = out.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
    return out.drop("_h", "_s")


def in_order(df: DataFrame, order: list[str], sums: dict[str, str], name: str) -> DataFrame:
    """``df`` in the order of the columns ``order``, with a running sum of the rows before for
    each ``new column -> summed column`` of ``sums``; staged.

    Rows are cut into ranges of the whole order, so a value that many rows share is cut too
    if a later column tells them apart; the ranges' sums (one row each) give what lies before.
    """
    cut = df.repartitionByRange(shuffle_width(df.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    cut = stage(cut, f"{name}-ranges")
    ranges = cut.groupBy("_range").agg(*[F.sum(c).alias(c) for c in set(sums.values())])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{new}") for new, c in sums.items()])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = cut.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(new) for new, c in sums.items()])
    rows = rows.join(F.broadcast(ranges), "_range")  # a row for each shuffle partition at most
    return stage(rows.select(*df.columns, *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums]), name)


#: Broadcast bound: tables of so many rows at most (8 to 40 bytes each) are broadcast, others joined by shuffle.
MAX_BROADCAST_ROWS = 200_000


def bounded(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the undirected graph ``edges(a, b)``: (id, component_id).

    ``component_id`` is the smallest id reachable. Nodes without an edge are not
    returned; null ends and loops are ignored. Alternates large-star and
    small-star rewrites (each node sends its larger, then its smaller neighbours
    to its smallest one) until the edges stop changing: a logarithmic number of
    rounds, each a group-by with map-side combine and a join, staged in the
    shared folder. A hub's neighbour list is never gathered: the minimum is an
    aggregate, and the join back is an equi-join that adaptive execution splits.
    """
    e = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
         .where("u is not null and v is not null and u <> v")
         .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    e = stage(e, "cc-edges")
    last = None
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a hub's neighbours all meet here; its minimum is staged, so that the join reads two
        # plain exchanges and adaptive execution can split the hub's rows
        low = stage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star over the rewritten edges (u > v): u and its few smaller neighbours point at the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = stage(small, "cc-round")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    leaves = e.select(F.col("u").alias("id"), F.col("v").alias("component_id"))
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct()
    return leaves.union(roots)
