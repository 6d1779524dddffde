"""Driver parquet tables and table-backed ingest modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table; projection and filters push into the scan."""
    if name not in DRIVER_TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: ``t = Tables(spark, d); t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in DRIVER_TABLES:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


# --- S3: parsed-text table -------------------------------------------------

def parsed_table(df: DataFrame, ref_col: str, text_col: str) -> DataFrame:
    """Adopt a table of already parsed documents as bronze."""
    return df.select(F.col(ref_col).cast("string").alias("case_ref"),
                     F.col(text_col).cast("string").alias("parsed_text"))


# --- S4/S5: adopt an existing record table ---------------------------------

# The six record columns whose text forms the narrative of an
# adopted record table, in their reference order.
NARRATIVE_COLUMNS = ("Case_Subject", "Case_Title", "Case_Description",
                     "Additional_Information", "Assistance_Required",
                     "Advice_Provided___Follow_up")


def narrative(cols=NARRATIVE_COLUMNS) -> Column:
    """Blank-joined narrative; NULL parts become empty strings (kept)."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols])


def adopt_case_table(df: DataFrame, required=("Case_Ref",) + NARRATIVE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Return ``(record, bronze)`` for an existing record table.

    Extra columns are allowed; missing required columns raise. Bronze text is
    the narrative of :data:`NARRATIVE_COLUMNS`.
    """
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"record table lacks columns: {missing}")
    bronze = df.select(F.col("Case_Ref").alias("case_ref"), narrative().alias("parsed_text"))
    return df, bronze


def ingest(spark: SparkSession, mode: str, *, path: str | None = None,
           source: DataFrame | None = None, ref_col: str = "case_ref",
           text_col: str = "parsed_text", parser=None) -> DataFrame:
    """One entry point for the three ingest modes, returning bronze."""
    if mode == "pdf" or mode == "files":
        if path is None:
            raise ValueError("file mode needs a path")
        if mode == "pdf" and parser is None:
            raise ValueError("pdf files need a parser: their bytes are not text")
        from caseflow.sources.files import bronze_from_files
        return bronze_from_files(spark, path, parser=parser, glob="*.pdf" if mode == "pdf" else "*")
    if source is None:
        raise ValueError(f"mode {mode!r} needs a source table")
    if mode == "parsed_table":
        return parsed_table(source, ref_col, text_col)
    if mode == "case_table":
        return adopt_case_table(source)[1]
    raise ValueError(f"unknown ingest mode {mode!r}")


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin ``df`` when its scan yields fewer partitions than the
    session's parallelism (small or single-file inputs), so CPU-heavy text
    work downstream uses every core. A no-op for large inputs, whose scans
    already split into many partitions; checking costs planning only."""
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
