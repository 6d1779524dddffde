"""Corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes every stage to the shared folder and hands the reread table on. All but
the last return the columns of ``documents``. Rows that repeat a doc_id are one
document: they stay or go together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import decontam, langid, line_dedup, minhash_forest, packing
from caseflow.llm.common import stage, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null or have no letter; fills a missing ``lang``. A text in several languages stays."""
    model = langid.train(docs)
    r = langid.identify(docs.select(*COLUMNS), model)
    if model:
        r = r.where(F.col("lang_pred") != langid.UNKNOWN)
    else:  # nothing to learn from: only texts without a letter are rejected
        r = r.where(F.col("text").rlike(r"\p{L}"))
    known = F.when(F.col("lang_pred") != langid.UNKNOWN, F.col("lang_pred"))
    return r.withColumn("lang", F.coalesce("lang", known)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document that loses all its lines goes."""
    r = line_dedup.line_dedup(docs).where("n_dropped = 0 or length(kept_text) > 0")
    text = F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return r.select("doc_id", text.alias("text"), "lang", "source",
                    F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group (five words, similarity 0.8)."""
    r = minhash_forest.near_duplicates(docs.select("doc_id", "text"))
    return docs.join(r.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark phrase."""
    r = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return r.where("not contaminated").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 2048 tokens."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("benchmark decontamination", decontaminated), ("best-fit packing", packed)]

#: Language ID and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row for each packed piece."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
