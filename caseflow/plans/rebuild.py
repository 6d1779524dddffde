"""Ordered rebuild of every derived table from bronze, as one function.

bronze -> both model stages (staged once) -> gold -> scrubbed case chunks and
procedure chunks -> embeddings -> accuracy -> rejects. Every table is written
under ``out_dir`` and read back; a table that is already complete there is not
built again, so a rebuild that broke off restarts from what it had written, and
a lost executor never repeats a model call.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import record as R
from caseflow.functions import text as X
from caseflow.operators import analytics as A
from caseflow.operators import extract as E
from caseflow.operators import governance as G
from caseflow.operators import search as SE
from caseflow.operators.gold import assert_unique_keys, build_gold_staged
from caseflow.sources import files as FL
from caseflow.sources import sinks


@dataclass
class Rebuilt:
    gold: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    extraction_status: DataFrame
    rejects: DataFrame
    accuracy: DataFrame
    procedure_chunks: DataFrame | None = None
    procedure_embeddings: DataFrame | None = None


def _complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end (``_SUCCESS``), in any file system Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def rebuild(spark: SparkSession, bronze: DataFrame, out_dir: str, *,
            l1_model: E.ModelFn = E.offline_model, l2_model: E.ModelFn | None = None,
            procedures: DataFrame | None = None, case_type_source: str = "subject", check_keys: bool = True) -> Rebuilt:
    """Rebuild every derived table under ``out_dir`` from bronze
    ``(case_ref, parsed_text[, path, parse_error])``.

    ``l2_model=None`` uses the evidence-only rule tagger (no Python); a model
    goes through the same once-only call as layer 1. ``procedures(path,
    parsed_text)`` are parsed procedure files. ``case_type_source`` says whether a
    record's type is read from the ``subject`` or taken from the ``model``. Documents that cannot reach gold
    are kept in ``rejects`` with the reason."""
    def once(name: str, build, write=sinks.overwrite) -> DataFrame:
        path = os.path.join(out_dir, name)
        if not _complete(spark, path):
            write(build(), path)
        return spark.read.parquet(path)

    known = bronze.columns
    full = bronze.select("case_ref", "parsed_text", *[F.col(c) if c in known else F.lit(None).cast("string").alias(c)
                                                      for c in ("path", "parse_error")])
    rejects = once("rejects", lambda: FL.rejects(full))
    b = full.where(F.col("case_ref").isNotNull()).select("case_ref", "parsed_text")
    if check_keys:
        assert_unique_keys(b, "case_ref")
    l1 = once("staging_l1", lambda: E.extract(b, l1_model, E.l1_prompt(), R.l1_struct_type(), out="js"))
    if l2_model is None:
        staged = l1.select("case_ref", "parsed_text", "js", E.rule_l2(F.col("parsed_text")).alias("e"))
    else:
        l2 = once("staging_l2", lambda: E.extract(b, l2_model, E.l2_prompt(), R.l2_struct_type(), out="e").select("case_ref", "e"))
        staged = l1.join(l2, "case_ref")
    exprs = {f: F.col("js").getField(f) for f in R.L1_FIELDS}
    exprs.update({"Case_Ref": F.col("case_ref"), "Do_Not_Modify_Case": F.col("case_ref"),
                  "Case_Type": X.recorded_case_type("parsed_text", F.col("js").getField("Case_Type"), case_type_source)})
    gold = once("gold_case_intelligence", lambda: build_gold_staged(staged, exprs), sinks.write_gold)
    chunks = once("gold_email_chunks", lambda: G.email_chunks(gold, b))
    embed = None

    def embedded(table: DataFrame) -> DataFrame:
        nonlocal embed
        embed = embed or SE.fit_tfidf(chunks, "chunk")
        return table.join(embed(table, "chunk", "chunk_id"), "chunk_id")

    out = Rebuilt(gold=gold, chunks=chunks, embeddings=once("gold_email_embeddings", lambda: embedded(chunks)),
                  extraction_status=l1.groupBy("status").agg(F.count(F.lit(1)).alias("n")), rejects=rejects,
                  accuracy=once("gold_tag_accuracy", lambda: A.tag_accuracy(gold)))
    if procedures is not None:
        out.procedure_chunks = once("gold_procedure_chunks", lambda: sop_chunks(procedures))
        out.procedure_embeddings = once("gold_procedure_embeddings", lambda: embedded(out.procedure_chunks))
    return out


def sop_chunks(files: DataFrame) -> DataFrame:
    """V2: parsed procedure files ``(path, parsed_text)`` -> ``(chunk_id, sop_title, chunk)``.

    The title comes from the file name ``SOP_<title>.<ext>``; files without a
    title or text give none."""
    title = X.blank_to_null(F.regexp_extract("path", r"SOP_([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1))
    out = files.select(F.concat(F.lit("SOP_"), title).alias("chunk_id"), title.alias("sop_title"), F.col("parsed_text").alias("chunk"))
    return out.where("chunk_id is not null and length(chunk) > 0")
