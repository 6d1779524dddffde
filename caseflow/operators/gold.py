"""Gold build (J1, X16-X18) and key hygiene (Q1)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import record as R
from caseflow.functions import text as X


def assert_unique_keys(df: DataFrame, key: str) -> None:
    """Raise if ``key`` repeats or is NULL (one aggregation job).

    A repeated key would multiply rows in the gold join (the reference's
    ``case_ref = ''`` rows join to each other)."""
    bad = (df.groupBy(key).count().where((F.col("count") > 1) | F.col(key).isNull())
           .limit(5).collect())
    if bad:
        raise ValueError(f"key {key!r} not unique / NULL: {[tuple(r) for r in bad]}")


def build_gold(record: DataFrame, enrichment: DataFrame, *,
               resolution_method: str = "text", check_keys: bool = False) -> DataFrame:
    """record (52 columns) ⋈ enrichment ``(case_ref, parsed_text, e)`` -> gold.

    The enrichment stage already carries ``parsed_text``, so one equi-join on
    the case reference suffices (the reference joins bronze a second time).
    Rows without a reference are dropped before the join so they never match
    each other. Adds the 11 layer-1/2 fields, ``Case_Id`` and
    ``Resolution_Days``.
    """
    if check_keys:
        assert_unique_keys(record, "Case_Ref")
        assert_unique_keys(enrichment, "case_ref")
    rec = record.where(F.col("Case_Ref").isNotNull())
    enr = enrichment.where(F.col("case_ref").isNotNull()).select(
        F.col("case_ref").alias("_e_ref"), F.col("parsed_text").alias("_e_text"), "e")
    j = rec.join(enr, rec["Case_Ref"] == enr["_e_ref"], "inner")
    l2 = [F.col("e").getField(n).alias(n) for n, _ in R.L2_FIELDS]
    return j.select(
        *[rec[c] for c in record.columns],
        *l2,
        F.coalesce(F.col("MFA_Ref"), F.col("Case_Ref")).alias("Case_Id"),
        X.resolution_days(F.col("Case_Status"), F.col("_e_text"), resolution_method).alias("Resolution_Days"),
    )


def build_gold_staged(staged: DataFrame, record_exprs: Mapping[str, Column], *,
                      loaded_at: Column | None = None, text_col: str = "parsed_text",
                      enrichment_col: str = "e", resolution_method: str = "text") -> DataFrame:
    """Gold in one projection when both model outputs sit on the bronze row.

    Calling the layer-1 and layer-2 models in the same pass over bronze (one
    staged table with both structs) makes the gold join unnecessary: record
    mapping, the 11 enrichment fields, ``Case_Id`` and ``Resolution_Days`` are
    all column expressions over that row. Same columns as :func:`build_gold`.
    """
    rec = R.record_columns(record_exprs, loaded_at=loaded_at)
    names = [n for n, _ in R.RECORD_COLUMNS]
    mapped = staged.select(*rec, F.col(enrichment_col).alias("_e"), F.col(text_col).alias("_text"))
    mapped = mapped.where(F.col("Case_Ref").isNotNull())
    return mapped.select(
        *names,
        *[F.col("_e").getField(n).alias(n) for n, _ in R.L2_FIELDS],
        F.coalesce(F.col("MFA_Ref"), F.col("Case_Ref")).alias("Case_Id"),
        X.resolution_days(F.col("Case_Status"), F.col("_text"), resolution_method).alias("Resolution_Days"),
    )
