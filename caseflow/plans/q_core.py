"""Queries for parse/extract/gold operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import record as R
from caseflow.functions import text as X
from caseflow.operators import analytics as A
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register
from caseflow.sources.tables import Tables


@register("resolution_by_type", S.on_cases("""
SELECT Case_Type, round(avg(Resolution_Days), 1) AS avg_days, count(Resolution_Days) AS closed
FROM cases WHERE Resolution_Days IS NOT NULL GROUP BY Case_Type"""), ops=("A11", "X15", "X16"))
def resolution_by_type(spark, d):
    """Mean resolution days and closed count per recorded type."""
    return A.resolution_by_type(FX.stored_cases(spark, d))


@register("extract_case_ref", S.on_threads(r"""
SELECT case_ref, nullif(regexp_extract(parsed_text, '\[(SGCON/[0-9]{4}/[0-9]+)\]', 1), '') AS extracted_ref
FROM threads"""), ops=("X3",))
def extract_case_ref(spark, d):
    """Strict case reference recovered from each thread text."""
    th = FX.threads(spark, d)
    return th.select("case_ref", X.case_ref("parsed_text").alias("extracted_ref"))


@register("subject_case_type", S.on_threads(f"""
SELECT case_ref, {S.SUBJECT_TYPE_SQL} AS subject_type FROM threads"""), ops=("X11",))
def subject_case_type(spark, d):
    """Recorded case type read from the subject line."""
    th = FX.threads(spark, d)
    return th.select("case_ref", X.subject_case_type("parsed_text").alias("subject_type"))


@register("case_type_sources", S.on_threads(f"""
SELECT case_ref, {S.SUBJECT_TYPE_SQL} AS by_subject, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE case_type END AS by_model
FROM threads"""), ops=("X11", "X12"))
def case_type_sources(spark, d):
    """The recorded type by either source; the model leaves every third case open."""
    model = F.when(F.col("o_orderkey") % 3 == 0, F.lit("")).otherwise(F.col("case_type"))
    th = FX.threads(spark, d)
    return th.select("case_ref", X.recorded_case_type("parsed_text", model).alias("by_subject"),
                     X.recorded_case_type("parsed_text", model, "model").alias("by_model"))


@register("date_tokens", S.on_threads(f"""
SELECT case_ref, array_to_string({S.DATE_TOKENS_SQL}, ',') AS date_tokens,
       CAST(len({S.DATE_TOKENS_SQL}) AS INTEGER) AS n_tokens FROM threads"""), ops=("X15",))
def date_tokens(spark, d):
    """All date tokens of each thread, in text order."""
    th = FX.threads(spark, d)
    toks = X.date_tokens("parsed_text")
    return th.select("case_ref", F.concat_ws(",", toks).alias("date_tokens"), F.size(toks).alias("n_tokens"))


@register("resolution_days", S.on_threads(f"""
SELECT case_ref, {S.resolution_sql(S.STATUS_SQL, S.DATE_TOKENS_SQL)} AS resolution_days FROM threads"""),
          ops=("X16",))
def resolution_days(spark, d):
    """Signed days between first and last date of closed threads."""
    th = FX.threads(spark, d)
    return th.select("case_ref", X.resolution_days(FX.status_of(F.col("o_orderstatus")), F.col("parsed_text"))
                     .alias("resolution_days"))


@register("gold_build", S.on_cases("""
SELECT Case_Ref, Case_Id, Case_Type, Case_Status, Case_Handler, Assigned_HCG, L1_Country, L1_Mission,
       L1_Case_Type, array_to_string(L1_Agencies, ',') AS agencies,
       array_to_string(L1_Situational_Flags, ',') AS flags, L1_Status, L2_Summary_Pathway,
       L2_Complications_Delays, Resolution_Days, Created_On
FROM cases"""), ops=("J1", "X17", "X18", "K1"))
def gold_build(spark, d):
    """Record ⋈ enrichment -> gold (stage-per-model join path), key columns and tags."""
    g = FX.cases_joined(spark, d)
    return g.select("Case_Ref", "Case_Id", "Case_Type", "Case_Status", "Case_Handler", "Assigned_HCG",
                    "L1_Country", "L1_Mission", "L1_Case_Type",
                    F.concat_ws(",", "L1_Agencies").alias("agencies"),
                    F.concat_ws(",", "L1_Situational_Flags").alias("flags"), "L1_Status",
                    "L2_Summary_Pathway", "L2_Complications_Delays", "Resolution_Days", "Created_On")


@register("row_checksum", S.on_threads(f"""
SELECT case_ref, {S.checksum_sql()} AS checksum FROM threads"""), ops=("X14",))
def row_checksum(spark, d):
    """SHA-256 row checksum of every mapped record."""
    rec = FX.record_from_l1(FX.l1_model_stand_in(FX.threads(spark, d)))
    return rec.select(F.col("Case_Ref").alias("case_ref"), F.col("Do_Not_Modify_Row_Checksum").alias("checksum"))


@register("map_to_record", S.on_threads("""
SELECT """ + ", ".join(f"{S.record_expr(c)} AS {c}" for c, t in R.RECORD_COLUMNS
                       if t == "string" and c != "Do_Not_Modify_Row_Checksum") + """
FROM threads"""), ops=("X12", "X13", "K3", "K2"))
def map_to_record(spark, d):
    """All string columns of the 52-column record, mapped by name."""
    rec = FX.record_from_l1(FX.l1_model_stand_in(FX.threads(spark, d)))
    cols = [c for c, t in R.RECORD_COLUMNS if t == "string" and c != "Do_Not_Modify_Row_Checksum"]
    return rec.select(*cols)


@register("parse_stats", S.on_threads(r"""
SELECT count(*) AS total, count(nullif(parsed_text, '')) AS with_text,
       count(nullif(regexp_extract(parsed_text, '\[(SGCON/[0-9]{4}/[0-9]+)\]', 1), '')) AS with_ref,
       count(parse_error) AS errors
FROM (SELECT parsed_text, NULL AS parse_error FROM threads
      UNION ALL SELECT NULL, props FROM events WHERE event_type = 'error')"""), ops=("A1", "X2"))
def parse_stats(spark, d):
    """Bronze QA: total, with text, with reference, with parse error (error events stand for failed files)."""
    th = FX.threads(spark, d).select("parsed_text", F.lit(None).cast("string").alias("parse_error"))
    failed = Tables(spark, d).events.where(F.col("event_type") == "error").select(
        F.lit(None).cast("string").alias("parsed_text"), F.col("props").alias("parse_error"))
    return A.parse_stats(th.unionByName(failed).withColumn("case_ref", X.case_ref("parsed_text")))


@register("extract_stats", S.on_cases("""
SELECT count(*) AS n_rows, count(DISTINCT Case_Type) AS n_types,
       count(*) FILTER (WHERE Case_Location IS NULL) AS null_locations,
       count(MP_Name) AS mp_names
FROM (SELECT *, CAST(NULL AS VARCHAR) AS MP_Name FROM cases)"""), ops=("A2",))
def extract_stats(spark, d):
    """Record QA: rows, types, NULL locations, populated MP names."""
    return A.extract_stats(FX.stored_cases(spark, d))


@register("enrich_stats", S.on_cases("""
SELECT round(avg(len(L1_Agencies)), 2) AS avg_agencies,
       round(avg(len(L1_Situational_Flags)), 2) AS avg_flags,
       count(Resolution_Days) AS n_resolved, round(avg(Resolution_Days), 1) AS avg_days
FROM cases"""), ops=("A3",))
def enrich_stats(spark, d):
    """Gold QA: mean tag counts, resolved count, mean days."""
    return A.enrich_stats(FX.stored_cases(spark, d))


@register("by_l1_type", S.on_cases("""
SELECT L1_Case_Type, count(*) AS n FROM cases GROUP BY L1_Case_Type"""), ops=("A6",))
def by_l1_type(spark, d):
    """Count by derived (layer-1) case type."""
    return A.count_by(FX.stored_cases(spark, d), "L1_Case_Type")


@register("sink_overwrite_roundtrip", S.on_cases("""
SELECT CAST(year(CAST(try_strptime(Created_On, '%Y-%m-%d') AS DATE)) AS INTEGER) AS created_year, Case_Type,
       count(*) AS n, count(DISTINCT Case_Ref) AS refs, count(Resolution_Days) AS resolved,
       CAST(sum(Resolution_Days) AS BIGINT) AS days, CAST(sum(len(L1_Agencies)) AS BIGINT) AS agencies,
       CAST(sum(length(Case_Description)) AS BIGINT) AS text_chars
FROM cases GROUP BY 1, 2"""), ops=("K1", "K2"))
def sink_overwrite_roundtrip(spark, d):
    """Gold written year-partitioned over an earlier table and read back whole, every year."""
    import os
    import uuid

    from caseflow.session import checkpoint_dir
    from caseflow.sources import sinks

    path = os.path.join(checkpoint_dir(spark), "caseflow-gold", uuid.uuid4().hex)
    gold = FX.stored_cases(spark, d)
    sinks.write_gold(gold.limit(10), path)  # is replaced by the next line
    sinks.write_gold(gold, path)
    back = spark.read.parquet(path)
    return back.groupBy("created_year", "Case_Type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("Case_Ref").alias("refs"), F.count("Resolution_Days").alias("resolved"),
        F.sum("Resolution_Days").cast("long").alias("days"), F.sum(F.size("L1_Agencies")).cast("long").alias("agencies"),
        F.sum(F.length("Case_Description")).cast("long").alias("text_chars"))


@register("decode_l2", S.on_cases("""
SELECT Case_Ref, L1_Country,
       CASE WHEN Case_Status = 'Pending' THEN NULL ELSE array_to_string(L1_Agencies, ',') END AS agencies,
       CASE WHEN Case_Status = 'Pending' THEN 'bad_json' ELSE 'ok' END AS status
FROM cases"""), ops=("X9", "X7", "X10"))
def decode_l2(spark, d):
    """Enrichment answers decoded into the 11-field struct; a scalar where an
    array belongs (pending cases here) nulls that field and flags the row."""
    from caseflow.operators import extract as E
    g = FX.cases(spark, d)
    good = F.to_json(F.struct("L1_Country", "L1_Agencies", "L1_Situational_Flags", "L1_Status"))
    bad = F.to_json(F.struct("L1_Country", F.concat_ws(",", "L1_Agencies").alias("L1_Agencies")))
    raw = F.concat(F.lit("Answer: "), F.when(F.col("Case_Status") == "Pending", bad).otherwise(good))
    dec = E.decode(raw, R.l2_struct_type())
    return g.select("Case_Ref", dec.alias("d"), raw.alias("raw")).select(
        "Case_Ref", F.col("d.L1_Country").alias("L1_Country"),
        F.when(F.col("d.L1_Agencies").isNotNull(), F.concat_ws(",", F.col("d.L1_Agencies"))).alias("agencies"),
        E.decode_status(F.col("raw"), F.col("d")).alias("status"))
