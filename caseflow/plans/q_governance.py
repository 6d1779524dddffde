"""Governance queries: masked reads, row policy, scrubbed chunks, leak check."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import analytics as A
from caseflow.operators import governance as G
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register

ANALYST = G.Viewer("analyst", frozenset({"analysts"}))
OFFICER = G.Viewer("officer", frozenset({G.PRIVILEGED_GROUP, "crc_unit"}))
_MASK_COLS = ["Case_Ref", "Case_Type", "Title_Name", "Caller___Informant", "Registrant", "New_Email"]


def crc_only(viewer: G.Viewer):
    """Row policy: members of ``crc_unit`` see only CRC-handled cases."""
    return (F.col("Case_Handler") == "CRC") if viewer.is_member("crc_unit") else None


@register("masked_view", S.on_cases("""
SELECT Case_Ref, Case_Type, '***REDACTED***' AS Title_Name, '***REDACTED***' AS Caller___Informant,
       '***REDACTED***' AS Registrant, '***REDACTED***' AS New_Email FROM cases"""), ops=("G1", "G2"))
def masked_view(spark, d):
    """Unprivileged read: the four PII columns masked, NULLs included."""
    return G.governed_read(FX.stored_cases(spark, d), G.Policy(), ANALYST).select(*_MASK_COLS)


@register("privileged_view", S.on_cases("""
SELECT Case_Ref, Case_Type, Title_Name, Caller___Informant, Registrant, New_Email FROM cases
WHERE Case_Handler = 'CRC'"""), ops=("G1", "G2", "G6"))
def privileged_view(spark, d):
    """Privileged read with a row policy: clear values, CRC rows only."""
    pol = G.Policy(row_filter=crc_only)
    return G.governed_read(FX.stored_cases(spark, d), pol, OFFICER).select(*_MASK_COLS)


@register("masked_aggregate", S.on_cases("""
SELECT '***REDACTED***' AS Title_Name, Case_Type, count(*) AS n FROM cases GROUP BY Case_Type"""), ops=("G5",))
def masked_aggregate(spark, d):
    """Aggregates through the masked read carry no identities."""
    g = G.governed_read(FX.stored_cases(spark, d), G.Policy(), ANALYST)
    return A.count_by(g, "Title_Name", "Case_Type")


_SCRUB = ("CASE WHEN Title_Name IS NULL OR Title_Name = '' "
          "THEN regexp_replace(parsed_text, '[STFG][0-9]{7}[A-Z]', '[NRIC]', 'g') "
          "ELSE replace(regexp_replace(parsed_text, '[STFG][0-9]{7}[A-Z]', '[NRIC]', 'g'), Title_Name, '[NAME]') END")


def _chunks(spark, d, keep_raw=False):
    th = FX.threads(spark, d)
    record = FX.record_from_l1(FX.l1_model_stand_in(th))
    return G.email_chunks(record, th.select("case_ref", "parsed_text"), keep_raw)


@register("email_chunks", S.on_cases(f"""
SELECT Case_Ref AS chunk_id, Case_Ref AS case_ref, Case_Type AS case_type, Case_Location AS case_location,
       {_SCRUB} AS chunk FROM cases"""), ops=("V1", "J2", "G3"))
def email_chunks(spark, d):
    """One scrubbed chunk per case (record ⋈ bronze)."""
    return _chunks(spark, d)


@register("nric_leak_check", S.on_cases(f"""
SELECT count(*) AS n_chunks,
       count(*) FILTER (WHERE regexp_matches(chunk, '[STFG][0-9]{{7}}[A-Z]')) AS leaks,
       count(*) FILTER (WHERE chunk IS NULL) AS null_chunks,
       count(*) FILTER (WHERE regexp_matches(parsed_text, '[STFG][0-9]{{7}}[A-Z]')) AS raw_ids
FROM (SELECT parsed_text, {_SCRUB} AS chunk FROM cases)"""), ops=("A21", "G4", "F7"))
def nric_leak_check(spark, d):
    """Chunks still holding a national id after scrub (must be 0), NULL
    chunks, and the id count before scrub."""
    return A.leak_check(_chunks(spark, d, keep_raw=True), raw_col="raw_text")


EMAIL_CHUNK_SIZE = 64


@register("email_chunks_fixed", S.on_cases(f"""
SELECT Case_Ref || '#' || CAST(i AS VARCHAR) AS chunk_id, Case_Ref AS case_ref, Case_Type AS case_type,
       Case_Location AS case_location, substring(c, i * {EMAIL_CHUNK_SIZE} + 1, {EMAIL_CHUNK_SIZE}) AS chunk
FROM (SELECT *, {_SCRUB} AS c FROM cases) t,
     LATERAL (SELECT unnest(range(0, CAST(ceil(length(c) / {EMAIL_CHUNK_SIZE}.0) AS BIGINT))) AS i) r"""),
          ops=("V1", "X25", "G3"))
def email_chunks_fixed(spark, d):
    """Scrubbed case text split into fixed-size chunks (chunker parameter)."""
    th = FX.threads(spark, d)
    record = FX.record_from_l1(FX.l1_model_stand_in(th))
    return G.email_chunks(record, th.select("case_ref", "parsed_text"), chunk_size=EMAIL_CHUNK_SIZE)
