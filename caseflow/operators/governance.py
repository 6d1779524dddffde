"""Governance: column masks, row policies, PII scrub and leak checks.

Open-source Spark has no column-mask DDL or group-membership function, so a
policy is data: a mapping column -> mask plus an optional row predicate. The
viewer's privilege is resolved once per read (not per row) and enters the plan
as a literal, so Catalyst folds the mask away for privileged readers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as X

# Masked PII columns and the privileged group name.
PII_COLUMNS = ("Title_Name", "Caller___Informant", "Registrant", "New_Email")
PRIVILEGED_GROUP = "consular_privileged"


@dataclass(frozen=True)
class Viewer:
    name: str
    groups: frozenset = frozenset()

    def is_member(self, group: str) -> bool:
        return group in self.groups


@dataclass
class Policy:
    """Column masks and a row filter applied on read."""
    masked: tuple = PII_COLUMNS
    privileged_group: str = PRIVILEGED_GROUP
    row_filter: Callable[[Viewer], Column | None] | None = None
    free_text: tuple = field(default_factory=tuple)   # columns scrubbed for unprivileged readers (Q6)


def governed_read(df: DataFrame, policy: Policy, viewer: Viewer) -> DataFrame:
    """Apply ``policy`` for ``viewer``: same columns, masked where required.

    Aggregations over the result see masked values, so analysts get trends
    without identities (G5)."""
    privileged = viewer.is_member(policy.privileged_group)
    out = []
    for c in df.columns:
        col = F.col(c)
        if c in policy.masked:
            col = X.mask(col, privileged)
        elif c in policy.free_text and not privileged:
            name = F.col("Title_Name") if "Title_Name" in df.columns else F.lit(None).cast("string")
            col = X.scrub_pii(col, name)
        out.append(col.alias(c))
    res = df.select(*out)
    if policy.row_filter is not None:
        cond = policy.row_filter(viewer)
        if cond is not None:
            # Filter on the raw columns before masking hides them.
            res = df.where(cond).select(*out)
    return res


def email_chunks(record: DataFrame, bronze: DataFrame, keep_raw: bool = False,
                 chunk_size: int | None = None) -> DataFrame:
    """Scrubbed chunks ``(chunk_id, case_ref, case_type, case_location,
    chunk)``: national ids then the subject's name replaced.

    ``chunk_size=None`` keeps one chunk per case (``chunk_id = Case_Ref``, as
    the reference does); a size splits the scrubbed text into fixed pieces
    (``chunk_id = Case_Ref#n``, Q25). Scrubbing happens before splitting, so a
    name cut by a chunk border is still removed."""
    b = bronze.where(F.col("case_ref").isNotNull()).select(
        F.col("case_ref").alias("_b_ref"), F.col("parsed_text").alias("_b_text"))
    r = record.where(F.col("Case_Ref").isNotNull()).select("Case_Ref", "Case_Type", "Case_Location", "Title_Name")
    j = r.join(b, r["Case_Ref"] == b["_b_ref"], "inner")
    out = j.select(F.col("Case_Ref").alias("chunk_id"), F.col("Case_Ref").alias("case_ref"),
                   F.col("Case_Type").alias("case_type"), F.col("Case_Location").alias("case_location"),
                   X.scrub_pii(F.col("_b_text"), F.col("Title_Name")).alias("chunk"),
                   *([F.col("_b_text").alias("raw_text")] if keep_raw else []))
    if chunk_size is None:
        return out
    cols = [c for c in out.columns if c not in ("chunk_id", "chunk")]
    pieces = out.select(*cols, F.posexplode(X.fixed_chunks("chunk", chunk_size)).alias("_n", "chunk"))
    return pieces.select(F.concat(F.col("case_ref"), F.lit("#"), F.col("_n").cast("string")).alias("chunk_id"),
                         *cols[:3], "chunk", *cols[3:])


def scrub_columns(df: DataFrame, cols: Iterable[str], name_col: str | None = None) -> DataFrame:
    """Scrub several free-text columns in one projection."""
    name = F.col(name_col) if name_col else F.lit(None).cast("string")
    cols = set(cols)
    return df.select(*[(X.scrub_pii(F.col(c), name) if c in cols else F.col(c)).alias(c) for c in df.columns])


def register_sql_functions(spark, viewer: Viewer, policy: Policy | None = None) -> None:
    """SQL users' view of the same operators, as temporary SQL functions
    (Spark SQL UDFs: no Python, inlined by the optimizer):

    * ``mask_pii(v)`` - the value for privileged viewers, else ``***REDACTED***``
    * ``norm_key(x)`` - lower-case letters only, the procedure match key
    * ``scrub_pii(text, name)`` - national ids and the exact name replaced

    The viewer's privilege is decided here, once, and baked in as a literal.
    """
    pol = policy or Policy()
    privileged = "true" if viewer.is_member(pol.privileged_group) else "false"
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION mask_pii(v STRING) RETURNS STRING
                  RETURN CASE WHEN {privileged} THEN v ELSE '{X.REDACTED}' END""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION norm_key(x STRING) RETURNS STRING
                 RETURN regexp_replace(lower(x), '[^a-z]', '')""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION scrub_pii(t STRING, n STRING) RETURNS STRING
                  RETURN CASE WHEN n IS NULL OR n = ''
                              THEN regexp_replace(t, '{X.NATIONAL_ID}', '{X.NRIC_TOKEN}')
                              ELSE replace(regexp_replace(t, '{X.NATIONAL_ID}', '{X.NRIC_TOKEN}'), n, '{X.NAME_TOKEN}')
                         END""")
