"""Fixed record schema (K2, K7), by-name mapping (K3, X12, X13) and checksum."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# The 52-column case record, names and order as the reference
# declares them. All STRING except the audit timestamp.
# ---------------------------------------------------------------------------
RECORD_COLUMNS = [
    ("Do_Not_Modify_Case", "string"),
    ("Do_Not_Modify_Row_Checksum", "string"),
    ("Do_Not_Modify_Modified_On", "timestamp"),
    ("Title_Name", "string"),
    ("MFA_Ref", "string"),
    ("Created_On", "string"),
    ("Origin", "string"),
    ("Additional_Information", "string"),
    ("Advice_Provided___Follow_up", "string"),
    ("Allow_Case_History_Access", "string"),
    ("Allow_LRS_Access", "string"),
    ("Assigned_HCG", "string"),
    ("Assistance_Required", "string"),
    ("Caller___Informant", "string"),
    ("Case_Description", "string"),
    ("Case_Handler", "string"),
    ("Case_Location", "string"),
    ("Case_Ref", "string"),
    ("Case_Status", "string"),
    ("Case_Subject", "string"),
    ("Case_Title", "string"),
    ("Case_Type", "string"),
    ("Category_Multiselect", "string"),
    ("Citizenship", "string"),
    ("Contact_Tracing_Status", "string"),
    ("Covering_MP", "string"),
    ("Current_Location", "string"),
    ("Evacuation_Status", "string"),
    ("Feedback_Date", "string"),
    ("Feedback_Message", "string"),
    ("Feedback_Provider", "string"),
    ("Feedback_Type", "string"),
    ("Handled_By", "string"),
    ("HCG_Assigned_Date", "string"),
    ("Incident_ID", "string"),
    ("LRS_Communication", "string"),
    ("LRS_Portal_User_Modify_By", "string"),
    ("LRS_Portal_User_Modify_On", "string"),
    ("LRS_Update", "string"),
    ("Media_Query", "string"),
    ("Media_Response", "string"),
    ("Modified_On", "string"),
    ("MP_Constituency_Division", "string"),
    ("MP_Name", "string"),
    ("New_Case", "string"),
    ("New_Email", "string"),
    ("No_of_Open_Child_Cases", "string"),
    ("Parent_Case", "string"),
    ("Recipient_of_Feedback", "string"),
    ("Registrant", "string"),
    ("Sub_Category_Multiselect", "string"),
    ("Tag", "string"),
]

# The 25 layer-1 fields the extraction model returns, in order.
L1_FIELDS = [
    "Title_Name", "Case_Type", "Case_Status", "Case_Handler", "Assigned_HCG",
    "Handled_By", "Case_Location", "Current_Location", "Citizenship", "Origin",
    "Case_Title", "Case_Subject", "Case_Description", "Assistance_Required",
    "Advice_Provided___Follow_up", "Category_Multiselect",
    "Sub_Category_Multiselect", "Tag", "Caller___Informant", "Registrant",
    "MP_Name", "Covering_MP", "MP_Constituency_Division", "Incident_ID",
    "Created_On",
]

# The 11 layer-1 tag / layer-2 text fields of the enrichment model.
L2_FIELDS = [
    ("L1_Country", "string"),
    ("L1_Mission", "string"),
    ("L1_Case_Type", "string"),
    ("L1_Agencies", "array<string>"),
    ("L1_Situational_Flags", "array<string>"),
    ("L1_Status", "string"),
    ("L2_Summary_Pathway", "string"),
    ("L2_Assistance_Req_vs_Provided", "string"),
    ("L2_Complications_Delays", "string"),
    ("L2_External_Resources", "string"),
    ("L2_Lessons_Learnt", "string"),
]

# System column values written at record mapping.
SYSTEM_VALUES = {
    "New_Case": "Yes",
    "No_of_Open_Child_Cases": "0",
    "Allow_Case_History_Access": "Yes",
    "Allow_LRS_Access": "No",
}

AUDIT_PREFIX = "Do_Not_Modify_"
LOAD_TIME_COLUMNS = ("Modified_On",)   # business column holding the load time (Q2)


def record_schema() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), True)
                         for n, t in RECORD_COLUMNS])


def l1_struct_type() -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType(), True) for f in L1_FIELDS])


def l2_struct_type() -> T.StructType:
    return T.StructType([T.StructField(n, T._parse_datatype_string(t), True) for n, t in L2_FIELDS])


def business_columns(compat: bool = False) -> list[str]:
    """Columns covered by the checksum.

    Default excludes the audit trio and load-time columns, so the checksum of an
    unchanged record is stable across loads (Q2). ``compat=True`` keeps
    ``Modified_On`` as the reference does.
    """
    cols = [n for n, _ in RECORD_COLUMNS if not n.startswith(AUDIT_PREFIX)]
    if not compat:
        cols = [c for c in cols if c not in LOAD_TIME_COLUMNS]
    return cols


def row_checksum(exprs: Mapping[str, Column], cols: list[str]) -> Column:
    """SHA-256 of the pipe-joined values, NULL as ''.

    Documented format: values are not escaped, so ``('a|b','c')`` and
    ``('a','b|c')`` collide (Q3); see :func:`safe_checksum`.
    """
    parts = [F.coalesce(exprs.get(c, F.lit(None).cast("string")), F.lit("")) for c in cols]
    return F.sha2(F.concat_ws("|", *parts), 256)


def safe_checksum(exprs: Mapping[str, Column], cols: list[str]) -> Column:
    """Collision-safe variant: hash of the JSON of a named struct."""
    st = F.struct(*[exprs.get(c, F.lit(None).cast("string")).alias(c) for c in cols])
    return F.sha2(F.to_json(st), 256)


def record_columns(field_exprs: Mapping[str, Column], *, loaded_at: Column | None = None,
                   compat_checksum: bool = False) -> list[Column]:
    """The 52 record columns as Columns, by name.

    ``field_exprs`` maps record column -> Column (extracted fields, keys); the
    system defaults of :data:`SYSTEM_VALUES` are added, load-time columns come
    from ``loaded_at`` (default ``current_timestamp()``), and any column with no
    expression becomes a typed NULL. The checksum is computed from the same
    expressions, so it is part of one projection, not a second pass.
    """
    loaded = loaded_at if loaded_at is not None else F.current_timestamp()
    exprs: dict[str, Column] = {k: F.lit(v) for k, v in SYSTEM_VALUES.items()}
    exprs["MFA_Ref"] = F.lit(None).cast("string")
    exprs["Do_Not_Modify_Modified_On"] = loaded.cast("timestamp")
    exprs["Modified_On"] = F.date_format(loaded, "yyyy-MM-dd HH:mm:ss")
    exprs.update(field_exprs)
    exprs["Do_Not_Modify_Row_Checksum"] = row_checksum(exprs, business_columns(compat_checksum))
    return [exprs.get(name, F.lit(None)).cast(typ).alias(name) for name, typ in RECORD_COLUMNS]


def map_to_record(df: DataFrame, field_exprs: Mapping[str, Column], *,
                  loaded_at: Column | None = None, compat_checksum: bool = False) -> DataFrame:
    """Project ``df`` onto the fixed record schema by name."""
    return df.select(*record_columns(field_exprs, loaded_at=loaded_at, compat_checksum=compat_checksum))


def check_record_schema(df: DataFrame) -> list[str]:
    """K7: names of record columns absent from ``df`` (empty list = complete)."""
    have = set(df.columns)
    return [n for n, _ in RECORD_COLUMNS if n not in have]
