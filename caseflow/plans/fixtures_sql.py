"""DuckDB twins of :mod:`caseflow.plans.fixtures`, used only as the oracle.

Each constant is a list of ``name AS (...)`` common table expressions over the
driver views; :func:`sql_with` prefixes them to a query body.
"""

from __future__ import annotations

from caseflow.functions import record as R
from caseflow.plans.fixtures import CASE_TYPES, FIXTURE_LOADED_AT, sop_rows

_TYPES = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in CASE_TYPES) + "]"

LINE_FACTS = """line_facts AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship,
    list_sort(list(DISTINCT l_returnflag || l_linestatus)) AS codes,
    list_sort(list(DISTINCT CASE WHEN l_discount < 0.02 THEN 'scam'
                                 WHEN l_discount < 0.04 THEN 'welfare concern'
                                 WHEN l_discount < 0.05 THEN 'language barrier' END)
              FILTER (WHERE l_discount < 0.05)) AS flags
  FROM lineitem GROUP BY l_orderkey)"""

FACTS = f"""facts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
    c.c_name, g.n_name, g.r_name, lf.last_ship, lf.codes, lf.flags,
    {_TYPES}[(o.o_orderkey % 6) + 1] AS case_type,
    'SGCON/' || CAST(year(o.o_orderdate) AS VARCHAR) || '/' || CAST(10000 + o.o_orderkey AS VARCHAR) AS case_ref
  FROM orders o
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) g
    ON c.c_nationkey = g.n_nationkey
  LEFT JOIN line_facts lf ON o.o_orderkey = lf.l_orderkey)"""

THREADS = """threads AS (
  SELECT *, concat_ws(chr(10),
      'Subject: Re: [' || case_ref || '] ' || case_type || ' - ' || c_name || ' in ' || n_name,
      'Date: ' || strftime(o_orderdate, '%d %b %Y') || ', 08:00',
      'NRIC S' || lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') || 'Z',
      'Date: ' || strftime(last_ship, '%d %b %Y') || ', 09:00') AS parsed_text
  FROM facts)"""

SUBJECT_TYPE_SQL = r"nullif(regexp_extract(parsed_text, '\[SGCON[^\]]*\]\s*(.+?)\s*-\s', 1), '')"
DATE_TOKENS_SQL = "regexp_extract_all(parsed_text, '([0-9]{1,2} [A-Za-z]{3} [0-9]{4})', 1)"


def resolution_sql(status: str, toks: str) -> str:
    return (f"CASE WHEN lower({status}) = 'closed' AND len({toks}) >= 2 THEN "
            f"CAST(date_diff('day', CAST(try_strptime({toks}[1], '%d %b %Y') AS DATE), "
            f"CAST(try_strptime({toks}[-1], '%d %b %Y') AS DATE)) AS INTEGER) END")


STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN 'In Progress' WHEN 'P' THEN 'Pending' END"

# Record columns as the fixture's model stand-in fills them (others NULL).
RECORD_EXPRS = {
    "Do_Not_Modify_Case": "case_ref",
    "Case_Ref": "case_ref",
    "Title_Name": "c_name",
    "Case_Type": SUBJECT_TYPE_SQL,
    "Case_Status": STATUS_SQL,
    "Case_Handler": "CASE WHEN o_orderkey % 2 = 0 THEN 'CRC' ELSE 'CON/OPS' END",
    "Assigned_HCG": "r_name",
    "Case_Location": "n_name",
    "Citizenship": "'Singapore'",
    "Origin": "'Email'",
    "Case_Title": "case_type || ' - ' || c_name || ' in ' || n_name",
    "Case_Subject": "'Re: [' || case_ref || '] ' || case_type || ' - ' || c_name || ' in ' || n_name",
    "Case_Description": "c_name || ' rang from ' || n_name || ' about: ' || case_type",
    "Category_Multiselect": "o_orderpriority",
    "Registrant": "c_name",
    "Created_On": "strftime(o_orderdate, '%Y-%m-%d')",
    "New_Case": "'Yes'",
    "No_of_Open_Child_Cases": "'0'",
    "Allow_Case_History_Access": "'Yes'",
    "Allow_LRS_Access": "'No'",
    "Modified_On": f"'{FIXTURE_LOADED_AT}'",
}


def record_expr(col: str) -> str:
    return RECORD_EXPRS.get(col, "CAST(NULL AS VARCHAR)")


def checksum_sql(compat: bool = False) -> str:
    parts = ", ".join(f"coalesce({record_expr(c)}, '')" for c in R.business_columns(compat))
    return f"sha256(concat_ws('|', {parts}))"


_GOLD_RECORD_COLS = ["Case_Ref", "Case_Type", "Case_Status", "Case_Handler", "Assigned_HCG",
                     "Case_Location", "Citizenship", "Origin", "Case_Title", "Case_Subject",
                     "Case_Description", "Category_Multiselect", "Title_Name", "Registrant",
                     "Created_On", "Caller___Informant", "New_Email", "MFA_Ref"]

CASES = (
    "cases AS (\n  SELECT "
    + ",\n    ".join(f"{record_expr(c)} AS {c}" for c in _GOLD_RECORD_COLS)
    + """,
    case_ref AS Case_Id,
    parsed_text,
    n_name AS L1_Country,
    CASE WHEN o_custkey % 10 < 2 THEN NULL ELSE r_name END AS L1_Mission,
    CASE WHEN o_custkey % 10 < 2 THEN 'Scam' ELSE upper(case_type) END AS L1_Case_Type,
    coalesce(codes, CAST([] AS VARCHAR[])) AS L1_Agencies,
    coalesce(flags, CAST([] AS VARCHAR[])) AS L1_Situational_Flags,
    CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'pending' END AS L1_Status,
    r_name || ' desk, ' || n_name || ': ' || case_type AS L2_Summary_Pathway,
    CASE WHEN list_contains(coalesce(flags, CAST([] AS VARCHAR[])), 'language barrier')
         THEN 'An interpreter was called in' ELSE 'No delay' END AS L2_Complications_Delays,
    """ + resolution_sql(STATUS_SQL, "toks") + """ AS Resolution_Days
  FROM (SELECT *, """ + DATE_TOKENS_SQL + """ AS toks FROM threads) t)"""
)

BASE = [LINE_FACTS, FACTS, THREADS]
GOLD = BASE + [CASES]


def sop_values_sql() -> str:
    def q(s: str) -> str:
        return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    rows = ",\n    ".join(f"({q(a)}, {q(b)}, {q(c)})" for a, b, c in sop_rows())
    return f"sop AS (SELECT * FROM (VALUES\n    {rows}) v(chunk_id, sop_title, chunk))"


def sql_with(body: str, ctes: list[str]) -> str:
    """Prefix ``ctes`` to ``body`` (which must not start with WITH)."""
    if not ctes:
        return body.lstrip()
    return "WITH " + ",\n".join(ctes) + "\n" + body


def on_threads(body: str, *extra: str) -> str:
    return sql_with(body, BASE + list(extra))


def on_cases(body: str, *extra: str) -> str:
    return sql_with(body, GOLD + list(extra))


CASE_KEYS = """case_keys AS (
  SELECT o_orderkey, 'SGCON/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(10000 + o_orderkey AS VARCHAR)
         AS case_ref FROM orders)"""

EV = """ev AS (
  SELECT e.event_id, e.ts, e.user_id, e.event_type, e.props, k.case_ref
  FROM events e JOIN case_keys k ON e.user_id = k.o_orderkey)"""

STATUS_EVENTS = """status_events AS (
  SELECT case_ref, CASE event_type WHEN 'purchase' THEN 'Closed' WHEN 'error' THEN 'On Hold'
                   WHEN 'signup' THEN 'Pending' ELSE 'In Progress' END AS status,
         ts AS at_, event_id AS seq FROM ev)"""

STEP_EVENTS = """step_events AS (
  SELECT case_ref, CAST(event_id % 5 AS INTEGER) AS idx, event_type <> 'error' AS done,
         'officer' AS by_, ts AS at_, event_id AS seq FROM ev)"""

NOTE_EVENTS = """note_events AS (
  SELECT case_ref, event_type AS author, props AS note, ts AS at_, event_id AS seq FROM ev)"""

ROUTE_SQL = (r"CASE WHEN regexp_matches(text, '\[(SGCON/[0-9]{4}/[0-9]+)\]') THEN 'case_lookup' "
             r"WHEN regexp_matches(text, '(?i)\b(procedure|procedures|sop|protocol|steps?)\b') THEN 'procedure' "
             r"WHEN regexp_matches(text, '(?i)\b(similar|past cases|previous cases|like this)\b') THEN 'similar' "
             r"ELSE 'structured' END")

CHAT = f"""chat AS (
  SELECT conv_id, 'officer' || CAST(conv_id % 7 AS VARCHAR) || '@example.org' AS user_email, role,
         text AS content, CASE WHEN role = 'user' THEN {ROUTE_SQL} END AS route,
         turn AS created_at, turn AS seq
  FROM conversations)"""

EVENTS = [CASE_KEYS, EV, STATUS_EVENTS, STEP_EVENTS, NOTE_EVENTS]
