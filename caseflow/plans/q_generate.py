"""The tagger against threads with known facts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from caseflow.operators import analytics as A
from caseflow.operators import extract as E
from caseflow.operators import synth as SY
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register
from caseflow.plans.fixtures import CASE_TYPES
from caseflow.session import checkpoint_dir
from caseflow.sources.tables import Tables


def _lit_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_PER_ROW = """
SELECT case_ref, array_to_string(p_agencies, ',') AS agencies, array_to_string(p_flags, ',') AS flags,
       p_status AS status, p_country AS country FROM tagged"""


def truth_sql(body: str | None = None) -> str:
    """Tagged truth threads (CTE ``tagged``) and a query body over them (default: the scores)."""
    rmap = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SY.RETURNFLAG_AGENCY.items())
    quoted = lambda x: x.replace("'", "''")
    flag_sent = " ".join(f"WHEN '{k}' THEN '{quoted(v)}'" for k, v in SY.FLAG_SENTENCES.items())
    decoy = "CASE o_orderkey % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in SY.DECOYS.items()) + " END"
    tag_ag = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(parsed_text, '\\b{a}\\b') THEN '{a}' END"
                                         for a in E.AGENCIES) + "], lambda x: x IS NOT NULL)"
    tag_fl = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(parsed_text, '{p}') THEN '{f}' END"
                                         for f, p in E.FLAG_CUES.items()) + "], lambda x: x IS NOT NULL)"
    tag_st = ("CASE " + " ".join(f"WHEN regexp_matches(parsed_text, '{p}') THEN '{v}'" for v, p in E.STATUS_CUES)
              + " END")
    tag_co = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(parsed_text, '\\b{c}\\b') THEN '{c}' END"
                                     for c in E.COUNTRIES) + ")"

    def scores(prefix, pred, truth, full):
        return (f"CAST(sum(len(list_intersect({pred}, {truth}))) AS BIGINT) AS {prefix}_tp, "
                f"CAST(sum(len(list_filter({pred}, lambda x: NOT list_contains({truth}, x)))) AS BIGINT) AS {prefix}_fp, "
                f"CAST(sum(len(list_filter({truth}, lambda x: NOT list_contains({pred}, x)))) AS BIGINT) AS {prefix}_fn, "
                f"CAST(sum(len(list_filter({full}, lambda x: NOT list_contains({pred}, x)))) AS BIGINT) AS {prefix}_fn_full")

    return "WITH " + S.LINE_FACTS + f""",
t0 AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority, lf.last_ship,
              coalesce(lf.codes, CAST([] AS VARCHAR[])) AS codes, coalesce(lf.flags, CAST([] AS VARCHAR[])) AS lflags
       FROM orders o LEFT JOIN line_facts lf ON o.o_orderkey = lf.l_orderkey),
t1 AS (SELECT *, {_lit_list(CASE_TYPES)}[(o_orderkey % 6) + 1] AS case_type,
              {_lit_list(E.COUNTRIES)}[(o_custkey % 8) + 1] AS country,
              CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'pending' END AS status,
              'SGCON/' || CAST(year(o_orderdate) AS VARCHAR) || '/' || CAST(10000 + o_orderkey AS VARCHAR) AS case_ref,
              list_concat(list_transform(codes, lambda c: CASE substring(c, 1, 1) {rmap} END),
                          list_transform(codes, lambda c: CASE WHEN substring(c, 2, 1) = 'O' THEN 'MOH' END)) AS raw_ag,
              list_concat(lflags, CASE WHEN o_orderpriority = '1-URGENT' THEN ['MP/POH escalation']
                                       ELSE CAST([] AS VARCHAR[]) END,
                          CASE WHEN {_lit_list(CASE_TYPES)}[(o_orderkey % 6) + 1] = 'Scam' THEN ['scam']
                               ELSE CAST([] AS VARCHAR[]) END) AS raw_fl
       FROM t0),
t2 AS (SELECT *, list_filter({_lit_list(E.AGENCIES)}, lambda v: list_contains(raw_ag, v)) AS agencies,
              list_filter({_lit_list(E.FLAGS)}, lambda v: list_contains(raw_fl, v)) AS flags FROM t1),
t3 AS (SELECT *, CASE WHEN case_type = 'Arrest & Detention' THEN list_filter(agencies, lambda a: a <> 'MHA')
                      ELSE agencies END AS ev_agencies,
              CASE WHEN case_type = 'Evacuation' THEN list_filter(flags, lambda f: f <> 'welfare concern')
                   ELSE flags END AS ev_flags,
              'Citizen ' || CAST(o_orderkey AS VARCHAR) AS name FROM t2),
th AS (SELECT *, concat_ws(chr(10),
          'Subject: Re: [' || case_ref || '] ' || case_type || ' - ' || name || ' in ' || country,
          'Date: ' || strftime(o_orderdate, '%d %b %Y') || ', 08:00',
          name || ' wrote to the desk from ' || country || '.',
          CASE WHEN len(ev_agencies) > 0 THEN 'Letters went to ' || array_to_string(ev_agencies, ', ') || '.' END,
          CASE WHEN len(ev_flags) > 0 THEN array_to_string(list_transform(ev_flags, lambda f: CASE f {flag_sent} END), ' ') END,
          {decoy},
          CASE WHEN status = 'closed' THEN 'Case closed.' ELSE 'Case pending.' END,
          'Date: ' || strftime(last_ship, '%d %b %Y') || ', 09:00') AS parsed_text FROM t3),
tagged AS (SELECT *, {tag_ag} AS p_agencies, {tag_fl} AS p_flags, {tag_st} AS p_status, {tag_co} AS p_country,
                  regexp_extract(parsed_text, '\\[SGCON[^\\]]*\\]\\s*(.+?)\\s*-\\s', 1) AS p_type FROM th)
""" + (body or f"""
SELECT count(*) AS n, {scores('agencies', 'p_agencies', 'ev_agencies', 'agencies')},
       {scores('flags', 'p_flags', 'ev_flags', 'flags')},
       count(*) FILTER (WHERE p_status = status) AS status_correct,
       count(*) FILTER (WHERE p_country = country) AS country_correct,
       count(*) FILTER (WHERE p_type = case_type) AS type_correct
FROM tagged""")


@register("truth_vs_tags", truth_sql(), ops=("J8", "X10", "Y6"))
def truth_vs_tags(spark, d):
    """Evidence-only tagger scored against ground truth: per-element counts
    against evidenced truth and against full truth."""
    t = Tables(spark, d)
    return SY.truth_scores(SY.truth_threads(t.orders, t.lineitem))


@register("tag_threads", truth_sql(_PER_ROW), ops=("X10",))
def tag_threads(spark, d):
    """Evidence-only tags of every truth thread: agencies, flags, status, country."""
    t = Tables(spark, d)
    th = SY.truth_threads(t.orders, t.lineitem)
    return th.select("case_ref", F.concat_ws(",", E.tag_agencies("parsed_text")).alias("agencies"),
                     F.concat_ws(",", E.tag_flags("parsed_text")).alias("flags"),
                     E.tag_status("parsed_text").alias("status"),
                     E.tag_first("parsed_text", E.COUNTRIES).alias("country"))


_FACTS = """t AS (SELECT case_ref, case_type, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE 'pending' END AS status,
  list_filter(coalesce(flags, CAST([] AS VARCHAR[])), lambda f: f <> 'scam' OR o_orderkey % 2 = 0) AS flags FROM threads WHERE o_orderkey % 7 <> 0),
g AS (SELECT * FROM cases WHERE CAST(string_split(Case_Ref, '/')[3] AS BIGINT) % 11 <> 0),
j AS (SELECT t.case_ref AS a, g.Case_Ref AS b, t.case_type, t.status, t.flags AS tf, g.L1_Case_Type, g.L1_Status, g.L1_Situational_Flags AS gf
      FROM t FULL OUTER JOIN g ON t.case_ref = g.Case_Ref),
e AS (SELECT tf, gf, unnest(list_distinct(list_concat(tf, gf))) AS f FROM j WHERE a IS NOT NULL AND b IS NOT NULL)"""


@register("manifest_confusion", S.on_cases("""
SELECT field, truth, found, count(*) AS n FROM (
  SELECT 'row' AS field, CASE WHEN a IS NOT NULL THEN 'yes' END AS truth, CASE WHEN b IS NOT NULL THEN 'yes' END AS found FROM j
  UNION ALL SELECT 'case_type', case_type, L1_Case_Type FROM j WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT 'status', status, L1_Status FROM j WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT 'flags', CASE WHEN list_contains(tf, f) THEN f END, CASE WHEN list_contains(gf, f) THEN f END FROM e)
GROUP BY ALL""", _FACTS), ops=("J8", "K6"))
def manifest_confusion(spark, d):
    """Gold against a truth manifest written and read back as JSON lines: per-class confusion, missing and extra rows.

    The manifest lacks a seventh of the cases and half the scam flags, gold lacks an eleventh of the cases."""
    th = FX.stored_threads(spark, d).where("o_orderkey % 7 <> 0")
    none = F.array().cast("array<string>")
    flags = F.filter(F.coalesce("flags", none), lambda f: (f != "scam") | (F.col("o_orderkey") % 2 == 0))
    facts = th.select("case_ref", "case_type", F.when(F.col("o_orderstatus") == "F", "closed").otherwise("pending").alias("status"), flags.alias("flags"))
    path = f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}"
    facts.write.json(path)
    truth = spark.read.schema("case_ref string, case_type string, status string, flags array<string>").json(path)
    gold = FX.stored_cases(spark, d).where(F.element_at(F.split("Case_Ref", "/"), -1).cast("long") % 11 != 0)
    return A.confusion(truth, gold.select(F.col("Case_Ref").alias("case_ref"), "L1_Case_Type", "L1_Status", "L1_Situational_Flags"),
                       {"case_type": ("case_type", "L1_Case_Type"), "status": ("status", "L1_Status")},
                       {"flags": ("flags", "L1_Situational_Flags")})
