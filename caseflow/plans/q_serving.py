"""Serving queries: filters, token search, sorted pages, counts, lookup."""

from __future__ import annotations

from caseflow.operators import serving as SV
from caseflow.operators import text_index as TI
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register

_LIST = ", ".join(f"{src} AS {dst}" for src, dst in SV.LIST_COLUMNS)
_CREATED = "CAST(try_strptime(Created_On, '%Y-%m-%d') AS DATE)"
_SQL_SORTS = {
    "newest": f"{_CREATED} DESC NULLS LAST, Case_Ref DESC",
    "oldest": f"{_CREATED} ASC NULLS FIRST, Case_Ref ASC",
    "res_asc": f"Resolution_Days ASC NULLS LAST, {_CREATED} DESC NULLS LAST, Case_Ref DESC",
    "res_desc": f"Resolution_Days DESC NULLS LAST, {_CREATED} DESC NULLS LAST, Case_Ref DESC",
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_predicate(cq: SV.CaseQuery) -> str:
    """DuckDB twin of :func:`caseflow.operators.serving.predicate`."""
    conds = []
    if cq.case_type:
        conds.append(f"Case_Type = {_q(cq.case_type)}")
    if cq.country:
        conds.append(f"L1_Country = {_q(cq.country)}")
    if cq.status:
        conds.append(f"Case_Status = {_q(cq.status)}")
    if cq.flag:
        conds.append(f"coalesce(list_contains(L1_Situational_Flags, {_q(cq.flag)}), false)")
    if cq.q:
        for t in SV.search_tokens(cq.q):
            pat = _q("%" + SV.like_escape(t) + "%")
            conds.append("(" + " OR ".join(f"coalesce({c} ILIKE {pat} ESCAPE '\\', false)"
                                           for c in SV.SEARCH_COLUMNS) + ")")
    return " AND ".join(conds) if conds else "TRUE"


def sql_page(cq: SV.CaseQuery) -> str:
    return S.on_cases(f"""
SELECT {_LIST} FROM cases WHERE {sql_predicate(cq)}
ORDER BY {_SQL_SORTS.get(cq.sort, _SQL_SORTS['newest'])} LIMIT {cq.size} OFFSET {cq.page * cq.size}""")


def _page_query(name: str, cq: SV.CaseQuery, ops: tuple[str, ...], doc: str):
    def q(spark, d):
        return SV.list_page(FX.stored_cases(spark, d), cq)
    q.__doc__ = doc
    return register(name, sql_page(cq), ops=ops)(q)


list_newest = _page_query("list_newest", SV.CaseQuery(), ("O1", "O5"), "First page, newest first.")
list_oldest = _page_query("list_oldest", SV.CaseQuery(sort="oldest"), ("O2", "O5"), "First page, oldest first.")
list_res_asc = _page_query("list_res_asc", SV.CaseQuery(sort="res_asc", page=2), ("O3", "O5"),
                           "Third page, shortest resolution first, NULLs last.")
list_res_desc = _page_query("list_res_desc", SV.CaseQuery(sort="res_desc"), ("O3", "O5"),
                            "First page, longest resolution first, NULLs last.")
list_unknown_sort = _page_query("list_unknown_sort", SV.CaseQuery(sort="no_such_sort", page=1), ("O4",),
                                "Unknown sort name falls back to newest.")

PAGE_QUERY = SV.CaseQuery(status="Closed", q="scam in nation_1", sort="res_desc", page=1)
list_page = _page_query("list_page", PAGE_QUERY, ("O5", "F1", "F3"),
                        "Filtered, searched, sorted second page.")

EQ_QUERY = SV.CaseQuery(case_type="Evacuation", country="NATION_7", status="In Progress")
FLAG_QUERY = SV.CaseQuery(flag="language barrier", country="NATION_12")
SEARCH_QUERY = SV.CaseQuery(q="the victim of crime NATION_2 50%")
SEARCH_FALLBACK = SV.CaseQuery(q="the of")


def _filter_query(name: str, cq: SV.CaseQuery, ops: tuple[str, ...], doc: str):
    def q(spark, d):
        return SV.list_projection(SV.filtered(FX.stored_cases(spark, d), cq))
    q.__doc__ = doc
    return register(name, S.on_cases(f"SELECT {_LIST} FROM cases WHERE {sql_predicate(cq)}"), ops=ops)(q)


filter_equality = _filter_query("filter_equality", EQ_QUERY, ("F1",), "AND of equality filters.")
filter_flag = _filter_query("filter_flag", FLAG_QUERY, ("F2", "F1"), "Array-membership filter.")
token_search = _filter_query("token_search", SV.CaseQuery(q="scam in nation_1"), ("F3",),
                             "Token search: each token in some column, case-insensitive.")
token_search_literal = _filter_query("token_search_literal", SEARCH_QUERY, ("F3",),
                                     "Token search with a literal percent sign.")
token_search_fallback = _filter_query("token_search_fallback", SEARCH_FALLBACK, ("F3",),
                                      "All-stop-word query searched as one phrase.")


_INDEXED = SV.CaseQuery(q="SGCON/1995/1 scam nation_1")


@register("token_search_indexed", S.on_cases(f"SELECT {_LIST} FROM cases WHERE {sql_predicate(_INDEXED)}"), ops=("F3",))
def token_search_indexed(spark, d):
    """Token search that reads only files whose n-gram lists hold every token."""
    return SV.list_projection(TI.search(spark, FX.stored_gold(spark, d), FX.gold_index(spark, d), _INDEXED))


@register("filtered_count", S.on_cases(f"SELECT count(*) AS total FROM cases WHERE {sql_predicate(PAGE_QUERY)}"),
          ops=("A18",))
def filtered_count(spark, d):
    """Total rows for the filter set of ``list_page``."""
    return SV.count_cases(FX.stored_cases(spark, d), PAGE_QUERY)


LOOKUP_REF = "SGCON/1997/10001"


@register("case_lookup", S.on_cases(f"""
SELECT Case_Ref, Case_Type, Case_Status, Case_Handler, Assigned_HCG, L1_Country,
       array_to_string(L1_Agencies, ',') AS L1_Agencies, array_to_string(L1_Situational_Flags, ',') AS L1_Situational_Flags,
       Resolution_Days, Title_Name, Case_Description, L2_Summary_Pathway,
       CAST(NULL AS VARCHAR) AS L2_Assistance_Req_vs_Provided, L2_Complications_Delays,
       CAST(NULL AS VARCHAR) AS L2_External_Resources, CAST(NULL AS VARCHAR) AS L2_Lessons_Learnt
FROM cases WHERE Case_Ref = {_q(LOOKUP_REF)} LIMIT 1"""), ops=("F8",))
def case_lookup(spark, d):
    """Point lookup of one case, 16 columns."""
    from pyspark.sql import functions as F
    r = SV.lookup(FX.stored_cases(spark, d), LOOKUP_REF)
    return (r.withColumn("L1_Agencies", F.concat_ws(",", "L1_Agencies"))
             .withColumn("L1_Situational_Flags", F.concat_ws(",", "L1_Situational_Flags")))
