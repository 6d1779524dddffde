"""Case-list serving: filters, token search, sorts, paging, lookup.

A :class:`CaseQuery` compiles to one Column predicate and one sort order, so
the list, its count and its facets are plain DataFrame plans over gold. Search
strings are parameters, never spliced into SQL text (Q17).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Search columns, stop words, sort names and list projection
# as the reference's case console defines them.
# ---------------------------------------------------------------------------
SEARCH_COLUMNS = ["Case_Ref", "Case_Type", "L1_Country", "Case_Location", "Assigned_HCG",
                  "Case_Description", "Case_Title", "Case_Subject", "Citizenship"]
STOP_WORDS = frozenset({"case", "cases", "the", "a", "an", "in", "of", "for", "from", "and", "to",
                        "with", "on", "last", "this", "show", "me", "all", "find"})
MIN_TOKEN_CHARS = 2
PAGE_SIZE = 20
DEFAULT_SORT = "newest"
SORTS = ("newest", "oldest", "res_asc", "res_desc")
LIST_COLUMNS = [("Case_Ref", "Case_Ref"), ("Case_Type", "Case_Type"), ("L1_Country", "Country"),
                ("Assigned_HCG", "Mission"), ("Case_Status", "Status"), ("Created_On", "Created_On"),
                ("Resolution_Days", "Resolution_Days")]
LOOKUP_COLUMNS = ["Case_Ref", "Case_Type", "Case_Status", "Case_Handler", "Assigned_HCG", "L1_Country",
                  "L1_Agencies", "L1_Situational_Flags", "Resolution_Days", "Title_Name",
                  "Case_Description", "L2_Summary_Pathway", "L2_Assistance_Req_vs_Provided",
                  "L2_Complications_Delays", "L2_External_Resources", "L2_Lessons_Learnt"]


@dataclass
class CaseQuery:
    """Filters (absent/empty = no filter), free text, sort and page."""
    case_type: str | None = None
    country: str | None = None
    status: str | None = None
    flag: str | None = None
    q: str | None = None
    sort: str = DEFAULT_SORT
    page: int = 0
    size: int = PAGE_SIZE
    extra: list = field(default_factory=list)   # extra Column predicates (row policies)


def search_tokens(q: str) -> list[str]:
    """Blank-split tokens minus stop words and 1-char tokens; if none remain
    the whole phrase is the single token (Q14)."""
    toks = [t for t in q.split() if t.lower() not in STOP_WORDS and len(t) >= MIN_TOKEN_CHARS]
    return toks or [q]


def like_escape(s: str) -> str:
    """Escape LIKE metacharacters so ``50%`` means a literal percent (Q14)."""
    return s.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


BLOB_SEPARATOR = "\u0000"   # joins the searched columns; a token holding it is searched per column


def searched_text(df: DataFrame) -> Column:
    """The searched columns that ``df`` has, lower-cased and joined by the separator."""
    return F.lower(F.concat_ws(BLOB_SEPARATOR, *[F.col(c) for c in SEARCH_COLUMNS if c in df.columns]))


def token_predicate(df: DataFrame, q: str) -> Column:
    """Every token must occur (case-insensitive substring) in some column.

    Only columns present in ``df`` are searched (Q15). The searched columns
    are lower-cased once into one separator-joined text per row, so a token
    costs one ``contains`` instead of one ``ILIKE`` per column; a token that
    contains the separator (so could match across two columns) is searched
    column by column with an escaped ``ILIKE`` instead. Both forms give the
    same answer as the reference's per-column ``ILIKE '%t%'``."""
    cols = [c for c in SEARCH_COLUMNS if c in df.columns]
    blob = searched_text(df)
    per_token = []
    for t in search_tokens(q):
        if BLOB_SEPARATOR in t:
            pat = "%" + like_escape(t) + "%"
            per_token.append(reduce(lambda a, b: a | b,
                                    [F.coalesce(F.col(c).ilike(pat), F.lit(False)) for c in cols]))
        else:
            per_token.append(blob.contains(F.lit(t.lower())))
    return reduce(lambda a, b: a & b, per_token)


def predicate(df: DataFrame, cq: CaseQuery) -> Column:
    conds: list[Column] = []
    if cq.case_type:
        conds.append(F.col("Case_Type") == F.lit(cq.case_type))
    if cq.country:
        conds.append(F.col("L1_Country") == F.lit(cq.country))
    if cq.status:
        conds.append(F.col("Case_Status") == F.lit(cq.status))
    if cq.flag:
        conds.append(F.coalesce(F.array_contains("L1_Situational_Flags", cq.flag), F.lit(False)))
    if cq.q:
        conds.append(token_predicate(df, cq.q))
    conds.extend(cq.extra)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)


def filtered(df: DataFrame, cq: CaseQuery) -> DataFrame:
    return df.where(predicate(df, cq))


def sort_order(sort: str) -> list[Column]:
    """Sort columns; every order ends in ``Case_Ref`` so pages never repeat
    or skip rows on ties (Q16). Unknown names fall back to newest (O4)."""
    created = F.try_to_date(F.col("Created_On"), "yyyy-MM-dd")
    ref = F.col("Case_Ref")
    if sort == "oldest":
        return [created.asc_nulls_first(), ref.asc()]
    if sort == "res_asc":
        return [F.col("Resolution_Days").asc_nulls_last(), created.desc_nulls_last(), ref.desc()]
    if sort == "res_desc":
        return [F.col("Resolution_Days").desc_nulls_last(), created.desc_nulls_last(), ref.desc()]
    return [created.desc_nulls_last(), ref.desc()]


def list_projection(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(src).alias(dst) for src, dst in LIST_COLUMNS])


def list_page(df: DataFrame, cq: CaseQuery) -> DataFrame:
    """One page: filter, sort, ``OFFSET page*size LIMIT size``.

    Catalyst plans a ``TakeOrderedAndProject`` (top-N per task, then merge), so
    no full sort of gold happens for shallow pages. Deep pages should use
    :func:`list_after` instead.
    """
    return list_projection(filtered(df, cq).orderBy(*sort_order(cq.sort))
                           .offset(cq.page * cq.size).limit(cq.size))


def list_after(df: DataFrame, cq: CaseQuery, after_created: str | None, after_ref: str | None) -> DataFrame:
    """Keyset page for the ``newest`` order: rows strictly after the last
    ``(Created_On, Case_Ref)`` seen; cost does not grow with page depth. Cases
    without a parseable date come last, so after a dated row they all remain,
    and after an undated one only undated smaller references do."""
    base = filtered(df, cq)
    if after_ref is not None:
        created = F.try_to_date(F.col("Created_On"), "yyyy-MM-dd")
        ac = F.try_to_date(F.lit(after_created).cast("string"), "yyyy-MM-dd")
        smaller = F.col("Case_Ref") < F.lit(after_ref)
        dated = (created < ac) | ((created == ac) & smaller) | created.isNull()
        base = base.where(F.when(ac.isNull(), created.isNull() & smaller).otherwise(dated))
    return list_projection(base.orderBy(*sort_order("newest")).limit(cq.size))


def count_cases(df: DataFrame, cq: CaseQuery) -> DataFrame:
    """One-row count for the same predicate as the page."""
    return filtered(df, cq).agg(F.count(F.lit(1)).alias("total"))


def lookup(df: DataFrame, ref: str) -> DataFrame:
    """F8: one case by reference (parameter, compared as a value)."""
    cols = [c for c in LOOKUP_COLUMNS if c in df.columns]
    return df.where(F.col("Case_Ref") == F.lit(ref)).select(*cols).limit(1)


def lookup_many(df: DataFrame, refs: DataFrame, ref_col: str = "case_ref") -> DataFrame:
    """Batch form of F8: join a table of references to gold (left semi)."""
    cols = [c for c in LOOKUP_COLUMNS if c in df.columns]
    keys = refs.select(F.col(ref_col).alias("Case_Ref")).where(F.col("Case_Ref").isNotNull())
    return df.join(keys, "Case_Ref", "left_semi").select(*cols)
