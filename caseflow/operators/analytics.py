"""Case analytics (A1-A21, J6, F4-F5 saved questions) as DataFrame aggregations.

All aggregates are algebraic (count / sum / avg / min / max / collect_set over
closed vocabularies), so Spark computes them partially before the shuffle and a
hot key costs one partial row per task, not a third of the data in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as X

CLOSED = "Closed"


def _round_avg(c: Column, digits: int) -> Column:
    return F.round(F.avg(c).cast("double"), digits)


# --- QA stats (A1-A3) ---------------------------------------------------------

def parse_stats(bronze: DataFrame) -> DataFrame:
    """total, with text, with reference, with parse error (one pass)."""
    err = F.col("parse_error")
    return bronze.agg(
        F.count(F.lit(1)).alias("total"),
        F.count(X.blank_to_null("parsed_text")).alias("with_text"),
        F.count("case_ref").alias("with_ref"),
        F.count(F.when(err.isNotNull() & (err.cast("string") != "null"), F.lit(1))).alias("errors"),
    )


def extract_stats(record: DataFrame) -> DataFrame:
    """rows, distinct recorded types, NULL locations, populated MP names."""
    mp = F.col("MP_Name") if "MP_Name" in record.columns else F.lit(None).cast("string")
    return record.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("Case_Type").alias("n_types"),
        F.count(F.when(F.col("Case_Location").isNull(), F.lit(1))).alias("null_locations"),
        F.count(mp).alias("mp_names"),
    )


def enrich_stats(gold: DataFrame) -> DataFrame:
    return gold.agg(
        _round_avg(F.size("L1_Agencies"), 2).alias("avg_agencies"),
        _round_avg(F.size("L1_Situational_Flags"), 2).alias("avg_flags"),
        F.count("Resolution_Days").alias("n_resolved"),
        _round_avg(F.col("Resolution_Days"), 1).alias("avg_days"),
    )


# --- KPI and distributions (A4-A11) -------------------------------------------

def kpi(gold: DataFrame) -> DataFrame:
    """total, closed (case-sensitive 'Closed', Q12), mean resolution (1 dp)."""
    return gold.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum(F.when(F.col("Case_Status") == CLOSED, 1).otherwise(0)).cast("bigint").alias("closed"),
        _round_avg(F.col("Resolution_Days"), 1).alias("avg_days"),
    )


def count_by(gold: DataFrame, *cols: str, name: str = "n") -> DataFrame:
    """Group count, largest first, equal counts by key; a NULL key is its own group, last among equals."""
    return largest_first(gold.groupBy(*cols).agg(F.count(F.lit(1)).alias(name)), name, *cols)


def largest_first(counts: DataFrame, n: str, *cols: str) -> DataFrame:
    """The declared order of a series: count descending, then its keys."""
    return counts.orderBy(F.col(n).desc(), *[F.col(c).asc_nulls_last() for c in cols])


def resolution_by_type(gold: DataFrame) -> DataFrame:
    return (gold.where(F.col("Resolution_Days").isNotNull())
            .groupBy("Case_Type")
            .agg(_round_avg(F.col("Resolution_Days"), 1).alias("avg_days"),
                 F.count("Resolution_Days").alias("closed"))
            .orderBy(F.col("avg_days").desc(), F.col("Case_Type").asc_nulls_last()))


def type_by_country(gold: DataFrame) -> DataFrame:
    return count_by(gold, "L1_Country", "Case_Type")


def type_country_matrix(gold: DataFrame, types: list[str]) -> DataFrame:
    """Heat-map form: one row per country, one column per listed type."""
    return gold.groupBy("L1_Country").pivot("Case_Type", types).agg(F.count(F.lit(1)))


# --- Arrays: flags and agencies (A12-A15, J6) ---------------------------------

def flag_counts(gold: DataFrame) -> DataFrame:
    """Explode drops cases with empty arrays (Q21)."""
    return count_by(gold.select(F.explode("L1_Situational_Flags").alias("flag")), "flag")


def agency_pairs(gold: DataFrame) -> DataFrame:
    """Unordered co-involvement pairs ``a1 < a2`` inside each case's array.

    Pairs are generated per row from the (deduplicated) array itself, so no
    join and no shuffle happens before the final count; the array is a closed
    vocabulary, so a case yields a bounded number of pairs.
    """
    arr = F.array_distinct(F.col("L1_Agencies"))
    pairs = F.flatten(F.transform(arr, lambda a: F.transform(
        F.filter(arr, lambda b: a < b), lambda b: F.struct(a.alias("a1"), b.alias("a2")))))
    return count_by(gold.select(F.explode(pairs).alias("p")).select("p.a1", "p.a2"), "a1", "a2", name="pair_count")


def flag_country(gold: DataFrame, flag: str) -> DataFrame:
    """Countries by count of cases carrying ``flag``."""
    return count_by(gold.where(F.array_contains("L1_Situational_Flags", flag)), "L1_Country")


def flag_trend_month(gold: DataFrame) -> DataFrame:
    """Monthly count per flag; month as ``yyyy-MM-01``."""
    month = F.date_trunc("month", F.try_to_date(F.col("Created_On"), "yyyy-MM-dd"))
    return (gold.select(F.date_format(month, "yyyy-MM-dd").alias("month"),
                        F.explode("L1_Situational_Flags").alias("flag"))
            .groupBy("month", "flag").agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("month").asc_nulls_last(), F.col("flag").asc_nulls_last()))


# --- Accuracy (A16) -------------------------------------------------------------

def _agree(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def tag_accuracy(gold: DataFrame, with_mission: bool = True) -> DataFrame:
    """Derived-vs-recorded agreement over rows with both case types.

    A NULL mission counts as a miss (Q13)."""
    base = gold.where(F.col("Case_Type").isNotNull() & F.col("L1_Case_Type").isNotNull())
    aggs = [F.round(F.avg(F.when(_agree(F.col("L1_Case_Type"), F.col("Case_Type")), 1.0).otherwise(0.0)), 3)
            .alias("case_type_agreement")]
    if with_mission:
        hit = (F.col("L1_Mission").isNotNull() & F.col("Assigned_HCG").isNotNull()
               & _agree(F.col("L1_Mission"), F.col("Assigned_HCG")))
        aggs.append(F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 3).alias("mission_agreement"))
    aggs.append(F.count(F.lit(1)).alias("n_cases"))
    return base.agg(*aggs)


# --- Facets (A17) ---------------------------------------------------------------

def facets(gold: DataFrame) -> DataFrame:
    """Distinct filter values ``(facet, value)`` in one scan, sorted; NULL/'' dropped."""
    def kv(k: str, v: Column) -> Column:
        return F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value"))
    scalars = F.array(kv("case_type", F.col("Case_Type")), kv("country", F.col("L1_Country")),
                      kv("status", F.col("Case_Status")))
    flags = F.transform(F.coalesce(F.col("L1_Situational_Flags"), F.array().cast("array<string>")),
                        lambda f: kv("flag", f))
    return (gold.select(F.explode(F.concat(scalars, flags)).alias("fv"))
            .select("fv.facet", "fv.value")
            .where(F.col("value").isNotNull() & (F.col("value") != ""))
            .distinct().orderBy("facet", "value"))


# --- Dashboard bundle (A20) --------------------------------------------------------

def dashboard_bundle(gold: DataFrame) -> DataFrame:
    """KPI and five series from two scans of gold.

    One ``GROUPING SETS`` aggregation yields the KPI row (``dim='kpi'``), the
    by-type, by-country and by-mission counts and the resolution means; one
    exploded pass yields the flag counts. Columns: ``dim, k, n, closed,
    avg_days``.
    """
    closed = F.when(F.col("Case_Status") == CLOSED, 1).otherwise(0)
    g = gold.select("Case_Type", "L1_Country", "Assigned_HCG", "Case_Status", "Resolution_Days")
    sets = (g.groupingSets([["Case_Type"], ["L1_Country"], ["Assigned_HCG"], []],
                           "Case_Type", "L1_Country", "Assigned_HCG")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(closed).cast("bigint").alias("closed"),
                 _round_avg(F.col("Resolution_Days"), 1).alias("avg_days"),
                 F.grouping_id().alias("gid")))
    # grouping_id bits: Case_Type=4, L1_Country=2, Assigned_HCG=1 (1 = aggregated away)
    dim = (F.when(F.col("gid") == 3, F.lit("type")).when(F.col("gid") == 5, F.lit("country"))
           .when(F.col("gid") == 6, F.lit("mission")).otherwise(F.lit("kpi")))
    key = F.coalesce(*[F.when(F.col("gid") == g_, F.col(c)) for g_, c in
                       ((3, "Case_Type"), (5, "L1_Country"), (6, "Assigned_HCG"))])
    main = sets.select(dim.alias("dim"), key.alias("k"), "n", "closed", "avg_days")
    flags = (gold.select(F.explode("L1_Situational_Flags").alias("k"))
             .groupBy("k").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit("flag").alias("dim"), "k", "n", F.lit(None).cast("bigint").alias("closed"),
                     F.lit(None).cast("double").alias("avg_days")))
    return main.unionByName(flags)


# --- Saved questions (F4, F5) -----------------------------------------------------

def in_last_months(created_on: Column, as_of: Column, months: int = 12) -> Column:
    """``to_date(Created_On) >= add_months(as_of, -months)``; bad dates drop out."""
    return F.try_to_date(created_on, "yyyy-MM-dd") >= F.add_months(as_of, -months)


def leak_check(chunks: DataFrame, text_col: str = "chunk", raw_col: str | None = None) -> DataFrame:
    """Chunks still carrying a national id, NULL chunks (Q4) and,
    when ``raw_col`` is given, ids present before the scrub - one pass."""
    c = F.col(text_col)
    aggs = [F.count(F.lit(1)).alias("n_chunks"),
            F.count(F.when(X.has_national_id(c), F.lit(1))).alias("leaks"),
            F.count(F.when(c.isNull(), F.lit(1))).alias("null_chunks")]
    if raw_col:
        aggs.append(F.count(F.when(X.has_national_id(F.col(raw_col)), F.lit(1))).alias("raw_ids"))
    return chunks.agg(*aggs)


# --- Accuracy against a manifest (J8) ------------------------------------------------

def confusion(truth: DataFrame, found: DataFrame, scalars: dict[str, tuple[str, str]], sets: dict[str, tuple[str, str]],
              key: str = "case_ref") -> DataFrame:
    """``(field, truth, found, n)``: how often each true class came out as each found one.

    ``scalars`` and ``sets`` name the truth's and the result's column of a field; an element of a
    set counts by itself, with a null on the side that lacks it. Classes are compared on keys that
    both sides have. The field ``row`` counts keys: both sides ``yes``, or null where one is missing."""
    t = truth.select(key, F.struct("*").alias("t"))
    j = t.join(found.select(key, F.struct("*").alias("f")), key, "full_outer")
    both = F.col("t").isNotNull() & F.col("f").isNotNull()
    cell = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.cast("string").alias("truth"), b.cast("string").alias("found"))
    yes = lambda c: F.when(F.col(c).isNotNull(), F.lit("yes"))
    parts = [F.array(cell("row", yes("t"), yes("f")))]
    parts += [F.when(both, F.array(cell(f, F.col(f"t.{a}"), F.col(f"f.{b}")))) for f, (a, b) in scalars.items()]
    none = F.array().cast("array<string>")

    def elements(field: str, x: Column, y: Column) -> Column:
        here = lambda s, e: F.when(F.array_contains(s, e), e)
        return F.transform(F.array_union(x, y), lambda e: cell(field, here(x, e), here(y, e)))

    parts += [F.when(both, elements(f, F.coalesce(f"t.{a}", none), F.coalesce(f"f.{b}", none))) for f, (a, b) in sets.items()]
    cells = j.select(F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("c")).select("c.*")
    return cells.groupBy("field", "truth", "found").agg(F.count(F.lit(1)).alias("n"))
