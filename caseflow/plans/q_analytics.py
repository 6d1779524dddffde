"""Analytics and saved-question queries over the gold surrogate."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import analytics as A
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register

# Parameters of the saved questions, fixed so that results are reproducible.
SAVED_AS_OF = "1998-08-01"          # stands in for current_date()
SAVED_TYPE = "Arrest & Detention"
SAVED_COUNTRY = "NATION_3"
SAVED_AGENCY = "RF"
SAVED_FLAG_A = "scam"
SAVED_FLAG_B = "language barrier"
WELFARE = "welfare concern"


@register("kpi", S.on_cases("""
SELECT count(*) AS total, CAST(sum(CASE WHEN Case_Status = 'Closed' THEN 1 ELSE 0 END) AS BIGINT) AS closed,
       round(avg(Resolution_Days), 1) AS avg_days FROM cases"""), ops=("A4",))
def kpi(spark, d):
    """Total cases, closed cases, mean resolution days."""
    return A.kpi(FX.stored_cases(spark, d))


def _count_by(col: str, name: str, op: str):
    def q(spark, d):
        return A.count_by(FX.stored_cases(spark, d), col)
    q.__doc__ = f"Case count by {col}."
    return register(name, S.on_cases(f"SELECT {col}, count(*) AS n FROM cases GROUP BY {col}"), ops=(op,))(q)


by_type = _count_by("Case_Type", "by_type", "A5")
by_country = _count_by("L1_Country", "by_country", "A7")
by_mission = _count_by("Assigned_HCG", "by_mission", "A8")
by_handler = _count_by("Case_Handler", "by_handler", "A9")


@register("type_by_country", S.on_cases("""
SELECT L1_Country, Case_Type, count(*) AS n FROM cases GROUP BY L1_Country, Case_Type"""), ops=("A10",))
def type_by_country(spark, d):
    """Two-key distribution: country x recorded type."""
    return A.type_by_country(FX.stored_cases(spark, d))


@register("flag_counts", S.on_cases("""
SELECT flag, count(*) AS n FROM (SELECT unnest(L1_Situational_Flags) AS flag FROM cases) GROUP BY flag"""),
          ops=("A12",))
def flag_counts(spark, d):
    """Frequency of each situational flag (exploded)."""
    return A.flag_counts(FX.stored_cases(spark, d))


@register("agency_pairs", S.on_cases("""
SELECT a1, a2, count(*) AS pair_count FROM (
  SELECT x.a1, y.a2 FROM cases,
    LATERAL (SELECT unnest(list_distinct(L1_Agencies)) AS a1) x,
    LATERAL (SELECT unnest(list_distinct(L1_Agencies)) AS a2) y
  WHERE x.a1 < y.a2) GROUP BY a1, a2"""), ops=("J6", "A13"))
def agency_pairs(spark, d):
    """Agency co-involvement: unordered pairs inside each case."""
    return A.agency_pairs(FX.stored_cases(spark, d))


@register("welfare_by_country", S.on_cases(f"""
SELECT L1_Country, count(*) AS n FROM cases
WHERE list_contains(L1_Situational_Flags, '{WELFARE}') GROUP BY L1_Country"""), ops=("A14", "F2"))
def welfare_by_country(spark, d):
    """Countries by number of welfare-concern cases."""
    return A.flag_country(FX.stored_cases(spark, d), WELFARE)


@register("flag_trend_month", S.on_cases("""
SELECT strftime(date_trunc('month', try_strptime(Created_On, '%Y-%m-%d')), '%Y-%m-%d') AS month, flag,
       count(*) AS n
FROM (SELECT Created_On, unnest(L1_Situational_Flags) AS flag FROM cases) GROUP BY 1, 2"""), ops=("A15",))
def flag_trend_month(spark, d):
    """Monthly count per situational flag."""
    return A.flag_trend_month(FX.stored_cases(spark, d))


@register("tag_accuracy", S.on_cases("""
SELECT CAST(round(avg(CASE WHEN lower(trim(L1_Case_Type)) = lower(trim(Case_Type)) THEN 1.0 ELSE 0.0 END), 3) AS DOUBLE)
         AS case_type_agreement,
       CAST(round(avg(CASE WHEN L1_Mission IS NOT NULL AND Assigned_HCG IS NOT NULL
                            AND lower(trim(L1_Mission)) = lower(trim(Assigned_HCG)) THEN 1.0 ELSE 0.0 END), 3) AS DOUBLE)
         AS mission_agreement,
       count(*) AS n_cases
FROM cases WHERE Case_Type IS NOT NULL AND L1_Case_Type IS NOT NULL"""), ops=("A16",))
def tag_accuracy(spark, d):
    """Agreement of derived vs recorded case type and mission."""
    return A.tag_accuracy(FX.stored_cases(spark, d))


@register("facets", S.on_cases("""
SELECT DISTINCT facet, value FROM (
  SELECT 'case_type' AS facet, Case_Type AS value FROM cases
  UNION ALL SELECT 'country', L1_Country FROM cases
  UNION ALL SELECT 'status', Case_Status FROM cases
  UNION ALL SELECT 'flag', unnest(L1_Situational_Flags) FROM cases)
WHERE value IS NOT NULL AND value <> ''"""), ops=("A17", "D1"))
def facets(spark, d):
    """Distinct filter values per facet in one scan."""
    return A.facets(FX.stored_cases(spark, d))


@register("dashboard_bundle", S.on_cases("""
SELECT CASE grouping(Case_Type, L1_Country, Assigned_HCG) WHEN 3 THEN 'type' WHEN 5 THEN 'country'
            WHEN 6 THEN 'mission' ELSE 'kpi' END AS dim,
       CASE grouping(Case_Type, L1_Country, Assigned_HCG) WHEN 3 THEN Case_Type WHEN 5 THEN L1_Country
            WHEN 6 THEN Assigned_HCG END AS k,
       count(*) AS n, CAST(sum(CASE WHEN Case_Status = 'Closed' THEN 1 ELSE 0 END) AS BIGINT) AS closed,
       round(avg(Resolution_Days), 1) AS avg_days
FROM cases GROUP BY GROUPING SETS ((Case_Type), (L1_Country), (Assigned_HCG), ())
UNION ALL
SELECT 'flag', flag, count(*), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE)
FROM (SELECT unnest(L1_Situational_Flags) AS flag FROM cases) GROUP BY flag"""), ops=("A20",))
def dashboard_bundle(spark, d):
    """KPI and series for the dashboard: grouping sets over one scan + flags."""
    return A.dashboard_bundle(FX.stored_cases(spark, d))


@register("type_country_agency_12m", S.on_cases(f"""
SELECT Case_Ref, Case_Location, Case_Status, Created_On FROM cases
WHERE Case_Type = '{SAVED_TYPE}' AND L1_Country = '{SAVED_COUNTRY}'
  AND list_contains(L1_Agencies, '{SAVED_AGENCY}')
  AND CAST(try_strptime(Created_On, '%Y-%m-%d') AS DATE) >= DATE '{SAVED_AS_OF}' - INTERVAL 12 MONTH"""),
          ops=("F1", "F2", "F4"))
def type_country_agency_12m(spark, d):
    """Saved question: one type, one country, one agency, last 12 months."""
    g = FX.stored_cases(spark, d)
    cond = ((F.col("Case_Type") == SAVED_TYPE) & (F.col("L1_Country") == SAVED_COUNTRY)
            & F.array_contains("L1_Agencies", SAVED_AGENCY)
            & A.in_last_months(F.col("Created_On"), F.to_date(F.lit(SAVED_AS_OF)), 12))
    return g.where(cond).select("Case_Ref", "Case_Location", "Case_Status", "Created_On")


@register("flag_conjunction", S.on_cases(f"""
SELECT Case_Ref, Case_Location, Case_Status FROM cases
WHERE list_contains(L1_Situational_Flags, '{SAVED_FLAG_A}')
  AND list_contains(L1_Situational_Flags, '{SAVED_FLAG_B}')"""), ops=("F5",))
def flag_conjunction(spark, d):
    """Saved question: cases carrying two given flags."""
    g = FX.stored_cases(spark, d)
    return (g.where(F.array_contains("L1_Situational_Flags", SAVED_FLAG_A)
                    & F.array_contains("L1_Situational_Flags", SAVED_FLAG_B))
            .select("Case_Ref", "Case_Location", "Case_Status"))
