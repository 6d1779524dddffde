"""Streaming queries (T1-T4): availableNow runs over data Spark derives from the tables."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X
from caseflow.operators import extract as E
from caseflow.operators import state as ST
from caseflow.operators import synth as SY
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans import q_text as Q_TEXT
from caseflow.plans.catalog import register
from caseflow.plans.q_generate import truth_sql
from caseflow.session import checkpoint_dir
from caseflow.sources import files as FL
from caseflow.sources import landing as LD
from caseflow.sources.tables import Tables
from caseflow.sources.versioned import VersionedTable
from caseflow.streaming import current as CU
from caseflow.streaming import stream as SM


def _scratch(spark, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "caseflow-derived", name, uuid.uuid4().hex)


@register("stream_ingest", Q_TEXT.PARSED_PAGES_SQL, ops=("T1", "S1", "S2"))
def stream_ingest(spark, d):
    """Pages landed as files in two loads, each picked up once by a stream that stops in between."""
    pages, folder, run = Q_TEXT.page_files(spark, d), _scratch(spark, "landing"), uuid.uuid4().hex
    early = F.pmod(F.xxhash64("path"), F.lit(2)) == 0
    for load in (pages.where(early), pages.where(~early)):
        LD.land(load, folder, "path", "html")
        out = SM.ingest_stream(spark, folder, FL.html_parser, "*.html", run_id=run)
    return out.select("path", "case_ref", F.md5("parsed_text").alias("text_md5"), "parse_error")


def gold_from_text(batch):
    """Batch transform shared by stream and batch: rule enrichment of threads."""
    l2 = E.rule_l2(F.col("parsed_text"))
    return batch.select(
        "case_ref", X.subject_case_type("parsed_text").alias("Case_Type"),
        l2.getField("L1_Status").alias("L1_Status"), l2.getField("L1_Country").alias("L1_Country"),
        F.concat_ws(",", l2.getField("L1_Agencies")).alias("agencies"),
        F.concat_ws(",", l2.getField("L1_Situational_Flags")).alias("flags"),
        X.resolution_days(l2.getField("L1_Status"), F.col("parsed_text")).alias("Resolution_Days"),
        *[c for c in ("_mtime", "_path") if c in batch.columns])


@register("stream_gold", truth_sql(f"""
SELECT case_ref, {S.SUBJECT_TYPE_SQL} AS Case_Type, p_status AS L1_Status, p_country AS L1_Country,
       array_to_string(p_agencies, ',') AS agencies, array_to_string(p_flags, ',') AS flags,
       {S.resolution_sql("p_status", S.DATE_TOKENS_SQL)} AS Resolution_Days
FROM tagged"""), ops=("T2", "X10", "X16"))
def stream_gold(spark, d):
    """Truth threads landed as bronze files, enriched micro-batch by micro-batch."""
    t = Tables(spark, d)
    bronze_dir = _scratch(spark, "bronze")
    th = SY.truth_threads(t.orders, t.lineitem).select("case_ref", "parsed_text")
    th.write.parquet(bronze_dir)
    return SM.gold_stream(spark, bronze_dir, "case_ref string, parsed_text string", gold_from_text)


@register("stream_trend", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
          ops=("T3", "A15"))
def stream_trend(spark, d):
    """Daily event counts per event type, partial counts summed on read."""
    events = SM.table_stream(spark, f"{d}/events.parquet", Tables(spark, d).events.schema)
    out = SM.trend_stream(spark, events, "ts", "event_type")
    return out.select("day", F.col("key").alias("event_type"), "n")


_STATUS_TABLE = (T.StructType().add("case_ref", "string").add("status", "string")
                 .add("at", T.TimestampNTZType()).add("seq", "long"))
_STEP_TABLE = (T.StructType().add("case_ref", "string").add("idx", "integer").add("done", "boolean").add("by", "string")
               .add("at", T.TimestampNTZType()).add("seq", "long"))


def _streamed(spark, name, events, shape, keys):
    """``events`` landed in three loads, the second late and the third with repeats, each streamed into a current table;
    the stream starts again for every load."""
    src, run = _scratch(spark, name), uuid.uuid4().hex
    table = VersionedTable(spark, _scratch(spark, f"{name}-current"), shape, keys, 16)
    part = F.col("seq") % 3
    for load in (part == 1, part == 0, part != 0):
        events.where(load).write.mode("append").parquet(src)
        stream = spark.readStream.schema(shape).parquet(src)
        CU.latest_stream(stream, table, run)
    return table.read()


@register("stream_events", S.sql_with("""
SELECT case_ref, status FROM (
  SELECT case_ref, status, row_number() OVER (PARTITION BY case_ref ORDER BY at_ DESC, seq DESC) AS rn
  FROM status_events) WHERE rn = 1""", S.EVENTS), ops=("T4", "M1", "W2"))
def stream_events(spark, d):
    """Current status of every case out of keyed streaming state, events late and repeated."""
    out = _streamed(spark, "status", FX.status_events(spark, d), _STATUS_TABLE, ("case_ref",))
    return out.select("case_ref", "status")


@register("stream_steps", S.sql_with("""
SELECT case_ref, idx, done FROM (
  SELECT case_ref, idx, done, row_number() OVER (PARTITION BY case_ref, idx ORDER BY at_ DESC, seq DESC) AS rn
  FROM step_events) WHERE rn = 1""", S.EVENTS), ops=("T4", "M2", "M3"))
def stream_steps(spark, d):
    """Current state of every step out of keyed streaming state, events late and repeated."""
    out = _streamed(spark, "steps", FX.step_events(spark, d), _STEP_TABLE, ("case_ref", "idx"))
    return out.select("case_ref", "idx", "done")


@register("stream_flag_trend", S.on_cases("""
SELECT strftime(date_trunc('month', try_strptime(Created_On, '%Y-%m-%d')), '%Y-%m-%d') AS month, flag, count(*) AS n,
       count(*) FILTER (Created_On < '1997' AND CAST(string_split(Case_Ref, '/')[3] AS BIGINT) % 10 = 0) AS n_late
FROM (SELECT Case_Ref, Created_On, unnest(L1_Situational_Flags) AS flag FROM cases) GROUP BY 1, 2"""), ops=("T3", "A15"))
def stream_flag_trend(spark, d):
    """Monthly flags by event-time windows: cases before 1997, then the later ones, then a tenth of the former, late, with repeats."""
    gold = FX.stored_cases(spark, d)
    last = F.element_at(F.split("Case_Ref", "/"), -1).cast("long") % 10
    cases = gold.select(F.col("Case_Ref").alias("id"), F.to_timestamp_ntz("Created_On", F.lit("yyyy-MM-dd")).alias("created"),
                        F.col("L1_Situational_Flags").alias("flags"), last.alias("last"))
    src, run, early = _scratch(spark, "flags"), uuid.uuid4().hex, F.year("created") < 1997
    for load in (early & (F.col("last") != 0), ~early, early & (F.col("last") <= 1)):
        cases.where(load).drop("last").write.mode("append").parquet(src)
        out = CU.flag_trend(spark.readStream.schema(cases.drop("last").schema).parquet(src), run)
    return out

