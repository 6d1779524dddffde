"""Case fixtures bound to the driver tables (Spark side).

``threads``  bronze surrogate ``(case_ref, parsed_text, ...)``: one e-mail style
             thread per order, facts taken from orders, customer, nation,
             region and the order's line items.
``cases``    gold surrogate: the real pipeline (record mapping, enrichment,
             gold join, resolution days) run over ``threads``; the model output
             is replaced by fields Spark derives from the same tables.
``sop``      procedure chunks, one per case type.

Every builder reads the given tables, so its work grows with them. The DuckDB
twins live in :mod:`caseflow.plans.fixtures_sql`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import record as R
from caseflow.functions import text as X
from caseflow.operators import text_index
from caseflow.operators.gold import build_gold, build_gold_staged
from caseflow.session import checkpoint_dir, shuffles_dropped
from caseflow.sources.sinks import write_gold
from caseflow.sources.tables import Tables, spread

# The six case types, in reference order.
CASE_TYPES = ["Arrest & Detention", "Serious Illness/Death", "Victim of Crime",
              "Lost/Stolen Document", "Evacuation", "Scam"]

# Load time used by fixtures so checksums and record rows are reproducible.
FIXTURE_LOADED_AT = "2024-01-01 00:00:00"


def flag_of_discount(d: Column) -> Column:
    """Situational flag stand-in: discount buckets."""
    return (F.when(d < 0.02, F.lit("scam"))
            .when(d < 0.04, F.lit("welfare concern"))
            .when(d < 0.05, F.lit("language barrier")))


def line_facts(lineitem: DataFrame) -> DataFrame:
    """Per order: last ship date, agency codes, flags.

    ``collect_set`` runs over a closed vocabulary (6 codes, 3 flags), so the
    partial aggregate of a hot order is at most 9 values before the shuffle.
    """
    return lineitem.groupBy("l_orderkey").agg(
        F.max("l_shipdate").alias("last_ship"),
        F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("codes"),
        F.array_sort(F.collect_set(flag_of_discount(F.col("l_discount")))).alias("flags"),
    )


def _case_type(orderkey: Column) -> Column:
    types = F.array(*[F.lit(t) for t in CASE_TYPES])
    return F.element_at(types, (orderkey % F.lit(len(CASE_TYPES))).cast("int") + F.lit(1))


TASK_ROWS = 150_000  # orders of one task, once they are widened to threads or gold


def order_facts(t: Tables) -> DataFrame:
    """orders ⋈ customer ⋈ (nation ⋈ region) ⋈ line facts, one row per order.

    Adaptive execution sizes the join's tasks by these narrow rows; a gold row is many times as
    wide and sorted before it is stored, so a large input is dealt out by rows."""
    # text building and regexes run per order: make sure every core gets a share
    o = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    # nation ⋈ region is a fixed 25-row dimension; AQE broadcasts it by size.
    geo = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("n_nationkey", "n_name", "r_name"))
    lf = line_facts(t.lineitem)
    f = (o.join(c, o["o_custkey"] == c["c_custkey"], "left")
         .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
         .join(lf, F.col("o_orderkey") == F.col("l_orderkey"), "left"))
    tasks = -(-t.orders.count() // TASK_ROWS)
    if tasks > t.spark.sparkContext.defaultParallelism:
        f = f.repartition(tasks, "o_orderkey")
    return (f.withColumn("case_type", _case_type(F.col("o_orderkey")))
             .withColumn("case_ref", F.concat(
                 F.lit("SGCON/"), F.year("o_orderdate").cast("string"), F.lit("/"),
                 (F.lit(10000) + F.col("o_orderkey")).cast("string"))))


def thread_text(f: DataFrame) -> Column:
    """Subject, first date, national id, last date (when the order has lines)."""
    subject = F.concat(F.lit("Subject: Re: ["), F.col("case_ref"), F.lit("] "), F.col("case_type"),
                       F.lit(" - "), F.col("c_name"), F.lit(" in "), F.col("n_name"))
    d1 = F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(", 08:00"))
    nid = F.concat(F.lit("NRIC S"),
                   F.lpad((F.col("o_orderkey") % F.lit(10000000)).cast("string"), 7, "0"), F.lit("Z"))
    d2 = F.concat(F.lit("Date: "), F.date_format("last_ship", "dd MMM yyyy"), F.lit(", 09:00"))
    return F.concat_ws("\n", subject, d1, nid, d2)


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = order_facts(Tables(spark, sf_dir))
    return f.withColumn("parsed_text", thread_text(f))


def status_of(code: Column) -> Column:
    return (F.when(code == "F", F.lit("Closed")).when(code == "O", F.lit("In Progress"))
            .when(code == "P", F.lit("Pending")))


def l1_struct() -> Column:
    """The layer-1 struct a model would return, derived from the thread's facts."""
    fields = {
        "Title_Name": F.col("c_name"),
        "Case_Type": F.col("case_type"),
        "Case_Status": status_of(F.col("o_orderstatus")),
        "Case_Handler": F.when(F.col("o_orderkey") % 2 == 0, F.lit("CRC")).otherwise(F.lit("CON/OPS")),
        "Assigned_HCG": F.col("r_name"),
        "Case_Location": F.col("n_name"),
        "Citizenship": F.lit("Singapore"),
        "Origin": F.lit("Email"),
        "Case_Title": F.concat(F.col("case_type"), F.lit(" - "), F.col("c_name"), F.lit(" in "), F.col("n_name")),
        "Case_Subject": F.concat(F.lit("Re: ["), F.col("case_ref"), F.lit("] "), F.col("case_type"),
                                 F.lit(" - "), F.col("c_name"), F.lit(" in "), F.col("n_name")),
        "Case_Description": F.concat(F.col("c_name"), F.lit(" rang from "), F.col("n_name"), F.lit(" about: "), F.col("case_type")),
        "Category_Multiselect": F.col("o_orderpriority"),
        "Registrant": F.col("c_name"),
        "Created_On": F.date_format("o_orderdate", "yyyy-MM-dd"),
    }
    return F.struct(*[fields.get(f, F.lit(None).cast("string")).alias(f) for f in R.L1_FIELDS])


def l2_struct() -> Column:
    """Layer-1 tags and layer-2 text a model would return."""
    scam = (F.col("o_custkey") % 10) < 2
    empty = F.array().cast("array<string>")
    return F.struct(
        F.col("n_name").alias("L1_Country"),
        F.when(~scam, F.col("r_name")).alias("L1_Mission"),
        F.when(scam, F.lit("Scam")).otherwise(F.upper(F.col("case_type"))).alias("L1_Case_Type"),
        F.coalesce(F.col("codes"), empty).alias("L1_Agencies"),
        F.coalesce(F.col("flags"), empty).alias("L1_Situational_Flags"),
        F.when(F.col("o_orderstatus") == "F", F.lit("closed")).otherwise(F.lit("pending")).alias("L1_Status"),
        F.concat(F.col("r_name"), F.lit(" desk, "), F.col("n_name"), F.lit(": "), F.col("case_type")).alias("L2_Summary_Pathway"),
        F.lit(None).cast("string").alias("L2_Assistance_Req_vs_Provided"),
        F.when(F.array_contains(F.coalesce(F.col("flags"), empty), "language barrier"),
               F.lit("An interpreter was called in")).otherwise(F.lit("No delay")).alias("L2_Complications_Delays"),
        F.lit(None).cast("string").alias("L2_External_Resources"),
        F.lit(None).cast("string").alias("L2_Lessons_Learnt"),
    )


def l1_model_stand_in(th: DataFrame) -> DataFrame:
    """Layer-1 stage ``(case_ref, parsed_text, js)``."""
    return th.select("case_ref", "parsed_text", l1_struct().alias("js"))


def l2_model_stand_in(th: DataFrame) -> DataFrame:
    """Layer-2 stage ``(case_ref, parsed_text, e)``."""
    return th.select("case_ref", "parsed_text", l2_struct().alias("e"))


def staged_models(th: DataFrame) -> DataFrame:
    """Both model outputs on the bronze row ``(case_ref, parsed_text, js, e)``:
    one pass over bronze instead of one stage per model."""
    return th.select("case_ref", "parsed_text", l1_struct().alias("js"), l2_struct().alias("e"))


def record_exprs() -> dict:
    """X12/X13 mapping of extracted fields; ``Case_Type`` from the subject (X11)."""
    exprs = {f: F.col("js").getField(f) for f in R.L1_FIELDS}
    exprs["Case_Ref"] = F.col("case_ref")
    exprs["Do_Not_Modify_Case"] = F.col("case_ref")
    exprs["Case_Type"] = X.subject_case_type(F.col("parsed_text"))
    return exprs


def record_from_l1(l1: DataFrame, loaded_at: str = FIXTURE_LOADED_AT) -> DataFrame:
    return R.map_to_record(l1, record_exprs(), loaded_at=F.to_timestamp(F.lit(loaded_at)))


def cases(spark: SparkSession, sf_dir: str, *, loaded_at: str = FIXTURE_LOADED_AT) -> DataFrame:
    """Gold surrogate: 65 columns, one row per order, in one pass over bronze."""
    th = threads(spark, sf_dir)
    return build_gold_staged(staged_models(th), record_exprs(), loaded_at=F.to_timestamp(F.lit(loaded_at)))


_STORED: dict[tuple, str] = {}
_CASE_TABLES = ("orders", "customer", "nation", "region", "lineitem")


def _input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """Names, lengths and times of the case tables' files: a table that changes is another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for t in _CASE_TABLES:
        at = path(f"{sf_dir.rstrip('/')}/{t}.parquet")
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at))
    return tuple(out)


def _stored(spark: SparkSession, sf_dir: str, what: str, write) -> str:
    """Folder of a derived table, written once per session and state of its input in the shared folder."""
    key = spark.sparkContext.applicationId, what, _input_state(spark, sf_dir)
    if key not in _STORED:
        path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
        write(path)
        _STORED[key] = path
    return _STORED[key]


def stored_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold as it is served: by creation year and sorted by reference inside each file, so that
    references, years and columns prune the scan."""
    return spark.read.parquet(stored_gold(spark, sf_dir)).drop("created_year")


def stored_gold(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the stored gold."""
    return _stored(spark, sf_dir, "gold", lambda p: write_gold(cases(spark, sf_dir), p))


def gold_index(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the n-gram index over the stored gold."""
    return _stored(spark, sf_dir, "gold-grams", lambda p: text_index.build(spark, stored_gold(spark, sf_dir), p))


def _land(df: DataFrame, path: str) -> None:
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)


def stored_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze as it is landed, so that a query that needs it on both sides of a join builds it once."""
    return spark.read.parquet(_stored(spark, sf_dir, "bronze", lambda p: _land(threads(spark, sf_dir), p)))


def cases_joined(spark: SparkSession, sf_dir: str, *, loaded_at: str = FIXTURE_LOADED_AT) -> DataFrame:
    """Same gold through the stage-per-model path: record ⋈ enrichment."""
    th = threads(spark, sf_dir)
    record = record_from_l1(l1_model_stand_in(th), loaded_at)
    return build_gold(record, l2_model_stand_in(th))


# ---------------------------------------------------------------------------
# Procedure chunks
# ---------------------------------------------------------------------------

# One chunk per case type, written for this fixture. The file-name form of the
# second title exercises the normalised match key; a step may run over two lines.
SOP_STEPS = {
    "Arrest & Detention": [
        "Log the call and open a file under the caller's name.",
        "Ring the duty lawyer list and note who answered.",
        "Put the hearing date in the shared calendar.",
    ],
    "Serious_Illness_Death": [
        "Read the ward report and store a scan.",
        "Name one contact in the family and write down their number.",
        "Ask the insurer for a reference code.",
        "Review the file every second morning.",
    ],
    "Victim of Crime": [
        "Take a written account in the person's own words.",
        "List what is missing, with values.",
        "Send the list to the insurer and keep the receipt.",
    ],
    "Lost/Stolen Document": [
        "Compare the photograph with the one on file.",
        "Print the replacement form and collect the fee.",
    ],
    "Evacuation": [
        "Draw up the head count by district.",
        "Reserve seats and send each person a number.",
        "Tick off names at the gate;\n   report the total to the desk.",
    ],
    "Scam": [
        "Save the messages before anything is deleted.",
        "Ask the bank to stop the payment.",
        "Give the caller the file number.",
    ],
}


def sop_rows() -> list[tuple[str, str, str]]:
    rows = []
    for title, steps in SOP_STEPS.items():
        body = "\n".join([f"Procedure: {title.replace('_', ' ')}"] +
                         [f"{i}. {s}" for i, s in enumerate(steps, 1)])
        rows.append((f"SOP_{title}", title, body))
    return rows


def sop(spark: SparkSession) -> DataFrame:
    """Literal procedure chunks ``(chunk_id, sop_title, chunk)``."""
    return spark.createDataFrame(sop_rows(), "chunk_id string, sop_title string, chunk string")


# ---------------------------------------------------------------------------
# Operational event logs (from ``events``) and chat (from ``conversations``)
# ---------------------------------------------------------------------------

def case_keys(t: Tables) -> DataFrame:
    """``(o_orderkey, case_ref)`` straight from orders (no line items needed)."""
    return t.orders.select("o_orderkey", F.concat(
        F.lit("SGCON/"), F.year("o_orderdate").cast("string"), F.lit("/"),
        (F.lit(10000) + F.col("o_orderkey")).cast("string")).alias("case_ref"))


def _events_on_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their case reference.

    A plain join on the order key, unique on the case side: adaptive execution
    broadcasts the keys when they are measured small and splits a hot user's
    events otherwise."""
    t = Tables(spark, sf_dir)
    ev = t.events.select("event_id", "ts", "user_id", "event_type", "props")
    keys = case_keys(t)
    return ev.join(keys, ev["user_id"] == keys["o_orderkey"]).drop("o_orderkey")


def event_status(event_type: Column) -> Column:
    return (F.when(event_type == "purchase", F.lit("Closed"))
            .when(event_type == "error", F.lit("On Hold"))
            .when(event_type == "signup", F.lit("Pending"))
            .otherwise(F.lit("In Progress")))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_on_cases(spark, sf_dir)
    return e.select("case_ref", event_status(F.col("event_type")).alias("status"),
                    F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_on_cases(spark, sf_dir)
    return e.select("case_ref", (F.col("event_id") % 5).cast("int").alias("idx"),
                    (F.col("event_type") != "error").alias("done"), F.lit("officer").alias("by"),
                    F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def note_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events_on_cases(spark, sf_dir)
    return e.select("case_ref", F.col("event_type").alias("author"), F.col("props").alias("note"),
                    F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def thread_map_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Tables(spark, sf_dir).events
    return ev.select(F.col("user_id").alias("conv_id"),
                     F.concat(F.lit("g"), F.col("event_id").cast("string")).alias("assistant_conv_id"),
                     F.col("ts").alias("at"), F.col("event_id").alias("seq"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat log: ``turn`` stands for time; user e-mail derived from the id."""
    from caseflow.operators.routing import rule_route
    cv = Tables(spark, sf_dir).conversations
    return cv.select(
        "conv_id",
        F.concat(F.lit("officer"), (F.col("conv_id") % 7).cast("string"), F.lit("@example.org")).alias("user_email"),
        "role", F.col("text").alias("content"),
        F.when(F.col("role") == "user", rule_route(F.col("text"))).alias("route"),
        F.col("turn").alias("created_at"), F.col("turn").alias("seq"))
