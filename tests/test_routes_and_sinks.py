"""Routing evidence, truth manifest sink, free-text scrub and fixed chunks."""

import os

from pyspark.sql import functions as F

from caseflow.operators import governance as G
from caseflow.operators import routing as RT
from caseflow.operators import synth as SY
from caseflow.plans import fixtures as FX
from caseflow.session import checkpoint_dir
from caseflow.sources.tables import Tables

D = "/root/testdata/sf0.001"


def test_question_evidence_all_routes(spark):
    gold = FX.cases(spark, D)
    th = FX.threads(spark, D)
    ref = gold.select("Case_Ref").orderBy("Case_Ref").first()[0]
    record = FX.record_from_l1(FX.l1_model_stand_in(th))
    chunks = G.email_chunks(record, th.select("case_ref", "parsed_text"))
    qs = spark.createDataFrame([
        ("q1", f"what happened in [{ref}]?"),
        ("q2", "show similar cases: Scam in NATION_1"),
        ("q3", "what is the procedure for an evacuation"),
        ("q4", "how many cases per mission"),
        ("q5", "lookup [SGCON/1900/1]")], "qid string, question string")
    ev = {r.qid: r for r in RT.question_evidence(qs, gold, chunks, FX.sop(spark)).collect()}
    assert ev["q1"].route == "case_lookup" and ref in ev["q1"].evidence
    assert ev["q2"].route == "similar" and ev["q2"].evidence.count("**SGCON/") == 3
    assert ev["q3"].route == "procedure" and ev["q3"].evidence.startswith("**SOP: ")
    assert ev["q4"].route == "structured" and ev["q4"].evidence is None
    assert ev["q5"].evidence == "Case not found."


def test_truth_manifest_roundtrip(spark):
    t = Tables(spark, D)
    th = SY.truth_threads(t.orders, t.lineitem)
    path = os.path.join(checkpoint_dir(spark), "test-manifest")
    SY.write_truth_manifest(th, path)
    back = spark.read.json(path)
    assert back.count() == th.count()
    assert set(back.columns) >= {"case_ref", "agencies", "ev_flags"}


def test_q6_free_text_scrub_for_unprivileged(spark):
    g = spark.createDataFrame([("Ann Lee", "Ann Lee was detained; id S1234567A")],
                              "Title_Name string, Case_Description string")
    pol = G.Policy(free_text=("Case_Description",))
    out = G.governed_read(g, pol, G.Viewer("analyst")).first()
    assert out.Title_Name == "***REDACTED***"
    assert out.Case_Description == "[NAME] was detained; id [NRIC]"
    priv = G.governed_read(g, pol, G.Viewer("o", frozenset({G.PRIVILEGED_GROUP}))).first()
    assert priv.Case_Description.startswith("Ann Lee")


def test_fixed_chunks_reassemble_to_scrubbed_text(spark):
    th = FX.threads(spark, D)
    record = FX.record_from_l1(FX.l1_model_stand_in(th))
    whole = G.email_chunks(record, th.select("case_ref", "parsed_text"))
    parts = G.email_chunks(record, th.select("case_ref", "parsed_text"), chunk_size=17)
    glued = (parts.withColumn("n", F.split("chunk_id", "#")[1].cast("int"))
             .groupBy("case_ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk"))),
                                                                lambda s: s.getField("chunk")), "").alias("chunk")))
    a = sorted(tuple(r) for r in whole.select("case_ref", "chunk").collect())
    b = sorted(tuple(r) for r in glued.select("case_ref", "chunk").collect())
    assert a == b


def test_gold_sink_prunes_partitions_and_pushes_filters(spark):
    import uuid

    from caseflow.sources import sinks
    path = os.path.join(checkpoint_dir(spark), "test-gold", uuid.uuid4().hex)
    sinks.write_gold(FX.cases(spark, D).select("Case_Ref", "Case_Type", "Created_On"), path)
    q = spark.read.parquet(path).where((F.col("created_year") == 1996) & (F.col("Case_Type") == "Scam")) \
        .select("Case_Ref")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_year" in plan and "= 1996" in plan
    assert "PushedFilters: [IsNotNull(Case_Type), EqualTo(Case_Type,Scam)]" in plan
    assert "ReadSchema: struct<Case_Ref:string,Case_Type:string>" in plan


def test_create_if_absent_then_append(spark):
    import uuid

    from pyspark.sql import types as T

    from caseflow.sources import sinks
    path = os.path.join(checkpoint_dir(spark), "test-notes", uuid.uuid4().hex)
    schema = T.StructType([T.StructField("note_id", T.StringType()), T.StructField("note", T.StringType())])
    assert sinks.create_if_absent(spark, path, schema).count() == 0
    sinks.append(spark.createDataFrame([("1", "a")], schema), path)
    sinks.append(spark.createDataFrame([("2", "b")], schema), path)
    assert sinks.create_if_absent(spark, path, schema).count() == 2


def test_rebuild_end_to_end(spark):
    import uuid

    from caseflow.operators import analytics as A
    from caseflow.operators import synth as SY
    from caseflow.plans.rebuild import rebuild
    t = Tables(spark, D)
    bronze = SY.truth_threads(t.orders, t.lineitem).select("case_ref", "parsed_text")
    out = os.path.join(checkpoint_dir(spark), "test-rebuild", uuid.uuid4().hex)
    r = rebuild(spark, bronze, out)
    n = bronze.count()
    assert r.gold.count() == n and r.chunks.count() == n and r.embeddings.count() == n
    assert {row.status: row.n for row in r.extraction_status.collect()} == {"ok": n}
    assert A.leak_check(r.chunks).first().leaks == 0
    k = A.kpi(r.gold).first()
    assert k.total == n and k.avg_days is not None
    assert r.accuracy.count() == 1 and r.rejects.count() == 0

    def broken(prompts):
        raise AssertionError("a finished stage ran again")

    lost = bronze.unionByName(spark.createDataFrame([(None, "no reference in this text")], "case_ref string, parsed_text string"))
    files = spark.createDataFrame([("/l/SOP_Scam.txt", "Procedure\n1. one"), ("/l/other.txt", "x")], "path string, parsed_text string")
    again = rebuild(spark, lost, out, l1_model=broken, procedures=files)
    assert again.gold.count() == n and again.procedure_embeddings.select("chunk_id").first()[0] == "SOP_Scam"
    fresh = rebuild(spark, bronze.limit(3).unionByName(lost.where("case_ref is null")), out + "-2", check_keys=False)
    assert [r.reason for r in fresh.rejects.collect()] == ["no reference"] and fresh.gold.count() == 3


def test_stream_ingest_picks_each_file_once(spark):
    import uuid

    from caseflow.sources import files as FL
    from caseflow.sources import landing as LD
    from caseflow.streaming import stream as SM
    landing = os.path.join(checkpoint_dir(spark), "test-landing", uuid.uuid4().hex)
    run_id = uuid.uuid4().hex
    pages = Tables(spark, D).pages.select(
        "page_id", F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("key"), "html")
    first = pages.where(F.col("page_id") % 2 == 0)
    second = pages.where(F.col("page_id") % 2 == 1)
    assert SM.ingest_stream(spark, landing, FL.html_parser, run_id=run_id).count() == 0   # nothing landed yet
    LD.land(first, landing, "key", "html")
    n1 = SM.ingest_stream(spark, landing, FL.html_parser, run_id=run_id).count()
    LD.land(second, landing, "key", "html")
    out = SM.ingest_stream(spark, landing, FL.html_parser, run_id=run_id)
    assert n1 == first.count()
    assert out.count() == pages.count()                    # second run added only the new files
    assert out.select("path").distinct().count() == pages.count()


def test_event_log_stream_drops_replays_and_keeps_late_events(spark):
    import datetime as dt
    import uuid

    from caseflow.operators import state as ST
    from caseflow.streaming import stream as SM
    src, run_id = os.path.join(checkpoint_dir(spark), "test-events", uuid.uuid4().hex), uuid.uuid4().hex
    t = dt.datetime(2024, 1, 10)
    rows = [("r1", "Closed", t, 1), ("r1", "Pending", t + dt.timedelta(hours=1), 2),
            ("r1", "Pending", t + dt.timedelta(hours=1), 2),          # replayed delivery
            ("r2", "On Hold", t, 3)]
    schema = "case_ref string, status string, at timestamp, seq long"
    spark.createDataFrame(rows, schema).write.parquet(src)
    assert SM.event_log_stream(spark, spark.readStream.schema(schema).parquet(src), "seq", run_id=run_id).count() == 3
    late = [("r3", "Closed", t - dt.timedelta(days=8), 4), ("r2", "On Hold", t, 3)]
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    log = SM.event_log_stream(spark, spark.readStream.schema(schema).parquet(src), "seq", run_id=run_id)
    assert log.count() == 4
    latest = {r.case_ref: r.status for r in ST.fold_latest(log, ["case_ref"], ["status"]).collect()}
    assert latest == {"r1": "Pending", "r2": "On Hold", "r3": "Closed"}


def test_gold_stream_keeps_one_row_per_key(spark):
    """Two versions in one file, in one micro-batch and in a later run: the newest counts."""
    import uuid

    from caseflow.streaming import stream as SM
    src, run_id = os.path.join(checkpoint_dir(spark), "test-bronze", uuid.uuid4().hex), uuid.uuid4().hex
    schema = "case_ref string, parsed_text string"

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = SM.gold_stream(spark, src, schema, lambda b: b.select("case_ref", F.upper("parsed_text").alias("t")), run_id=run_id)
        return {tuple(r) for r in out.collect()}

    assert land([("K", "one"), ("L", "x"), ("K", "two")]) == {("K", "TWO"), ("L", "X")}
    assert land([("K", "three"), (None, "lost")]) == {("K", "THREE"), ("L", "X")}
    assert [(r.row, r.reason) for r in SM.gold_rejects(spark, run_id).collect()] == [(1, "no reference")]


def test_trend_stream_counts_late_events(spark):
    import datetime as dt
    import uuid

    from caseflow.streaming import stream as SM
    src, run_id, schema = os.path.join(checkpoint_dir(spark), "test-trend", uuid.uuid4().hex), uuid.uuid4().hex, "ts timestamp_ntz, k string"
    for days in (10, 2):
        spark.createDataFrame([(dt.datetime(2024, 1, days), "a")] * 2, schema).write.mode("append").parquet(src)
        out = SM.trend_stream(spark, SM.table_stream(spark, src, spark.read.parquet(src).schema), "ts", "k", run_id=run_id)
    assert {tuple(r) for r in out.collect()} == {("2024-01-10", "a", 2), ("2024-01-02", "a", 2)}


def test_files_keep_entities_stems_and_errors(spark):
    from caseflow.sources import files as FL
    rows = [("/x/SGCON_1.txt", b"plain caf\xc3\xa9"), ("/x/b.html", b"<p>AT&amp;T &#233;t&eacute; <b>x</b>y"), ("/x/c.pdf", b"%PDF-1.7 \x00\x01"),
            ("/x/d", b"[SGCON/2024/7] t"), ("/x/e.txt", None)]
    df = spark.createDataFrame(rows, "path string, content binary")
    b = FL.with_reference(FL.parsed_text(FL.parse_documents(df, FL.text_parser)))
    got = {r.path: r for r in b.collect()}
    assert [got[p].case_ref for p, _ in rows] == ["SGCON_1", "b", "c", "SGCON/2024/7", "e"]
    assert got["/x/c.pdf"].parse_error == "pdf bytes need a parser" and not got["/x/c.pdf"].parsed_text
    assert {(r.path, r.reason) for r in FL.rejects(b).collect()} == {("/x/c.pdf", "pdf bytes need a parser"), ("/x/e.txt", "no text")}
    html = FL.parsed_text(FL.parse_documents(df.where("path = '/x/b.html'"), FL.html_parser)).first()
    assert html.parsed_text == "AT&T \u00e9t\u00e9 xy"


def test_state_writes(spark):
    import datetime as dt
    import uuid

    from caseflow.operators import state as ST
    store, t = os.path.join(checkpoint_dir(spark), "test-state", uuid.uuid4().hex), dt.datetime(2024, 1, 1)
    ch = spark.createDataFrame([("R1", "Closed", "ann", t, 1), ("R1", "Pending", "", t, 2)],
                               "case_ref string, status string, by string, at timestamp_ntz, seq long")
    for _ in range(2):  # a replay changes nothing
        ST.set_status(ch, store)
    assert ST.fold_latest(ST.read_events(spark, store, "status"), ["case_ref"], ["status"]).first().status == "Pending"
    notes = {(r.author, r.note) for r in ST.notes_feed(ST.read_events(spark, store, "notes")).collect()}
    assert notes == {("ann", "Status changed to Closed."), ("officer", "Status changed to Pending.")}
    n = spark.createDataFrame([("R1", None, "hello", t, 3), ("R1", "bo", "  ", t, 4)],
                              "case_ref string, author string, note string, at timestamp_ntz, seq long")
    ST.add_notes(n, store)
    assert ST.read_events(spark, store, "notes").count() == 3
    assert ST.read_events(spark, store, "steps").count() == 0


def test_one_procedure_for_each_key(spark):
    from caseflow.operators import state as ST
    gold = spark.createDataFrame([("R1", "Scam")], "Case_Ref string, Case_Type string")
    sop = spark.createDataFrame([("b", "Scam", "1. second"), ("a", "SCAM!", "1. first")], "chunk_id string, sop_title string, chunk string")
    assert [tuple(r) for r in ST.case_steps(gold, sop).collect()] == [("R1", 0, "first")]


def test_keyset_pages_lose_no_case(spark):
    from caseflow.operators import serving as SV
    rows = [(f"R{i:02d}", None if i % 3 == 0 else "bad" if i % 7 == 0 else f"2024-01-{1 + i % 4:02d}") for i in range(25)]
    g = spark.createDataFrame(rows, "Case_Ref string, Created_On string").selectExpr(
        "*", "'t' as Case_Type", "'c' as L1_Country", "'m' as Assigned_HCG", "'s' as Case_Status", "1 as Resolution_Days")
    cq, seen, last = SV.CaseQuery(size=4), [], (None, None)
    while page := SV.list_after(g, cq, *last).collect():
        dates = {r[0]: r[1] for r in rows}
        seen += [r["Case_Ref"] for r in page]
        last = (dates[seen[-1]], seen[-1])
    assert len(seen) == 25 and set(seen) == {r[0] for r in rows}


def test_prompts_state_the_vocabularies():
    from caseflow.operators import extract as E
    assert all(x in E.l2_prompt() for v in (E.AGENCIES, E.FLAGS, E.COUNTRIES, E.MISSIONS.values(), E.CASE_TYPES) for x in v)
    assert all(x in E.l1_prompt() for x in [*E.HQ_UNITS, *E.CASE_TYPES, "YYYY-MM-DD"])


def test_model_router_falls_back(spark):
    qs = spark.createDataFrame([("a", "what about SGCON/2024/5?"), ("b", "x"), ("c", "y")], "qid string, question string")
    answers = {"SGCON/2024/5": '{"route": "case_lookup"}', "x": "no idea", "y": '{"route": "procedure", "case_ref": "SGCON/2023/1"}'}
    out = {r.qid: (r.route, r.case_ref) for r in RT.route_questions(
        qs, model=lambda ps: [next(v for k, v in answers.items() if k in p.rsplit("Question: ", 1)[1]) for p in ps]).collect()}
    assert out == {"a": ("case_lookup", "SGCON/2024/5"), "b": ("structured", None), "c": ("procedure", "SGCON/2023/1")}


def test_sql_functions_match_column_operators(spark):
    from caseflow.functions import text as X
    df = spark.createDataFrame([("Ann", "Ann S1234567A", "Serious Illness/Death"), (None, "x S7654321B", "Scam")],
                               "n string, t string, ty string")
    df.createOrReplaceTempView("sqlfn_probe")
    G.register_sql_functions(spark, G.Viewer("analyst"))
    got = spark.sql("SELECT mask_pii(n) AS m, norm_key(ty) AS k, scrub_pii(t, n) AS s FROM sqlfn_probe").collect()
    want = df.select(X.mask("n", False).alias("m"), X.norm_key("ty").alias("k"),
                     X.scrub_pii("t", "n").alias("s")).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]
    G.register_sql_functions(spark, G.Viewer("o", frozenset({G.PRIVILEGED_GROUP})))
    assert spark.sql("SELECT mask_pii(n) FROM sqlfn_probe").first()[0] == "Ann"


def test_trend_stream_days_do_not_depend_on_session_zone(spark):
    from caseflow.streaming import stream as SM
    ev = Tables(spark, D).events
    batch = sorted(tuple(r) for r in ev.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"),
                                                 F.col("event_type").alias("key"))
                   .agg(F.count(F.lit(1)).alias("n")).collect())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ("America/Los_Angeles", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            out = SM.trend_stream(spark, SM.table_stream(spark, f"{D}/events.parquet", ev.schema), "ts", "event_type")
            assert sorted(tuple(r) for r in out.select("day", "key", "n").collect()) == batch, tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_worker_side_queries_run_from_another_directory(tmp_path):
    """Python UDFs and mapInPandas functions reach executors without the
    package being importable there (pickled by value)."""
    import subprocess
    import sys as _sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (f"import sys; sys.path.insert(0, {repo!r})\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "import __spark_entry__ as E\n"
            "q = E.queries()\n"
            f"print('N', q['model_extract_stub'](s, {D!r}).count(), q['parse_pages'](s, {D!r}).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([_sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "N " in out.stdout, out.stderr[-2000:]
    n_threads, n_pages = map(int, out.stdout.split("N ")[1].split())
    assert n_threads > 0 and n_pages > 0
