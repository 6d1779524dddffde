"""Landing folders, event ids, stored fixtures, and streams with state: restarts, late and repeated rows, expiry."""

import datetime as dt
import os
import shutil
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators import state as ST
from caseflow.plans import fixtures as FX
from caseflow.session import checkpoint_dir
from caseflow.sources import files as FL
from caseflow.sources import landing as LD
from caseflow.sources.versioned import VersionedTable
from caseflow.streaming import current as CU
from caseflow.streaming import stream as SM

D = "/root/testdata/sf0.001"


def folder(spark, name):
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "name string, content string")


def test_landed_files_are_files(spark):
    at = folder(spark, "landed")
    LD.land(docs(spark, ("a/x.txt", "één"), ("b.html", None), ("c.txt", "")), at)
    got = {r.name: (r.length, bytes(r.content)) for r in LD.documents(spark, at).collect()}
    assert got == {"a/x.txt": (5, "één".encode()), "b.html": (0, b""), "c.txt": (0, b"")}
    # Spark's own reader leaves files without bytes out
    assert {os.path.basename(r.path): bytes(r.content) for r in FL.scan(spark, at, "*").collect()} == {"x.txt": "één".encode()}
    assert sorted(os.listdir(at.removeprefix("file:"))) == ["_loads", "a", "b.html", "c.txt"]
    assert tuple(FL.folder_size(spark, at, "*.txt").first()) == (1, 5) and FL.count_files(spark, at, "*") == 1
    plan = FL.folder_size(spark, at, "*")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_landing_options_prune_before_reading(spark):
    at = folder(spark, "pruned")
    LD.land(docs(spark, ("a.txt", "1"), ("b.txt", "22"), ("c.md", "333")), at)
    names = lambda **o: sorted(r.name for r in LD.documents(spark, at, **o).select("name").collect())
    assert names(glob="*.txt") == ["a.txt", "b.txt"] and names(minLength=2) == ["b.txt", "c.md"] and names(maxLength=2) == ["a.txt", "b.txt"]
    assert names(after="2100-01-01") == [] and len(names(before="2100-01-01", content=False)) == 3
    assert LD.documents(spark, at, content=False).columns == ["name", "path", "modificationTime", "length"]


def test_landing_replaces_names_and_hides_what_was_not_published(spark):
    at = folder(spark, "replaced")
    LD.land(docs(spark, ("a", "old"), ("b", "b")), at)
    LD.land(docs(spark, ("a", "new")), at)
    assert {r.name: bytes(r.content) for r in LD.documents(spark, at).collect()} == {"a": b"new", "b": b"b"}
    with pytest.raises(Exception, match="not a name of a document"):
        LD.land(docs(spark, ("ok", "x"), ("../out", "x")).coalesce(1), at)
    assert len(LD.published(at)) == 2 and LD.documents(spark, at).count() == 2
    LD.land(docs(spark).where("false"), at)  # an empty load is a load
    assert LD.published(at)[-1][1]["files"] == 0


def test_arriving_reads_each_load_once(spark):
    at, ckpt, seen = folder(spark, "arriving"), folder(spark, "ckpt"), []

    def run():
        q = (LD.arriving(spark, at).writeStream.foreachBatch(lambda b, i: seen.append(sorted(r.name for r in b.collect())))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination()
        return [x for x in seen if x]

    LD.land(docs(spark, ("a", "1"), ("b", "2")), at)
    assert run() == [["a", "b"]]
    LD.land(docs(spark, ("c", "3")), at)
    assert run() == [["a", "b"], ["c"]] and run() == [["a", "b"], ["c"]]


def test_event_ids_do_not_run_together(spark):
    store, t = folder(spark, "events"), dt.datetime(2024, 1, 1)
    notes = [("r", "a|b", "c", t, 1), ("r", "a", "b|c", t, 1), ("r", None, "x", t, 1), ("r", "", "x", t, 1)]
    df = spark.createDataFrame(notes, "case_ref string, author string, note string, at timestamp_ntz, seq long")
    ST.append_events(df, store, "notes")
    ST.append_events(df, store, "notes")  # replayed
    assert ST.read_events(spark, store, "notes").count() == 4
    assert ST.notes_feed(df.limit(2)).select("note_id").distinct().count() == 2


def test_stored_gold_follows_its_input(spark, tmp_path):
    for t in ("orders", "customer", "nation", "region", "lineitem"):
        shutil.copy(f"{D}/{t}.parquet", tmp_path / f"{t}.parquet")
    n = FX.stored_cases(spark, str(tmp_path)).count()
    less = spark.read.parquet(f"{D}/orders.parquet").where("o_orderkey % 2 = 0").toPandas()
    less.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    spark.catalog.refreshByPath(str(tmp_path / "orders.parquet"))
    assert FX.stored_cases(spark, str(tmp_path)).count() == len(less) < n


@pytest.mark.parametrize("as_folder", [True, False])
def test_table_stream_reads_a_file_or_a_folder(spark, as_folder, tmp_path):
    path = f"{D}/events.parquet"
    df = spark.read.parquet(path)
    if as_folder:
        path = f"{tmp_path}/events.parquet"
        df.repartition(3).write.parquet(path)
    out = SM.trend_stream(spark, SM.table_stream(spark, path, df.schema), "ts", "event_type")
    assert out.agg(F.sum("n")).first()[0] == df.count()


def test_streams_over_nothing_are_empty(spark):
    at = folder(spark, "nothing")
    spark.createDataFrame([], "ts timestamp_ntz, k string, id string, created timestamp_ntz, flags array<string>").write.parquet(at)
    schema = spark.read.parquet(at).schema
    assert SM.trend_stream(spark, SM.table_stream(spark, at, schema), "ts", "k").count() == 0
    assert CU.flag_trend(spark.readStream.schema(schema).parquet(at).select("id", "created", "flags"), uuid.uuid4().hex).count() == 0


STATUS = T.StructType().add("k", "string").add("v", "string").add("at", T.TimestampNTZType()).add("seq", "long")


def test_current_table_equals_the_fold_after_every_batch(spark):
    """Four loads, streamed two files at a time and restarted for each: late, repeated, tied and null rows."""
    src, run, day = folder(spark, "status"), uuid.uuid4().hex, dt.datetime(2024, 1, 10)
    table, every = VersionedTable(spark, folder(spark, "current"), STATUS, ("k",), 4), []
    loads = [[("a", "1", day, 1), ("b", "1", day, 2), ("b", "2", day, 3), (None, "n", day, 4)],
             [("a", "late", day - dt.timedelta(400), 9), ("b", "2", day, 3), ("c", "only late", day - dt.timedelta(900), 5)],
             [("a", None, day, 7), ("c", "x", day - dt.timedelta(901), 6), ("d", "no time", None, 8)],
             [("a", "1", day, 1), (None, "m", day + dt.timedelta(microseconds=1), 1)]]
    for load in loads:
        spark.createDataFrame(load, STATUS).repartition(2).write.mode("append").parquet(src)
        stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(src)
        CU.latest_stream(stream, table, run)
        every += load
        fold = ST.fold_latest(spark.createDataFrame(every, STATUS).where("at IS NOT NULL"), ["k"], ["v", "seq"])
        assert Counter(tuple(r) for r in table.read().collect()) == Counter((r.k, r.v, r.at, r.seq) for r in fold.collect())
    changed = table.changes(0).where("change IN ('insert', 'update_after')").count()
    CU.latest_stream(spark.readStream.schema(STATUS).parquet(src), table, run)
    assert table.changes(0).where("change IN ('insert', 'update_after')").count() == changed


def test_expired_state_never_brings_older_events_back(spark):
    src, run, day = folder(spark, "expiry"), uuid.uuid4().hex, dt.datetime(2024, 1, 10)
    table = VersionedTable(spark, folder(spark, "current"), STATUS, ("k",), 2)
    for row in (("a", "new", day, 2), ("a", "old", day - dt.timedelta(1), 1), ("a", "newest", day, 3)):
        spark.createDataFrame([row], STATUS).write.mode("append").parquet(src)
        CU.latest_stream(spark.readStream.schema(STATUS).parquet(src), table, run, idle_ms=1)  # gone by the next run
    assert [r.v for r in table.read().collect()] == ["newest"]
    assert [r.v for r in table.changes(0).where("change <> 'update_before'").orderBy("commit").collect()] == ["new", "newest"]


def test_flag_trend_counts_late_and_repeated_rows_once(spark):
    src, run = folder(spark, "flags"), uuid.uuid4().hex
    schema = "id string, created timestamp_ntz, flags array<string>"
    at = lambda m, d, h=0: dt.datetime(2024, m, d, h)
    loads = [[("1", at(1, 5), ["x", "y"]), ("2", at(1, 20), ["x"]), ("2", at(1, 20), ["x"])],
             [("3", at(4, 1), ["x"]), ("1", at(1, 5), ["x", "y"]), ("4", None, ["y"]), ("9", at(4, 1), [])],
             [("5", at(1, 6), ["x"]), ("1", at(1, 5), ["x", "y"]), ("5", at(1, 6), ["x"]), ("6", at(3, 20, 5), ["y"]), ("3", at(4, 1), ["x"])],
             [("7", at(6, 1), None), ("8", at(6, 2, 23), ["x"])]]
    seen, late = {}, set()
    for i, load in enumerate(loads):
        spark.createDataFrame(load, schema).coalesce(1).write.mode("append").parquet(src)
        out = CU.flag_trend(spark.readStream.schema(schema).parquet(src), run)
        for k, t, flags in load:
            for f in flags or []:
                seen.setdefault((k, f), t)
        late |= {x for x, n in ((("5", "x"), 2), (("4", "y"), 1)) if i >= n}
        want = Counter((t.strftime("%Y-%m-01") if t else None, f) for (_, f), t in seen.items())
        lates = Counter((seen[x].strftime("%Y-%m-01") if seen[x] else None, x[1]) for x in late)
        assert {(r.month, r.flag): (r.n, r.n_late) for r in out.collect()} == {k: (n, lates[k]) for k, n in want.items()}


def test_indexed_search_equals_a_scan_and_reads_fewer_files(spark):
    from caseflow.operators import serving as SV
    from caseflow.operators import text_index as TI
    at, index = folder(spark, "searched"), folder(spark, "grams")
    rows = [(y, f"SGCON/{y}/{i}", f"Case number {i} in Ñandú 50% 漢字{i % 3}" if i % 7 else None) for y in range(1990, 1996) for i in range(30)]
    spark.createDataFrame(rows, "year int, Case_Ref string, Case_Title string").repartition("year").write.partitionBy("year").parquet(at)
    TI.build(spark, at, index)
    whole = spark.read.parquet(at)
    late = f"{at}/year=1999"
    for q in ("SGCON/1993/7", "ñandú 漢字2", "50%", "xx", "1994 1995", "no such thing", "the of", "é", "number\0 12", "1999"):
        want = sorted(r.Case_Ref for r in SV.filtered(whole, SV.CaseQuery(q=q)).collect())
        got = TI.search(spark, at, index, SV.CaseQuery(q=q))
        assert sorted(r.Case_Ref for r in got.collect()) == want, q
        assert got.columns == whole.columns
    plan = TI.search(spark, at, index, SV.CaseQuery(q="SGCON/1993/7"))._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan
    assert TI.files_for(spark, index, "SGCON/1993/7 no_such") == set() and TI.files_for(spark, index, "xx") is None
    spark.createDataFrame([("SGCON/1999/1", "a new file")], "Case_Ref string, Case_Title string").write.parquet(late)
    assert [r.Case_Ref for r in TI.search(spark, at, index, SV.CaseQuery(q="1999")).collect()] == ["SGCON/1999/1"]
