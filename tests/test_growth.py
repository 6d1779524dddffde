"""What lets the heavy steps grow with their input, each on rows of its own."""

import hashlib
import math
import os
import re
import uuid
from collections import Counter
from contextlib import suppress

import pandas as pd
from pyspark.sql import functions as F

from caseflow.operators import search as SE
from caseflow.operators import text_index as TI
from caseflow.plans import fixtures as FX
from caseflow.plans.q_stream import gold_from_text
from caseflow.session import checkpoint_dir
from caseflow.sources.versioned import VersionedTable
from caseflow.streaming import current as CU
from caseflow.streaming import stream as SM

TEXTS = [(1, "the cat the dog 12"), (2, "THE Übung été the"), (3, None), (4, ""), (5, "dog dog dog, a-b_c"), (None, "cat"), (None, "dog cat")]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def by_hand(corpus, rows, features=SE.FEATURES):
    words = lambda t: [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % features
                       for w in re.findall(r"[^\W_]+", (t or "").lower())]
    df = Counter(b for _, t in corpus for b in set(words(t)))
    of = {}
    for k, t in rows:
        of.setdefault(k, Counter()).update(words(t))
    out = []
    for k, _ in rows:
        w = {b: n * math.log((len(corpus) + 1) / (df[b] + 1)) for b, n in sorted(of[k].items())} if k is not None else {}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append((k, [*w], [math.floor(x / norm * SE.GRID + 0.5) / SE.GRID if norm else 0.0 for x in w.values()]))
    return sorted(out, key=repr)


def test_texts_are_embedded_where_they_lie(spark):
    """No shuffle of a text's words; ids that come again share a vector, null ids get none."""
    once = spark.createDataFrame(TEXTS, "id long, text string")
    embed = SE.fit_tfidf(once, "text")
    got = lambda df: sorted(((r.id, r.embedding.indices, r.embedding.values_) for r in df.select(
        "id", F.struct(F.col("embedding.indices").alias("indices"), F.col("embedding.values").alias("values_")).alias("embedding")).collect()), key=repr)
    e = embed(once, "text", "id")
    assert "Exchange" not in plan(e) and got(e) == by_hand(TEXTS, TEXTS)
    rows = TEXTS + [(1, "dog"), (1, None), (5, "dog dog dog, a-b_c")]
    assert got(embed(spark.createDataFrame(rows, "id long, text string"), "text", "id")) == by_hand(TEXTS, rows)


def test_few_queries_leave_many_items_in_place(spark):
    words = ["red", "blue", "green", "old", "new", "box", "cup", "hat"]
    items = [(f"i{k}", " ".join(words[(k >> j) % 8] for j in range(4))) for k in range(300)]
    df = spark.createDataFrame(items, "item_id string, t string").repartition(5)
    embed = SE.fit_tfidf(df, "t", 256)
    q = embed(spark.createDataFrame([(k, t) for k, t in items[:20]], "qid string, t string"), "t", "qid")
    it = embed(df, "t", "item_id")
    got = SE.knn(q, it, 4, item_block=50)
    assert "CoGroup" not in plan(got) and "MapInPandas" in plan(got)
    blocks = SE.knn(q, it, 4, item_block=50, query_block=7)
    assert "CoGroup" in plan(blocks) or "Scan ExistingRDD" in plan(blocks)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, blocks.collect()))


def _on_disk(spark, seen: set[str]) -> dict[str, int]:
    """Bytes of files that came since: shuffles, and by first folder what the shared folder has."""
    out = {}
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    found = [(files.apply(i).getPath(), "shuffle") for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")]
    top = re.sub("^file:/*", "/", checkpoint_dir(spark))
    for d, _, names in os.walk(top):
        found += [(f"{d}/{n}", os.path.relpath(d, top).split("/")[0].split("-")[0]) for n in names if not n.startswith((".", "_"))]
    for f, kind in found:
        with suppress(FileNotFoundError):  # shuffles of earlier tests may go meanwhile
            if f not in seen:
                out[kind] = out.get(kind, 0) + os.path.getsize(f)
                seen.add(f)
    return out


def test_an_index_sync_leaves_its_index_alone_on_disk(spark):
    """No shuffle files, no copies of rows beside the index, and inserts and updates stored once."""
    chunks = lambda n, word: spark.createDataFrame([(f"c{i}", f"{word} {i} " * 20) for i in range(n)], "chunk_id string, chunk string")
    embed = SE.fit_tfidf(chunks(600, "text").select("chunk"), "chunk")
    index = VersionedTable(spark, f"{checkpoint_dir(spark)}/synced-{uuid.uuid4().hex}", SE.index_schema(SE.SPARSE), ("chunk_id",), 4)
    seen: set[str] = set()
    _on_disk(spark, seen)
    SE.sync_index(index, chunks(600, "text"), embed)
    c = SE.sync_index(index, chunks(500, "text").where("chunk_id <> 'c7'").unionByName(
        spark.createDataFrame([("c7", "other"), ("new", "text")], "chunk_id string, chunk string")), embed)
    left = _on_disk(spark, seen)
    assert c.counts == {"insert": 1, "update": 1, "delete": 100, "buckets": 4} and "shuffle" not in left and "stored" not in left
    rows_beside = sum(n for kind, n in left.items() if kind != "synced")  # the ids that come again: none
    assert rows_beside < left["synced"] / 4
    p, fs = index._path("log")
    assert len(fs.listStatus(p)) == 1  # none for the inserts of the first commit
    log = spark.read.parquet(f"{index.folder}/log/{c.log}")
    assert {r["change"]: r["count"] for r in log.groupBy("change").count().collect()} == {"update_before": 1, "delete": 100}
    assert index.changes(0).groupBy("commit", "change").count().count() == 5 and index.changes(0, 1).count() == 600


def test_index_lists_hold_the_runs_of_whole_characters(spark):
    at, index = (f"{checkpoint_dir(spark)}/{n}-{uuid.uuid4().hex}" for n in ("texts", "lists"))
    rows = [(0, "Ab😀cd"), (0, "xy"), (1, "😀cd"), (1, None), (2, "")]
    spark.createDataFrame(rows, "part int, Case_Title string").repartition("part").write.partitionBy("part").parquet(at)
    TI.build(spark, at, index)
    part = {r.id: int(re.search(r"part=(\d)", r.path)[1]) for r in spark.read.parquet(f"{index}/files").collect()}
    got = {r.gram: {part[i] for i in r.ids} for r in spark.read.parquet(f"{index}/lists").collect()}
    assert got == {"ab😀": {0}, "b😀c": {0}, "😀cd": {0, 1}}


class _Handle:
    def __init__(self):
        self.held, self.writes = None, 0

    def getValueState(self, *_):
        return self

    def get(self):
        return self.held

    def update(self, value):
        self.held, self.writes = value, self.writes + 1


class _Time:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_one_call_keeps_the_newest_of_all_keys_of_a_part():
    handle, p = _Handle(), CU.Newest(1000)
    p.init(handle)

    def call(now, *batches):
        frames = iter([pd.DataFrame(b, columns=["key", "at", "seq", "payload"]) for b in batches])
        return sorted(tuple(r) for x in p.handleInputRows((0,), frames, _Time(now)) for r in x.itertuples(index=False))

    assert call(0, [("a", 5, 1, "a1"), ("b", 5, 1, "b1")], [("a", 5, 2, "a2"), ("a", 5, 2, "again")]) == [("a", 5, 2, "a2"), ("b", 5, 1, "b1")]
    assert call(600, [("a", 5, 2, "tie"), ("b", 6, 0, "b2")]) == [("b", 6, 0, "b2")]
    assert call(700, [("a", 4, 9, "old"), ("b", 6, 0, "b2")]) == [] and handle.writes == 2
    assert call(1200, [("a", 4, 9, "old"), ("b", 5, 9, "old")]) == [("a", 4, 9, "old")]  # a is forgotten, b was renewed


def test_large_inputs_are_dealt_out_by_rows(spark, monkeypatch, tmp_path):
    n = 90
    at = lambda: F.expr("timestamp_ntz'1995-01-01 00:00:00'")
    tables = {
        "orders": spark.range(n).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"), F.lit("F").alias("o_orderstatus"),
                                        at().alias("o_orderdate"), F.lit("1-URGENT").alias("o_orderpriority")),
        "customer": spark.range(7).select(F.col("id").alias("c_custkey"), F.concat(F.lit("C"), "id").alias("c_name"), F.lit(0).alias("c_nationkey")),
        "nation": spark.sql("SELECT 0 AS n_nationkey, 'N' AS n_name, 0 AS n_regionkey"),
        "region": spark.sql("SELECT 0 AS r_regionkey, 'R' AS r_name"),
        "lineitem": spark.range(2 * n).select((F.col("id") % n).alias("l_orderkey"), at().alias("l_shipdate"), F.lit("A").alias("l_returnflag"),
                                              F.lit("F").alias("l_linestatus"), F.lit(0.01).alias("l_discount"))}
    for t, df in tables.items():
        df.write.parquet(f"{tmp_path}/{t}.parquet")
    small = FX.threads(spark, str(tmp_path))
    monkeypatch.setattr(FX, "TASK_ROWS", 9)
    large = FX.threads(spark, str(tmp_path))
    assert large.rdd.getNumPartitions() == 10 and sorted(map(repr, large.collect())) == sorted(map(repr, small.collect()))


def test_gold_rows_keep_their_file_without_a_join(spark):
    at = f"{checkpoint_dir(spark)}/bronze-{uuid.uuid4().hex}"
    schema = "case_ref string, parsed_text string"
    spark.createDataFrame([("a", "Subject: Re: [SGCON/1/1] Scam - x in y\nCase closed."), ("b", None), (None, "z")], schema).write.parquet(at)
    seen = []

    def transform(batch):
        out = gold_from_text(batch)
        seen.append(out.columns)
        return out

    got = SM.gold_stream(spark, at, schema, transform)
    joined = SM.gold_stream(spark, at, schema, lambda b: gold_from_text(b.select("case_ref", "parsed_text")))
    assert seen[0][-2:] == ["_mtime", "_path"] and got.columns == joined.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, joined.collect())) and got.count() == 2
