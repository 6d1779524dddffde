"""Properties: the same answer along different paths (survey §5.2)."""

import numpy as np
import uuid

from pyspark.sql import functions as F

from caseflow.operators import search as SE
from caseflow.operators import synth as SY
from caseflow.plans import fixtures as FX
from caseflow.plans.catalog import load_all
from caseflow.plans.q_stream import gold_from_text
from caseflow.sources.tables import Tables

D = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_gold_single_pass_equals_join_path(spark):
    cols = ["Case_Ref", "Case_Type", "Case_Status", "L1_Mission", "Resolution_Days", "Do_Not_Modify_Row_Checksum"]
    a = FX.cases(spark, D).select(*cols, F.concat_ws(",", "L1_Agencies"))
    b = FX.cases_joined(spark, D).select(*cols, F.concat_ws(",", "L1_Agencies"))
    assert _rows(a) == _rows(b)


def test_gold_keys_unique(spark):
    from caseflow.operators.gold import assert_unique_keys
    assert_unique_keys(FX.cases(spark, D), "Case_Ref")


def test_knn_matches_brute_force(spark):
    emb = Tables(spark, D).embeddings
    vecs = {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in emb.collect()}
    q = emb.where(F.col("vec_id") < 5).select(F.col("vec_id").alias("qid"), "embedding")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    got = {(r.qid, r.rank): r.item_id for r in SE.knn(q, items, 3).collect()}
    for qid in range(5):
        scores = sorted((-float((vecs[qid] * v).sum()), i) for i, v in vecs.items())
        for rank, (_, i) in enumerate(scores[:3], 1):
            assert got[(qid, rank)] == i


def test_knn_answer_does_not_depend_on_blocks_or_partitions(spark):
    emb = Tables(spark, D).embeddings
    q = emb.select(F.col("vec_id").alias("qid"), "embedding")
    items = emb.select(F.col("vec_id").alias("item_id"), "embedding")
    want = _rows(SE.knn(q, items, 4))
    assert _rows(SE.knn(q, items, 4, query_block=30, item_block=17)) == want
    assert _rows(SE.knn(q.repartition(7), items.repartition(5), 4, query_block=1000, item_block=3)) == want


def test_knn_ties_and_close_scores(spark):
    """400 equal items: the smallest ids win in any block; 0.90000003 beats 0.90000001."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, embedding array<double>")
    items = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(400)] + [(1000, [0.0, 0.90000001]), (1001, [0.0, 0.90000003])],
                                  "item_id long, embedding array<double>").repartition(6)
    for block in (16384, 50, 7):
        got = {(r.qid, r["rank"]): r.item_id for r in SE.knn(q, items, 3, item_block=block).collect()}
        assert [got[1, k] for k in (1, 2, 3)] == [0, 1, 2] and [got[2, k] for k in (1, 2, 3)] == [1001, 1000, 0]


def test_sparse_knn_equals_dense(spark):
    embed = SE.fit_tfidf(Tables(spark, D).benchmark, "text", num_features=64)
    e = embed(Tables(spark, D).benchmark, "text", "item_id")
    dense = e.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(
        F.get(F.col("embedding.values"), F.array_position("embedding.indices", i.cast("int")).cast("int") - 1), F.lit(0.0))).alias("embedding"))
    as_q = lambda x: x.withColumnRenamed("item_id", "qid")
    assert _rows(SE.knn(as_q(e), e, 3, item_block=9)) == _rows(SE.knn(as_q(dense), dense, 3))


def test_inverted_file_is_exact_and_its_probes_find_nine_tenths(spark):
    import numpy as np

    from caseflow.operators import ivf as IV
    r = np.random.default_rng(1)
    centre = r.standard_normal((12, 20)) * 3
    x = np.vstack([centre[r.integers(12, size=700)] + r.standard_normal((700, 20)), np.ones((60, 20))])  # ties: 60 equal rows
    items = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(9999, None)], "item_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(y) for y in x[i * 15] + r.standard_normal(20) * 0.1]) for i in range(40)]
                                    + [(100, [0.0] * 20), (101, [1.0] * 20), (102, None)], "qid long, embedding array<double>")
    want = SE.knn(queries.where("embedding IS NOT NULL"), items.where("embedding IS NOT NULL"), 5)
    index = IV.build(items, cells=16, parts=5, item_block=50)
    for probes in (1, 4):
        assert _rows(IV.search(index, queries, 5, probes)) == _rows(want)
    assert SE.recall_at_k(IV.search(index, queries, 5, 2, share=0.5), want).first().recall >= 0.9
    few = IV.build(items.limit(3).where("embedding IS NOT NULL"))
    assert IV.search(few, queries, 5).where("qid = 0").count() == 3


def test_snapshot_delta_applied_to_old_gives_new(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "chunk_id string, chunk string")
    new = spark.createDataFrame([("a", "1"), ("b", "22"), ("d", "4")], "chunk_id string, chunk string")
    delta = SE.snapshot_delta(old, new)
    acts = {r.chunk_id: r.action for r in delta.collect()}
    assert acts == {"a": "same", "b": "update", "c": "delete", "d": "insert"}


def test_index_sync_embeds_only_changes_and_equals_a_rebuild(spark):
    from pyspark.sql import types as T

    from caseflow.session import checkpoint_dir
    from caseflow.sources.versioned import VersionedTable
    shape = T.StructType().add("indices", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))
    states = [[(f"c{i}", f"text number {i}") for i in range(40)]]
    states.append([(k, t + " more" if k in ("c3", "c7") else t) for k, t in states[0][:-5]] + [("new", "a new text"), ("none", None)])
    states.append(states[1][1:])
    frames = [spark.createDataFrame(x, "chunk_id string, chunk string") for x in states]
    fit = SE.fit_tfidf(frames[1].select("chunk"), "chunk")
    asked = []

    def embed(df, text, key):
        asked.append(sorted(r[0] for r in df.select(key).collect()))
        return fit(df, text, key)

    index = VersionedTable(spark, f"{checkpoint_dir(spark)}/test-index-{uuid.uuid4().hex}", SE.index_schema(shape), ("chunk_id",), 16)
    commits = [SE.sync_index(index, f, embed) for f in [*frames, frames[-1]]]
    assert asked[1:] == [["c3", "c7", "new", "none"], [], []] and len(asked[0]) == 40
    assert commits[1].counts["insert"] == 2 and commits[1].counts["update"] == 2 and commits[1].counts["delete"] == 5
    assert commits[2].counts == {"delete": 1, "buckets": 1} and commits[3].counts == {"buckets": 0}
    rebuilt = fit(frames[-1], "chunk", "chunk_id").join(frames[-1], "chunk_id").select("chunk_id", "chunk", "embedding")
    assert _rows(index.read().select("chunk_id", "chunk", "embedding")) == _rows(rebuilt)
    assert {r.chunk_id for r in index.read().where("synced = 2").collect()} == {"c3", "c7", "new", "none"}


def test_stream_gold_equals_batch(spark):
    t = Tables(spark, D)
    batch = gold_from_text(SY.truth_threads(t.orders, t.lineitem).select("case_ref", "parsed_text"))
    stream = load_all()["stream_gold"].build(spark, D)
    assert _rows(stream.select(*batch.columns)) == _rows(batch)


def test_truth_tagger_scores_stated_facts_and_decoys(spark):
    """Stated facts are found; a negated mention is a false positive, lower-case and part-word mentions are none."""
    t = Tables(spark, D)
    r = load_all()["truth_vs_tags"].build(spark, D).first()
    negated = SY.truth_threads(t.orders, t.lineitem).where(
        "o_orderkey % 5 = 0 and not array_contains(ev_flags, 'language barrier')").count()
    assert r.agencies_fp == 0 and r.agencies_fn == 0 and r.flags_fn == 0 and r.flags_fp == negated > 0
    assert r.status_correct == r.n and r.country_correct == r.n and r.type_correct == r.n
    assert r.agencies_fn_full > 0 and r.flags_fn_full > 0


def test_model_called_once_per_row(spark):
    from caseflow.functions import record as R
    from caseflow.operators import extract as E
    th = FX.threads(spark, D).select("case_ref", "parsed_text")
    ex = E.extract(th, E.offline_model, E.l1_prompt(), R.l1_struct_type())
    plan = ex.where(F.col("js.Case_Type").isNotNull())._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan          # the model ran before the checkpoint, not in this plan
    assert ex.where(F.col("status") == "ok").count() == th.count()
