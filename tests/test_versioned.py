"""Versioned tables: merges, change log, time travel, replays, conflicts; against a plain dict."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.session import checkpoint_dir
from caseflow.sources import versioned
from caseflow.sources.versioned import Conflict, VersionedTable

SCHEMA = (T.StructType().add("k", "string").add("n", "integer").add("v", "string").add("at", "long")
          .add("tags", T.ArrayType(T.StringType())))


def table(spark, buckets=5, keys=("k", "n")):
    return VersionedTable(spark, f"{checkpoint_dir(spark)}/versioned-{uuid.uuid4().hex}", SCHEMA, keys, buckets)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_equal_a_plain_dict(spark):
    r, t, state, history, logs = random.Random(3), table(spark), {}, [{}], []
    for _ in range(5):
        batch = {}
        for _ in range(r.randint(1, 12)):
            k = r.choice(["a", "b", "c", None]), r.choice([1, 2, None])
            batch[k] = (*k, r.choice(["x", "y", None]), r.randint(0, 2), r.choice([None, ["p"], []])), r.random() < 0.3
        df = spark.createDataFrame([(*v, d) for v, d in batch.values()], T.StructType([*SCHEMA.fields, T.StructField("d", T.BooleanType())]))
        t.merge(df, deleted="d")
        log = []
        for k, (v, d) in batch.items():
            old = state.get(k)
            if d:
                log += [("delete", *old)] if old else []
                state.pop(k, None)
            elif old != v:
                log += [("insert", *v)] if old is None else [("update_before", *old), ("update_after", *v)]
                state[k] = v
        history.append(dict(state))
        logs.append(log)
    for v, want in enumerate(history):
        assert rows(t.read(v)) == sorted(want.values(), key=repr)
    for a in range(6):
        for b in range(a, 6):
            assert rows(t.changes(a, b)) == sorted(((i + 1, *x) for i in range(a, b) for x in logs[i]), key=repr)
    with pytest.raises(ValueError, match="no version"):
        t.read(99)


def test_only_touched_buckets_are_rewritten(spark):
    t = table(spark, 16)
    t.merge(spark.range(200).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("n"), F.lit("v").alias("v"),
                                    F.lit(0).alias("at"), F.lit(None).cast("array<string>").alias("tags")))
    before = t.commit()
    c = t.merge(spark.createDataFrame([("7", 1, "new", 1, None)], SCHEMA))
    assert c.counts == {"update": 1, "buckets": 1} and len(before.buckets) == 16
    assert sum(before.buckets[b] != c.buckets[b] for b in c.buckets) == 1
    assert t.lookup("7", 1).first().v == "new" and t.lookup("8", 1).first().v == "v"
    plan = t.lookup("7", 1)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryFileIndex(1 paths)" in plan
    same = t.merge(spark.createDataFrame([("7", 1, "new", 1, None)], SCHEMA))
    assert same.counts == {"buckets": 0} and same.buckets == c.buckets and t.changes(c.number).count() == 0


def test_order_repeats_and_replays(spark):
    t = table(spark, keys=("k",))
    first = [("a", 1, "old", 1, None), ("a", 1, "new", 5, None), ("b", 1, "x", 2, None)]
    t.merge(spark.createDataFrame(first, SCHEMA), order=["at"], batch=("s", 0))
    t.merge(spark.createDataFrame([("a", 1, "late", 3, None)], SCHEMA), order=["at"], batch=("s", 1))
    again = t.merge(spark.createDataFrame([("a", 9, "twice", 9, None)], SCHEMA), order=["at"], batch=("s", 1))
    assert again.number == 2 and {r.k: r.v for r in t.read().collect()} == {"a": "new", "b": "x"}
    with pytest.raises(ValueError, match="more than once"):
        t.merge(spark.createDataFrame(first, SCHEMA))


def test_two_writers_and_a_dead_one(spark):
    t = table(spark, keys=("k",))
    t.merge(spark.createDataFrame([("a", 1, "x", 1, None)], SCHEMA))
    with pytest.raises(Conflict):
        t._publish(t.commit())  # the number is taken
    spark.createDataFrame([("b", 1, "lost", 1, None)], SCHEMA).write.parquet(f"{t.folder}/data/dead/bucket=0")  # never published
    assert [r.k for r in t.read().collect()] == ["a"]
    t.merge(spark.createDataFrame([("a", 1, "x", 1, None, True)], T.StructType([*SCHEMA.fields, T.StructField("d", T.BooleanType())])), deleted="d")
    assert t.read().count() == 0 and t.commit().buckets == {} and t.read(1).count() == 1


def test_passes_change_no_row(spark, monkeypatch):
    """Large merges go through their buckets in passes and parts; states, counts and logs stay those of a plain dict."""
    for name, n in (("PASS_ROWS", 30), ("PART_ROWS", 4), ("PASSES", 3)):
        monkeypatch.setattr(versioned, name, n)
    states = [{i: (f"k{i}", i, "a", 0, None) for i in range(60)}]
    states.append({i: (*r[:2], "b", 1, ["t"]) if i % 3 == 0 else r for i, r in states[0].items() if i % 5} | {99: (None, None, "n", 0, [])})
    states.append({})
    t, was = table(spark), {}
    for number, now in enumerate(states, 1):
        c = t.replace(spark.createDataFrame([*now.values()], SCHEMA))
        new, gone, changed = set(now) - set(was), set(was) - set(now), {i for i in set(now) & set(was) if now[i] != was[i]}
        want = {"insert": len(new), "update": len(changed), "delete": len(gone), "buckets": 5}
        assert c.number == number and c.counts == {k: n for k, n in want.items() if n}
        assert rows(t.read()) == sorted(now.values(), key=repr)
        log = ([("insert", *now[i]) for i in new] + [("delete", *was[i]) for i in gone]
               + [x for i in changed for x in (("update_before", *was[i]), ("update_after", *now[i]))])
        assert rows(t.changes(number - 1)) == sorted(((number, *x) for x in log), key=repr)
        was = now
    assert rows(t.read(1)) == sorted(states[0].values(), key=repr)
    none = t.merge(spark.createDataFrame([("k1", 1, "a", 0, None, True)], T.StructType([*SCHEMA.fields, T.StructField("d", T.BooleanType())])), deleted="d")
    assert none.counts == {"buckets": 0} and none.log is None and t.read().count() == 0


def test_changes_of_earlier_layouts_are_read(spark):
    """A log that holds its inserts and updates after, too, with data that marks none."""
    t = table(spark, 1, keys=("k",))
    row = spark.createDataFrame([("a", 1, "x", 1, None)], SCHEMA)
    row.write.parquet(f"{t.folder}/data/early/bucket=0")
    row.select(F.lit(1).cast("long").alias("commit"), F.lit("insert").alias("change"), "*").write.parquet(f"{t.folder}/log/early")
    t._publish(versioned.Commit(1, {"0": "early"}, "early", {"insert": 1, "buckets": 1}, {}))
    t.merge(spark.createDataFrame([("a", 1, "y", 1, None), ("b", 1, "z", 1, None)], SCHEMA))
    assert rows(t.changes(0)) == [(1, "insert", "a", 1, "x", 1, None), (2, "insert", "b", 1, "z", 1, None),
                                  (2, "update_after", "a", 1, "y", 1, None), (2, "update_before", "a", 1, "x", 1, None)]


def test_compaction_changes_no_state(spark):
    from caseflow.operators.compaction import CompactedLog
    shape = T.StructType().add("k", "string").add("v", "string").add("at", "long").add("seq", "long").add("deleted", "boolean")
    log, r, events = CompactedLog(spark, f"{checkpoint_dir(spark)}/log-{uuid.uuid4().hex}", shape, ("k",), buckets=4), random.Random(9), []

    def state():
        best = {}
        for e in events:
            if e[0] not in best or e[2:4] > best[e[0]][2:4]:
                best[e[0]] = e
        assert rows(log.state(tombstones=True)) == sorted(best.values(), key=repr)
        assert rows(log.state()) == sorted((e for e in best.values() if not e[4]), key=repr)

    state()
    for step in range(6):
        batch = [(r.choice("abcde"), r.choice("xyz"), r.randint(0, 20), 100 * step + i, r.random() < 0.3) for i in range(6)]
        events += batch
        log.append(spark.createDataFrame(batch, shape))
        if step == 2:
            log.append(spark.createDataFrame(batch, shape))  # replayed
        state()
        if step in (1, 4):
            assert log.compact().number and log.segments() == []
        if step == 3:
            log.fold()  # dies before its second step
            assert len(log.segments()) == 3
        state()
    assert len(log.base.versions()) == 3 and len(log.segments()) == 1


def test_confusion_counts_classes_and_missing_rows(spark):
    from caseflow.operators.analytics import confusion
    truth = spark.createDataFrame([("a", "X", ["p", "q"]), ("b", None, None), ("c", "Y", ["p"])], "case_ref string, kind string, tags array<string>")
    found = spark.createDataFrame([("a", "Y", ["q", "r", "r"]), ("b", "Y", []), ("d", "X", ["p"])], "case_ref string, k string, g array<string>")
    got = confusion(truth, found, {"kind": ("kind", "k")}, {"tags": ("tags", "g")})
    assert rows(got) == sorted([("row", "yes", "yes", 2), ("row", "yes", None, 1), ("row", None, "yes", 1), ("kind", "X", "Y", 1), ("kind", None, "Y", 1),
                                ("tags", "p", None, 1), ("tags", "q", "q", 1), ("tags", None, "r", 1)], key=repr)
