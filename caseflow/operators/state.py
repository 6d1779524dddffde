"""Operational tables as append-only event logs plus fold.

Parquet has no row UPDATE/DELETE, and DELETE-then-INSERT is not atomic in the
reference (Q22). Here every change is one appended event and the current state
is a fold: latest event per key by ``(at, seq)``. The fold is an ``max_by``
aggregate, which Spark computes partially per task, so a hot key (one case with
a third of all events) shrinks to one partial row per task before the shuffle;
no group is ever collected whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X
from caseflow.sources.sinks import append, create_if_absent

DEFAULT_AUTHOR = "officer"
# Fixed value: the text shown for a case type without a procedure.
NO_PROCEDURE = "No matching SOP found for this case type."
TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def order_key(at: str = "at", seq: str = "seq") -> Column:
    """Total order of events: time, then sequence number for equal times."""
    return F.struct(F.col(at), F.col(seq))


def fold_latest(events: DataFrame, keys: Sequence[str], values: Sequence[str],
                at: str = "at", seq: str = "seq") -> DataFrame:
    """Latest value of each ``values`` column per ``keys``.

    Result is independent of input order: ties on ``at`` are broken by ``seq``.
    """
    ok = order_key(at, seq)
    aggs = [F.max_by(F.col(v), ok).alias(v) for v in values]
    aggs.append(F.max(ok).getField(at).alias(at))
    return events.groupBy(*keys).agg(*aggs)


# --- M1: status -------------------------------------------------------------------

def apply_status_events(gold: DataFrame, status_events: DataFrame) -> DataFrame:
    """Current status = latest status event, else the loaded status (Q24:
    officer edits live in the log and survive a gold rebuild)."""
    latest = fold_latest(status_events, ["case_ref"], ["status"])
    j = gold.join(latest, gold["Case_Ref"] == latest["case_ref"], "left")
    return j.select(*[F.coalesce(F.col("status"), gold["Case_Status"]).alias(c) if c == "Case_Status"
                      else gold[c] for c in gold.columns])


def status_notes(status_events: DataFrame) -> DataFrame:
    """The audit note each status change writes, by the event's author (column ``by``, if it has one)."""
    by = X.blank_to_null("by") if "by" in status_events.columns else F.lit(None)
    return status_events.select(
        "case_ref", F.coalesce(by, F.lit(DEFAULT_AUTHOR)).alias("author"),
        F.concat(F.lit("Status changed to "), F.col("status"), F.lit(".")).alias("note"), "at", "seq")


# --- M2 / M3 / J5: steps ---------------------------------------------------------------

def completed_steps(step_events: DataFrame) -> DataFrame:
    """``(case_ref, idx)`` currently marked done (M3)."""
    latest = fold_latest(step_events, ["case_ref", "idx"], ["done", "by"])
    return latest.where(F.col("done")).select("case_ref", "idx", "by", "at")


def procedure_of_key(sop_chunks: DataFrame) -> DataFrame:
    """One procedure for each normalised title, ``(_k, chunk_id, chunk)``: the smallest ``chunk_id`` (Q18)."""
    return (sop_chunks.groupBy(X.norm_key("sop_title").alias("_k"))
            .agg(F.min("chunk_id").alias("chunk_id"), F.min_by("chunk", "chunk_id").alias("chunk")))


def case_steps(gold: DataFrame, sop_chunks: DataFrame) -> DataFrame:
    """J4 + X21: each case's procedure steps ``(Case_Ref, idx, step)``, of one procedure."""
    g = gold.select("Case_Ref", X.norm_key("Case_Type").alias("_k"))
    j = g.join(procedure_of_key(sop_chunks), "_k", "inner")
    return (j.select("Case_Ref", F.posexplode(X.numbered_steps("chunk")).alias("idx", "step"))
            .select("Case_Ref", F.col("idx").cast("int").alias("idx"), "step"))


def steps_with_status(gold: DataFrame, sop_chunks: DataFrame, step_events: DataFrame) -> DataFrame:
    """Every step of every case with ``done``."""
    steps = case_steps(gold, sop_chunks)
    done = completed_steps(step_events).select(F.col("case_ref").alias("Case_Ref"),
                                               F.col("idx").cast("int").alias("idx"),
                                               F.lit(True).alias("_done"))
    return (steps.join(done, ["Case_Ref", "idx"], "left")
            .select("Case_Ref", "idx", "step", F.coalesce(F.col("_done"), F.lit(False)).alias("done")))


def recommended_steps(gold: DataFrame, sop_chunks: DataFrame,
                      missing: str = NO_PROCEDURE) -> DataFrame:
    """J4 batch form: the procedure text for every case (default if none)."""
    sop = procedure_of_key(sop_chunks)
    g = gold.select("Case_Ref", "Case_Type", X.norm_key("Case_Type").alias("_k"))
    return (g.join(sop, "_k", "left")
            .select("Case_Ref", "Case_Type", "chunk_id",
                    F.coalesce(F.col("chunk"), F.lit(missing)).alias("steps_text")))


# --- M4: notes ---------------------------------------------------------------------------

def fields_id(*fields: Column) -> Column:
    """SHA-256 over the fields as text, each with its length before it (null: ``-``), so that no two lists of fields run together."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def note_id(case_ref: Column, author: Column, note: Column, at: Column, seq: Column) -> Column:
    """Deterministic note id (replaces uuid4, so replays give equal ids)."""
    return fields_id(case_ref, author, note, F.date_format(at, TS_FORMAT), seq)


def notes_feed(notes: DataFrame) -> DataFrame:
    """All notes with ids and a formatted time; newest first per case when
    ordered for display."""
    author = F.coalesce(X.blank_to_null("author"), F.lit(DEFAULT_AUTHOR))
    return notes.select(
        note_id(F.col("case_ref"), author, F.col("note"), F.col("at"), F.col("seq")).alias("note_id"),
        F.col("case_ref").alias("Case_Ref"), author.alias("author"), "note",
        F.date_format("at", TS_FORMAT).alias("created_at"))


def notes_for(notes: DataFrame, ref: str) -> DataFrame:
    """Single case feed, newest first (tiebreak on the id)."""
    return (notes_feed(notes.where(F.col("case_ref") == F.lit(ref)))
            .orderBy(F.col("created_at").desc(), F.col("note_id").desc()))


# --- J7: case 360 -------------------------------------------------------------------------

def case_360(gold: DataFrame, status_events: DataFrame, step_events: DataFrame,
             notes: DataFrame) -> DataFrame:
    """Record + current status + step and note summary for every case.

    Each side is aggregated to one row per case (bounded values: counts and the
    latest note) before the joins; the full note list of one case is served
    by :func:`notes_for`, never collected into one row."""
    cur = apply_status_events(gold.select("Case_Ref", "Case_Type", "Case_Status"), status_events)
    steps = (completed_steps(step_events).groupBy(F.col("case_ref").alias("Case_Ref"))
             .agg(F.count(F.lit(1)).alias("steps_done")))
    ns = notes.groupBy(F.col("case_ref").alias("Case_Ref")).agg(
        F.count(F.lit(1)).alias("n_notes"), F.max_by("note", order_key()).alias("last_note"))
    j = cur.join(steps, "Case_Ref", "left").join(ns, "Case_Ref", "left")
    return j.select("Case_Ref", "Case_Type", "Case_Status",
                    F.coalesce("steps_done", F.lit(0)).cast("bigint").alias("steps_done"),
                    F.coalesce("n_notes", F.lit(0)).cast("bigint").alias("n_notes"), "last_note")


# --- Chat (W1, A19, J3, M5, M7, O7) -------------------------------------------------------------

def first_user_message(chat: DataFrame) -> DataFrame:
    """First user message per conversation, by ``(created_at, seq)``.

    ``min_by`` instead of ``row_number`` so a huge conversation reduces map-side."""
    return (chat.where(F.col("role") == "user").groupBy("conv_id")
            .agg(F.min_by("content", F.struct("created_at", "seq")).alias("title")))


def chat_list(chat: DataFrame, user_email: str, limit: int = 50) -> DataFrame:
    """M7: a user's conversations, title = first question, newest 50.

    ``limit`` is the feature (a top-k list); ties on time break on ``conv_id``."""
    mine = chat.where(F.col("user_email") == F.lit(user_email))
    agg = mine.groupBy("conv_id").agg(F.max("created_at").alias("updated"))
    first = first_user_message(mine)
    return (agg.join(first, "conv_id", "inner")
            .orderBy(F.col("updated").desc(), F.col("conv_id").desc()).limit(limit)
            .select("conv_id", "title", "updated"))


def conversation(chat: DataFrame, conv_id) -> DataFrame:
    """Messages of one conversation in time order."""
    return (chat.where(F.col("conv_id") == F.lit(conv_id))
            .orderBy("created_at", "seq").select("role", "content", "route", "created_at", "seq"))


# --- Writing (M1, M2, M4-M6, K4) ------------------------------------------------------------------
#
# Every write appends events to a log folder; reading is the fold above. Ids are
# hashes of the event, so a replayed batch appends the same ids and reading
# drops the repeats.

LOG_SCHEMAS = {
    "status": "event_id string, case_ref string, status string, by string, at timestamp_ntz, seq bigint",
    "steps": "event_id string, case_ref string, idx int, done boolean, by string, at timestamp_ntz, seq bigint",
    "notes": "event_id string, case_ref string, author string, note string, at timestamp_ntz, seq bigint",
    "chat": "event_id string, conv_id bigint, user_email string, role string, content string, route string, created_at bigint, seq bigint",
    "thread_map": "event_id string, conv_id bigint, assistant_conv_id string, at timestamp_ntz, seq bigint",
}


def append_events(events: DataFrame, store: str, log: str) -> None:
    """Append ``events`` to the log named ``log`` under the folder ``store``."""
    names = [f.name for f in T.StructType.fromDDL(LOG_SCHEMAS[log]).fields if f.name != "event_id"]
    rows = events.select(fields_id(F.lit(log), *[F.col(c) for c in names]).alias("event_id"), *names)
    typed = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(LOG_SCHEMAS[log]).fields]
    append(rows.select(*typed), f"{store}/{log}")


def read_events(spark, store: str, log: str) -> DataFrame:
    """All events of a log, each id once; empty if nothing was written yet."""
    return create_if_absent(spark, f"{store}/{log}", T.StructType.fromDDL(LOG_SCHEMAS[log])).dropDuplicates(["event_id"])


def set_status(changes: DataFrame, store: str) -> None:
    """M1: ``changes(case_ref, status, by, at, seq)`` to the status log, each with its audit note."""
    append_events(changes, store, "status")
    append_events(status_notes(changes), store, "notes")


def toggle_steps(changes: DataFrame, store: str) -> None:
    """M2: ``changes(case_ref, idx, done, by, at, seq)``; the latest event of a step decides."""
    append_events(changes, store, "steps")


def add_notes(notes: DataFrame, store: str) -> None:
    """M4: ``notes(case_ref, author, note, at, seq)``; a blank author becomes the default, blank notes are not written."""
    author = F.coalesce(X.blank_to_null("author"), F.lit(DEFAULT_AUTHOR))
    append_events(notes.where(F.trim("note") != "").withColumn("author", author), store, "notes")


def add_chat(messages: DataFrame, store: str) -> None:
    """M5: chat messages ``(conv_id, user_email, role, content, route, created_at, seq)``."""
    append_events(messages, store, "chat")


def upsert_thread_map(pairs: DataFrame, store: str) -> None:
    """M6: ``pairs(conv_id, assistant_conv_id, at, seq)``; the latest pair of a conversation counts."""
    append_events(pairs, store, "thread_map")
