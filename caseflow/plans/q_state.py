"""Operational state, procedures, chat and routing queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.operators import routing as RT
from caseflow.operators import state as ST
from caseflow.operators.compaction import CompactedLog
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans import q_search as QS
from caseflow.plans.catalog import register
from caseflow.session import checkpoint_dir

TS_SQL = "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"
_AUTHOR_SQL = "coalesce(nullif(author, ''), 'officer')"


def _id_sql(*fields: str) -> str:
    """SHA-256 over fields with their lengths, as :func:`state.fields_id`."""
    return "sha256(" + " || ".join(f"coalesce(length({f}) || ':' || {f}, '-')" for f in fields) + ")"


CHAT_USER = "officer3@example.org"
CHAT_CONV = 0


def _on_cases_events(body: str, *extra: str) -> str:
    return S.sql_with(body, S.GOLD + S.EVENTS + list(extra))


def _latest(src: str, keys: str, cols: str) -> str:
    return (f"(SELECT {keys}, {cols}, at_ FROM (SELECT *, row_number() OVER "
            f"(PARTITION BY {keys} ORDER BY at_ DESC, seq DESC) AS rn FROM {src}) WHERE rn = 1)")


@register("apply_status_events", _on_cases_events(f"""
SELECT c.Case_Ref, coalesce(l.status, c.Case_Status) AS Case_Status
FROM cases c LEFT JOIN {_latest('status_events', 'case_ref', 'status')} l ON c.Case_Ref = l.case_ref"""),
          ops=("M1", "W2"))
def apply_status_events(spark, d):
    """Current status: latest status event per case, else the loaded one."""
    g = FX.stored_cases(spark, d).select("Case_Ref", "Case_Status")
    return ST.apply_status_events(g, FX.status_events(spark, d))


@register("apply_step_events", S.sql_with(f"""
SELECT case_ref, idx, by_ AS "by", {TS_SQL.format(c='at_')} AS "at"
FROM {_latest('step_events', 'case_ref, idx', 'done, by_')} WHERE done""", S.EVENTS), ops=("M2", "M3"))
def apply_step_events(spark, d):
    """Steps currently done per case after folding set/unset events."""
    done = ST.completed_steps(FX.step_events(spark, d))
    return done.withColumn("at", F.date_format("at", ST.TS_FORMAT))


_NOTES_SQL = """notes AS (
  SELECT case_ref, author, note, at_, seq FROM note_events
  UNION ALL
  SELECT case_ref, 'officer', 'Status changed to ' || status || '.', at_, seq FROM status_events)"""


@register("notes_feed", S.sql_with(f"""
SELECT {_id_sql('case_ref', 'a', 'note', TS_SQL.format(c='at_'), 'CAST(seq AS VARCHAR)')} AS note_id,
       case_ref AS Case_Ref, a AS author, note, {TS_SQL.format(c='at_')} AS created_at
FROM (SELECT *, coalesce(nullif(author, ''), 'officer') AS a FROM notes)""", S.EVENTS + [_NOTES_SQL]),
          ops=("M4", "M1", "O7"))
def notes_feed(spark, d):
    """Every note (officer notes and status-change audit notes) with ids."""
    notes = FX.note_events(spark, d).unionByName(ST.status_notes(FX.status_events(spark, d)))
    return ST.notes_feed(notes)


@register("latest_state", S.sql_with(f"""
SELECT conv_id, assistant_conv_id, {TS_SQL.format(c='at_')} AS updated_at
FROM {_latest("(SELECT user_id AS conv_id, 'g' || CAST(event_id AS VARCHAR) AS assistant_conv_id, ts AS at_, "
              "event_id AS seq FROM events)", 'conv_id', 'assistant_conv_id')}""", []), ops=("M6", "W2"))
def latest_state(spark, d):
    """Upsert-by-fold: latest thread mapping per conversation."""
    f = ST.fold_latest(FX.thread_map_events(spark, d), ["conv_id"], ["assistant_conv_id"])
    return f.select("conv_id", "assistant_conv_id", F.date_format("at", ST.TS_FORMAT).alias("updated_at"))


_NORM = "regexp_replace(lower({c}), '[^a-z]', '', 'g')"
_STEPS_SQL = r"""list_transform(list_filter(string_split_regex(chunk, '\r?\n'),
                 lambda x: regexp_matches(x, '^\s*\d+\.\s+')), lambda x: trim(regexp_replace(x, '^\s*\d+\.\s*', '')))"""


@register("steps_with_status", S.sql_with(f"""
SELECT c.Case_Ref, CAST(i - 1 AS INTEGER) AS idx, steps[i] AS step,
       coalesce(dn.done, false) AS done
FROM (SELECT c.Case_Ref, {_STEPS_SQL} AS steps
      FROM cases c JOIN sop s ON {_NORM.format(c='c.Case_Type')} = {_NORM.format(c='s.sop_title')}) c,
     LATERAL (SELECT unnest(range(1, len(c.steps) + 1)) AS i) r
LEFT JOIN (SELECT case_ref, idx, true AS done FROM {_latest('step_events', 'case_ref, idx', 'done')} WHERE done) dn
  ON dn.case_ref = c.Case_Ref AND dn.idx = i - 1""", S.GOLD + S.EVENTS + [S.sop_values_sql()]),
          ops=("J5", "J4", "X20", "X21", "M3", "S8"))
def steps_with_status(spark, d):
    """Each case's procedure steps with their done flag."""
    return ST.steps_with_status(FX.stored_cases(spark, d), FX.sop(spark), FX.step_events(spark, d))


@register("recommended_steps", S.on_cases(f"""
SELECT c.Case_Ref, c.Case_Type, s.chunk_id,
       coalesce(s.chunk, '{ST.NO_PROCEDURE}') AS steps_text
FROM cases c LEFT JOIN (SELECT {_NORM.format(c='sop_title')} AS k, min(chunk_id) AS chunk_id,
                               arg_min(chunk, chunk_id) AS chunk FROM sop GROUP BY 1) s
  ON {_NORM.format(c='c.Case_Type')} = s.k""", S.sop_values_sql()), ops=("J4", "X20", "S8", "V2"))
def recommended_steps(spark, d):
    """Procedure text matched to every case by normalised title."""
    return ST.recommended_steps(FX.stored_cases(spark, d), FX.sop(spark))


@register("case_360", _on_cases_events(f"""
SELECT c.Case_Ref, c.Case_Type, coalesce(ls.status, c.Case_Status) AS Case_Status,
       coalesce(sd.steps_done, 0) AS steps_done, coalesce(nn.n_notes, 0) AS n_notes, nn.last_note
FROM cases c
LEFT JOIN {_latest('status_events', 'case_ref', 'status')} ls ON c.Case_Ref = ls.case_ref
LEFT JOIN (SELECT case_ref, count(*) AS steps_done
           FROM {_latest('step_events', 'case_ref, idx', 'done')} WHERE done GROUP BY case_ref) sd
  ON c.Case_Ref = sd.case_ref
LEFT JOIN (SELECT case_ref, count(*) AS n_notes, arg_max(note, (at_, seq)) AS last_note
           FROM note_events GROUP BY case_ref) nn ON c.Case_Ref = nn.case_ref"""), ops=("J7",))
def case_360(spark, d):
    """Record, current status, steps done and note summary per case."""
    return ST.case_360(FX.stored_cases(spark, d), FX.status_events(spark, d), FX.step_events(spark, d),
                       FX.note_events(spark, d))


@register("chat_first_message", S.sql_with("""
SELECT conv_id, arg_min(content, (created_at, seq)) AS title FROM chat WHERE role = 'user' GROUP BY conv_id""",
                                           [S.CHAT]), ops=("W1",))
def chat_first_message(spark, d):
    """First user message of every conversation."""
    return ST.first_user_message(FX.chat(spark, d))


@register("chat_list", S.sql_with(f"""
SELECT a.conv_id, f.title, a.updated FROM
  (SELECT conv_id, max(created_at) AS updated FROM chat WHERE user_email = '{CHAT_USER}' GROUP BY conv_id) a
  JOIN (SELECT conv_id, arg_min(content, (created_at, seq)) AS title FROM chat
        WHERE user_email = '{CHAT_USER}' AND role = 'user' GROUP BY conv_id) f ON a.conv_id = f.conv_id
ORDER BY a.updated DESC, a.conv_id DESC LIMIT 50""", [S.CHAT]), ops=("M7", "A19", "J3", "O6"))
def chat_list(spark, d):
    """A user's conversations with title and last update, newest 50."""
    return ST.chat_list(FX.chat(spark, d), CHAT_USER)


@register("chat_messages", S.sql_with(f"""
SELECT role, content, route, created_at, seq FROM chat WHERE conv_id = {CHAT_CONV}""", [S.CHAT]),
          ops=("O7", "M5"))
def chat_messages(spark, d):
    """Messages of one conversation in time order."""
    return ST.conversation(FX.chat(spark, d), CHAT_CONV)


# --- writing: two rounds, the second replays the first, then the fold -----------------------------

def _written(spark, events, write, log, extra=()):
    """Append the even events, then all of them (a replay of the first round), and read the log back."""
    import os
    import uuid

    store = os.path.join(checkpoint_dir(spark), "caseflow-state", uuid.uuid4().hex)
    write(events.where(F.col("seq") % 2 == 0), store)
    write(events, store)
    return [ST.read_events(spark, store, x) for x in (log, *extra)]


_BY = "'officer' || CAST(seq % 3 AS VARCHAR)"


def _by(df):
    return df.withColumn("by", F.concat(F.lit("officer"), (F.col("seq") % 3).cast("string")))


@register("write_status", S.sql_with(f"""
SELECT l.case_ref, l.status, n.n_notes, n.last_note, n.last_author
FROM {_latest('status_events', 'case_ref', 'status')} l
JOIN (SELECT case_ref, count(*) AS n_notes, arg_max('Status changed to ' || status || '.', (at_, seq)) AS last_note,
             arg_max({_BY}, (at_, seq)) AS last_author FROM status_events GROUP BY case_ref) n ON l.case_ref = n.case_ref""",
          S.EVENTS), ops=("M1", "M4", "K4", "W2"))
def write_status(spark, d):
    """Status changes written with their audit notes, in two rounds; status and notes read back."""
    log, notes = _written(spark, _by(FX.status_events(spark, d)), ST.set_status, "status", ("notes",))
    audit = notes.groupBy("case_ref").agg(F.count(F.lit(1)).alias("n_notes"), F.max_by("note", ST.order_key()).alias("last_note"),
                                          F.max_by("author", ST.order_key()).alias("last_author"))
    return ST.fold_latest(log, ["case_ref"], ["status"]).select("case_ref", "status").join(audit, "case_ref")


@register("write_steps", S.sql_with(f"""
SELECT case_ref, idx, {TS_SQL.format(c='at_')} AS "at"
FROM {_latest('step_events', 'case_ref, idx', 'done')} WHERE done""", S.EVENTS), ops=("M2", "M3", "K4"))
def write_steps(spark, d):
    """Step toggles written in two rounds; the steps done read back."""
    (log,) = _written(spark, FX.step_events(spark, d), ST.toggle_steps, "steps")
    return ST.completed_steps(log).select("case_ref", "idx", F.date_format("at", ST.TS_FORMAT).alias("at"))


@register("write_notes", S.sql_with(f"""
SELECT {_id_sql('case_ref', _AUTHOR_SQL, 'note', TS_SQL.format(c='at_'), 'CAST(seq AS VARCHAR)')} AS note_id,
       case_ref AS Case_Ref, coalesce(nullif(author, ''), 'officer') AS author, note, {TS_SQL.format(c='at_')} AS created_at
FROM note_events WHERE trim(note) <> ''""", S.EVENTS), ops=("M4", "K4", "O7"))
def write_notes(spark, d):
    """Notes written in two rounds; the feed read back."""
    (log,) = _written(spark, FX.note_events(spark, d), ST.add_notes, "notes")
    return ST.notes_feed(log)


@register("write_chat", S.sql_with("SELECT conv_id, user_email, role, content, route, created_at FROM chat", [S.CHAT]), ops=("M5", "K4"))
def write_chat(spark, d):
    """Chat messages written in two rounds and read back."""
    (log,) = _written(spark, FX.chat(spark, d), ST.add_chat, "chat")
    return log.select("conv_id", "user_email", "role", "content", "route", "created_at")


@register("write_thread_map", S.sql_with(f"""
SELECT conv_id, assistant_conv_id
FROM {_latest("(SELECT user_id AS conv_id, 'g' || CAST(event_id AS VARCHAR) AS assistant_conv_id, ts AS at_, "
              "event_id AS seq FROM events)", 'conv_id', 'assistant_conv_id')}""", []), ops=("M6", "K4", "W2"))
def write_thread_map(spark, d):
    """Thread mappings upserted in two rounds; the latest read back."""
    (log,) = _written(spark, FX.thread_map_events(spark, d), ST.upsert_thread_map, "thread_map")
    return ST.fold_latest(log, ["conv_id"], ["assistant_conv_id"]).select("conv_id", "assistant_conv_id")


# --- questions people ask: one look-up a customer, one question a type, type and nation, nation -------

_QUESTIONS_SQL = """questions AS (
  SELECT 'look:' || o_custkey AS qid, 'What happened to ' || min('SGCON/' || year(o_orderdate) || '/' || (10000 + o_orderkey)) || '?' AS question
  FROM orders GROUP BY o_custkey
  UNION ALL SELECT DISTINCT 'proc:' || case_type, 'Which procedure covers ' || case_type || '?' FROM facts
  UNION ALL SELECT DISTINCT 'sim:' || case_type || ':' || n_name, 'Any similar cases of ' || case_type || ' in ' || n_name || '?' FROM facts
  UNION ALL SELECT DISTINCT 'count:' || n_name, 'How many cases are there in ' || n_name || '?' FROM facts)"""


def _questions(spark, d):
    g = FX.stored_cases(spark, d).select("Case_Type", "Case_Location", "Case_Ref")
    look = FX.Tables(spark, d).orders.select("o_custkey", F.concat(
        F.lit("SGCON/"), F.year("o_orderdate").cast("string"), F.lit("/"), (F.lit(10000) + F.col("o_orderkey")).cast("string")).alias("ref"))
    look = look.groupBy("o_custkey").agg(F.min("ref").alias("ref")).select(
        F.concat(F.lit("look:"), "o_custkey").alias("qid"), F.concat(F.lit("What happened to "), "ref", F.lit("?")).alias("question"))
    ask = lambda cols, qid, q: g.select(*cols).distinct().select(F.concat(*qid).alias("qid"), F.concat(*q).alias("question"))
    t, n = F.col("Case_Type"), F.col("Case_Location")
    return (look.union(ask([t], [F.lit("proc:"), t], [F.lit("Which procedure covers "), t, F.lit("?")]))
            .union(ask([t, n], [F.lit("sim:"), t, F.lit(":"), n], [F.lit("Any similar cases of "), t, F.lit(" in "), n, F.lit("?")]))
            .union(ask([n], [F.lit("count:"), n], [F.lit("How many cases are there in "), n, F.lit("?")])))


_ROUTED_SQL = """routed AS (SELECT qid, question, nullif(regexp_extract(question, 'SGCON/[0-9]{4}/[0-9]+', 0), '') AS case_ref,
  CASE split_part(qid, ':', 1) WHEN 'look' THEN 'case_lookup' WHEN 'proc' THEN 'procedure' WHEN 'sim' THEN 'similar' ELSE 'structured' END AS route
  FROM questions)"""


@register("route_questions", S.on_threads("SELECT qid, route, case_ref FROM routed", _QUESTIONS_SQL, _ROUTED_SQL), ops=("R1", "R2"))
def route_questions(spark, d):
    """Route and named case reference of questions of all four kinds, references without brackets."""
    return RT.route_questions(_questions(spark, d)).select("qid", "route", "case_ref")


def _stub_router(prompts):
    """Stand-in for a hosted router: answers in JSON, chatter or nonsense by the question's kind."""
    out = []
    for p in prompts:
        q = p.rsplit("Question: ", 1)[-1]
        out.append('So: {"route": "similar"} ok' if "similar" in q else '{"route": "procedure"' if "procedure" in q
                   else '{"route": "weather"}' if "How many" in q else '{"route": "case_lookup", "case_ref": null}')
    return out


@register("model_route_questions", S.on_threads("""
SELECT qid, CASE route WHEN 'procedure' THEN 'structured' ELSE route END AS route, case_ref FROM routed""", _QUESTIONS_SQL, _ROUTED_SQL),
          ops=("R1", "X5"))
def model_route_questions(spark, d):
    """The same questions through the model plug point: broken and unknown answers fall back to structured."""
    return RT.route_questions(_questions(spark, d), model=_stub_router).select("qid", "route", "case_ref")


@register("route_mix", S.on_threads("SELECT route, count(*) AS n FROM routed GROUP BY route", _QUESTIONS_SQL, _ROUTED_SQL), ops=("R4",))
def route_mix(spark, d):
    """Questions per route."""
    return RT.route_mix(RT.route_questions(_questions(spark, d)))


@register("question_evidence", S.on_cases(f"""
SELECT r.qid, route, source, e.evidence, CAST(NULL AS VARCHAR) AS found_ref FROM (
  SELECT qid, route, CASE route WHEN 'similar' THEN 'Semantic search over case email threads' ELSE 'SOP / procedures library' END AS source
  FROM routed WHERE route IN ('similar', 'procedure')) r JOIN (
  SELECT qid, string_agg('**' || id || '** (' || coalesce(Case_Type, 'None') || ', ' || coalesce(Case_Location, 'None') || ')' || chr(10)
                         || substr(text, 1, 280) || '...', chr(10) || chr(10) ORDER BY rank) AS evidence
  FROM hits JOIN chunks ON item_id = id JOIN cases c ON c.Case_Ref = id GROUP BY qid
  UNION ALL
  SELECT qid, string_agg('**SOP: ' || replace(sop_title, '_', ' ') || '**' || chr(10) || substr(chunk, 1, 500), chr(10) || chr(10) ORDER BY rank)
  FROM p_hits JOIN sop ON item_id = chunk_id GROUP BY qid) e ON r.qid = e.qid
UNION ALL SELECT qid, route, 'Case record ' || routed.case_ref, NULL, c.Case_Ref FROM routed LEFT JOIN cases c ON c.Case_Ref = routed.case_ref WHERE route = 'case_lookup'
UNION ALL SELECT qid, route, 'Structured case table', NULL, NULL FROM routed WHERE route = 'structured'""",
    _QUESTIONS_SQL, _ROUTED_SQL, S.sop_values_sql(), QS.CASE_CHUNKS_SQL,
    *QS.search_ctes("SELECT text FROM chunks", "SELECT qid AS id, question AS text FROM routed WHERE route = 'similar'",
                    "SELECT * FROM chunks", 3, ""),
    *QS.search_ctes("SELECT chunk FROM sop", "SELECT qid AS id, question AS text FROM routed WHERE route = 'procedure'",
                    "SELECT chunk_id AS id, chunk AS text FROM sop", 2, "p_")), ops=("R3", "R1", "R2", "V5", "V6", "V7", "F8"))
def question_evidence(spark, d):
    """Evidence for every question by route; for look-ups the reference of the record found."""
    from caseflow.operators import governance as G
    th = FX.stored_threads(spark, d)
    record = FX.record_from_l1(FX.l1_model_stand_in(th))
    path = f"{checkpoint_dir(spark).rstrip('/')}/evidence-chunks-{uuid.uuid4().hex}"
    G.email_chunks(record, th.select("case_ref", "parsed_text")).write.parquet(path)  # fitted, embedded and shown: scrubbed once
    chunks = spark.read.parquet(path)
    e = RT.question_evidence(_questions(spark, d), FX.stored_cases(spark, d), chunks, FX.sop(spark))
    look = F.col("route") == "case_lookup"
    return e.select("qid", "route", "source", F.when(~look, F.col("evidence")).alias("evidence"),
                    F.when(look, F.get_json_object("evidence", "$.Case_Ref")).alias("found_ref"))


@register("compacted_status", S.sql_with("""
SELECT case_ref, status FROM (
  SELECT case_ref, status, seq, row_number() OVER (PARTITION BY case_ref ORDER BY at_ DESC, seq DESC) AS rn
  FROM status_events) WHERE rn = 1 AND seq % 13 <> 0""", S.EVENTS), ops=("M1", "K4", "W2"))
def compacted_status(spark, d):
    """Current status from a snapshot and the log's tail: two loads compacted, late events and withdrawals after it."""
    shape = (T.StructType().add("case_ref", "string").add("status", "string").add("at", T.TimestampNTZType())
             .add("seq", "long").add("deleted", "boolean"))
    log = CompactedLog(spark, f"{checkpoint_dir(spark).rstrip('/')}/compacted-{uuid.uuid4().hex}", shape, ("case_ref",), buckets=16)
    events = FX.status_events(spark, d).withColumn("deleted", F.col("seq") % 13 == 0)
    for part in (0, 1, 2):
        log.append(events.where(F.col("seq") % 3 == part))
        if part == 1:
            log.compact()
    return log.state().select("case_ref", "status")
