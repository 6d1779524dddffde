"""Model extraction plug point and evidence-only tagging.

A *model* is any ``Callable[[list[str]], list[str | None]]``: a batch of
prompts in, raw answers out. It runs inside an Arrow-batched ``pandas_udf``,
marked non-deterministic so Catalyst never duplicates the call, and the result
is checkpointed into the shared folder right away, so a lost executor or a
second projection never repeats a model call (§3.1 / §4 of the survey).

The default tagger needs no model: Column regexes that set a tag only when the
text states it (evidence-only), so it runs in whole-stage codegen.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import record as R
from caseflow.functions import text as X
from caseflow.session import materialize

ModelFn = Callable[[list[str]], list]

CORRUPT = "_corrupt_record"

# ---------------------------------------------------------------------------
# Controlled vocabularies the reference's prompts name.
# ---------------------------------------------------------------------------
AGENCIES = ["ICA", "SPF", "MHA", "MOH"]
FLAGS = ["scam", "MP/POH escalation", "language barrier", "welfare concern"]
HQ_UNITS = ["CRC", "CON/OPS"]
COUNTRIES = ["Thailand", "China", "Malaysia", "Indonesia", "United Kingdom", "Australia", "Japan", "India"]
MISSIONS = {"Thailand": "Bangkok", "China": "Guangzhou", "Malaysia": "Kuala Lumpur",
            "Indonesia": "Jakarta", "United Kingdom": "London", "Australia": "Canberra",
            "Japan": "Tokyo", "India": "New Delhi"}

# Our own cue phrases for the rule tagger: a flag is set only when one occurs.
FLAG_CUES = {
    "scam": r"(?i)\bscam",
    "MP/POH escalation": r"(?i)\bescalated by\b",
    "language barrier": r"(?i)\b(translator|interpreter|language barrier)\b",
    "welfare concern": r"(?i)\bwelfare concern\b",
}
STATUS_CUES = (("closed", r"(?i)\bcase closed\b"), ("pending", r"(?i)\bcase pending\b"))


# --- X6: prompts -----------------------------------------------------------------

# What a model may answer, field by field: allowed values or a format.
CASE_TYPES = ["Arrest & Detention", "Serious Illness/Death", "Victim of Crime", "Lost/Stolen Document", "Evacuation", "Scam"]
FIELD_RULES = {
    "Created_On": "a date, YYYY-MM-DD",
    "Case_Type": f"one of {'; '.join(CASE_TYPES)}",
    "Case_Status": "one of In Progress, On Hold, Pending, Closed",
    "Case_Handler": f"one of {', '.join(HQ_UNITS)}",
    "L1_Country": f"one of {', '.join(COUNTRIES)}",
    "L1_Mission": f"one of {', '.join(MISSIONS.values())}",
    "L1_Case_Type": f"one of {'; '.join(CASE_TYPES)}",
    "L1_Agencies": f"a list out of {', '.join(AGENCIES)}",
    "L1_Situational_Flags": f"a list out of {', '.join(FLAGS)}",
    "L1_Status": "closed or pending",
    "L2_Summary_Pathway": "two sentences",
}


def build_prompt(task: str, fields: Sequence[str], rules: dict[str, str] | None = None) -> str:
    """Prompt text: the task, one line for each field with its rule, and how to answer.
    The document is appended as a Column, so no SQL escaping is needed."""
    rules = FIELD_RULES if rules is None else rules
    lines = [f"- {f}: {rules[f]}" if f in rules else f"- {f}" for f in fields]
    return "\n".join([task.rstrip(), "Answer with one JSON object and nothing else. Its keys:", *lines,
                      "Write null for whatever the document does not say.", "Document:", ""])


def with_prompt(prompt: str, text) -> Column:
    return F.concat(F.lit(prompt), X._c(text))


# --- X5: model call ------------------------------------------------------------------

_CALL_TYPE = T.StructType([T.StructField("raw", T.StringType()), T.StructField("error", T.StringType())])


def model_udf(model: ModelFn, batch_rows: int = 128):
    """Arrow-batched call of ``model``; a failing batch retries row by row so
    one bad document yields one error row, never a failed job."""
    def request(items: list[str]) -> tuple[list, list]:
        try:
            return list(model(items)), [None] * len(items)
        except Exception as e:  # noqa: BLE001 - isolate the failing rows
            if len(items) == 1:
                return [None], [f"{type(e).__name__}: {e}"]
        parts = [request([p]) for p in items]
        return [r for raw, _ in parts for r in raw], [e for _, err in parts for e in err]

    def call(prompts: pd.Series) -> pd.DataFrame:
        items = prompts.tolist()
        parts = [request(items[i:i + batch_rows]) for i in range(0, len(items), batch_rows)]
        return pd.DataFrame({"raw": [r for raw, _ in parts for r in raw], "error": [e for _, err in parts for e in err]})
    return F.pandas_udf(call, _CALL_TYPE).asNondeterministic()


MODEL_BATCH_ROWS = 128   # rows of one model request (latency-bound calls)


def call_model(df: DataFrame, model: ModelFn, prompt: str, text_col: str = "parsed_text",
               out: str = "_m", stage: bool = True, batch_rows: int = MODEL_BATCH_ROWS) -> DataFrame:
    """Append ``out = struct(raw, error)`` and checkpoint (``stage``).

    A request holds at most ``batch_rows`` prompts whatever the Arrow batch, so a
    slow model blocks little and retries stay cheap."""
    res = df.withColumn(out, model_udf(model, batch_rows)(with_prompt(prompt, F.col(text_col))))
    return materialize(res) if stage else res


# --- X7-X9: decode -------------------------------------------------------------------------

def decode(raw, schema: T.StructType) -> Column:
    """Cut the JSON object out of the answer and decode it into ``schema``
    plus ``_corrupt_record``.

    Spark's JSON readers (``from_json``, ``try_parse_json``) read the first
    JSON value and ignore trailing text, so the greedy cut of two objects
    ``{..} and {..}`` decodes as the first one, exactly as on the reference's
    Spark engine (Q9). A cut that does not start with a valid value yields a
    struct whose ``_corrupt_record`` holds the cut text."""
    with_corrupt = T.StructType(list(schema.fields) + [T.StructField(CORRUPT, T.StringType())])
    cut = X.json_cut(raw)
    valid = F.try_parse_json(cut).isNotNull()
    parsed = F.from_json(cut, with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    bad = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields],
                   cut.alias(CORRUPT))
    return F.when(X._c(raw).isNull(), F.lit(None).cast(with_corrupt)).when(valid, parsed).otherwise(bad)


def decode_status(raw, decoded) -> Column:
    """Three kinds of nothing kept apart (Q10): no answer, no JSON, bad JSON."""
    r = X._c(raw)
    cut = X.json_cut(r)
    return (F.when(r.isNull(), F.lit("no_answer"))
            .when(cut == "", F.lit("no_json"))
            .when(decoded.isNull() | decoded.getField(CORRUPT).isNotNull(), F.lit("bad_json"))
            .otherwise(F.lit("ok")))


def extract(df: DataFrame, model: ModelFn, prompt: str, schema: T.StructType,
            text_col: str = "parsed_text", key: str = "case_ref", out: str = "js") -> DataFrame:
    """bronze -> ``(key, text, out struct, raw, error, status)``; model once."""
    staged = call_model(df.select(key, text_col), model, prompt, text_col)
    js = decode(F.col("_m.raw"), schema)
    return staged.select(key, text_col, js.alias("_js"), F.col("_m.raw").alias("raw"),
                         F.col("_m.error").alias("error")) \
        .select(key, text_col, F.col("_js").dropFields(CORRUPT).alias(out), "raw", "error",
                decode_status(F.col("raw"), F.col("_js")).alias("status"))


def l1_prompt() -> str:
    return build_prompt("Fill in the case form from the message thread below.", R.L1_FIELDS)


def l2_prompt() -> str:
    return build_prompt("Label the message thread below, then describe how it went.",
                        [n for n, _ in R.L2_FIELDS])


# --- X10: evidence-only rule tagger ----------------------------------------------------------

def tag_agencies(text, vocab: Sequence[str] = AGENCIES) -> Column:
    """Agencies named as whole words, in vocabulary order; ``[]`` if none."""
    t = X._c(text)
    return F.array_compact(F.array(*[F.when(t.rlike(rf"\b{re.escape(a)}\b"), F.lit(a)) for a in vocab]))


def tag_flags(text, cues: dict[str, str] = FLAG_CUES) -> Column:
    t = X._c(text)
    return F.array_compact(F.array(*[F.when(t.rlike(p), F.lit(f)) for f, p in cues.items()]))


def tag_status(text) -> Column:
    t = X._c(text)
    out = F.lit(None).cast("string")
    for value, pat in reversed(STATUS_CUES):
        out = F.when(t.rlike(pat), F.lit(value)).otherwise(out)
    return out


def tag_first(text, vocab: Sequence[str]) -> Column:
    """First vocabulary entry (in vocabulary order) the text mentions."""
    t = X._c(text)
    return F.coalesce(*[F.when(t.rlike(rf"\b{re.escape(v)}\b"), F.lit(v)) for v in vocab], F.lit(None).cast("string"))


def rule_l2(text) -> Column:
    """Layer-1 tag struct from text alone (the default enrichment)."""
    country = tag_first(text, COUNTRIES)
    mission = F.element_at(F.create_map(*[F.lit(x) for kv in MISSIONS.items() for x in kv]), country)
    return F.struct(
        country.alias("L1_Country"),
        mission.alias("L1_Mission"),
        X.subject_case_type(text).alias("L1_Case_Type"),
        tag_agencies(text).alias("L1_Agencies"),
        tag_flags(text).alias("L1_Situational_Flags"),
        tag_status(text).alias("L1_Status"),
        *[F.lit(None).cast("string").alias(n) for n, t in R.L2_FIELDS[6:]],
    )


# --- A small offline model used by tests and the stub query ------------------------------------

_REF = re.compile(r"\[(SGCON/[0-9]{4}/[0-9]+)\]")
_SUBJ = re.compile(r"\]\s*(.+?)\s*-\s*(.+?) in (.+)$", re.M)


def offline_model(prompts: list[str]) -> list[str | None]:
    """Deterministic stand-in for a hosted model: answers with chatter around a
    JSON object built from the subject line. Small per-row helper."""
    out = []
    for p in prompts:
        body = p.split("Document:\n", 1)[-1]
        m = _SUBJ.search(body)
        if not m:
            out.append("Sorry, I could not find a case in this text.")
            continue
        ans = {"Case_Type": m.group(1), "Title_Name": m.group(2), "Case_Location": m.group(3).strip(),
               "Case_Status": "Closed" if "case closed" in body.lower() else None}
        out.append("Here is the extraction:\n" + json.dumps(ans) + "\nDone.")
    return out
