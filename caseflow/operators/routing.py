"""Question routing over tables of questions.

The reference routes one question at a time through a hosted model. Here a
route is a column: a rule router by default, or a pluggable model whose JSON
answer is decoded with the same once-only machinery as extraction (X5).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as X

# The four routes; anything else falls back to ``structured``.
ROUTES = ("structured", "similar", "procedure", "case_lookup")
DEFAULT_ROUTE = "structured"

# A reference as people type it, with or without brackets.
QUESTION_REF = r"\b(SGCON/[0-9]{4}/[0-9]+)"

# Our own cue patterns for the rule router.
PROCEDURE_CUES = r"(?i)\b(procedure|procedures|sop|protocol|steps?)\b"
SIMILAR_CUES = r"(?i)\b(similar|past cases|previous cases|like this)\b"


ROUTE_PROMPT = ("Sort the question below. Answer with one JSON object: route is one of " + ", ".join(ROUTES)
                + "; case_ref is the reference it names, else null.\nQuestion: ")


def rule_route(question) -> Column:
    q = X._c(question)
    return (F.when(q.rlike(QUESTION_REF), F.lit("case_lookup"))
            .when(q.rlike(PROCEDURE_CUES), F.lit("procedure"))
            .when(q.rlike(SIMILAR_CUES), F.lit("similar"))
            .otherwise(F.lit(DEFAULT_ROUTE)))


def model_route(model_json) -> Column:
    """Route from a model answer ``{"route": .., "case_ref": ..}``; missing,
    broken or unknown -> ``structured``."""
    st = F.from_json(X.json_cut(model_json), "route string, case_ref string")
    r = st.getField("route")
    return F.when(r.isin(*ROUTES), r).otherwise(F.lit(DEFAULT_ROUTE))


def question_case_ref(question) -> Column:
    """R2: the case reference a question names, else NULL."""
    return X.blank_to_null(F.regexp_extract(X._c(question), QUESTION_REF, 1))


def route_questions(questions: DataFrame, text_col: str = "question", model=None) -> DataFrame:
    """R1 + R2 as two columns over a question table.

    ``model`` (a batch of prompts in, JSON answers out) replaces the rules: it is
    called once per question, and whatever it does not answer properly is
    ``structured``."""
    if model is None:
        return questions.withColumn("route", rule_route(F.col(text_col))) \
                        .withColumn("case_ref", question_case_ref(F.col(text_col)))
    from caseflow.operators.extract import call_model

    asked = call_model(questions, model, ROUTE_PROMPT, text_col)
    ref = F.from_json(X.json_cut("_m.raw"), "route string, case_ref string").getField("case_ref")
    return asked.withColumn("route", model_route("_m.raw")).withColumn(
        "case_ref", F.coalesce(question_case_ref(F.col(text_col)), question_case_ref(ref))).drop("_m")


def route_mix(chat: DataFrame) -> DataFrame:
    """Messages per stored route (NULL route = not routed)."""
    return chat.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


# Source labels of the evidence per route.
SOURCES = {
    "similar": "Semantic search over case email threads",
    "procedure": "SOP / procedures library",
    "case_lookup": "Case record",
    "structured": "Structured case table",
}


def question_evidence(questions: DataFrame, gold: DataFrame, case_chunks: DataFrame, sop_chunks: DataFrame,
                      *, text_col: str = "question", k_cases: int = 3, k_sops: int = 2) -> DataFrame:
    """Evidence per question by route, ``(qid, route, source, evidence)``.

    Each route is its own distributed plan over its share of the questions,
    and the four results are unioned: lookups join gold by reference (left
    semi, no broadcast of gold), similar/procedure questions go through exact
    k-NN against TF-IDF embeddings fitted on the searched chunks, structured
    questions carry no evidence here (the saved analytic queries answer them).
    """
    from caseflow.operators import search as SE
    from caseflow.operators import serving as SV

    q = route_questions(questions, text_col)
    out = []

    look = q.where(F.col("route") == "case_lookup")
    rec = SV.lookup_many(gold, look.select("case_ref"))
    rec_json = rec.select(F.col("Case_Ref").alias("case_ref"),
                          F.to_json(F.struct(*[F.col(c) for c in rec.columns])).alias("_rec"))
    out.append(look.join(rec_json, "case_ref", "left").select(
        "qid", "route", F.concat(F.lit(SOURCES["case_lookup"] + " "), F.coalesce("case_ref", F.lit("?"))).alias("source"),
        F.coalesce(F.col("_rec"), F.lit("Case not found.")).alias("evidence")))

    def by_search(route: str, items: DataFrame, k: int, line, empty: str):
        qs = q.where(F.col("route") == route).select("qid", F.col(text_col).alias("chunk"))
        embed = SE.fit_tfidf(items.select("chunk"), "chunk")
        hits = SE.knn(embed(qs, "chunk", "qid"), embed(items, "chunk", "chunk_id").withColumnRenamed("chunk_id", "item_id"), k)
        hits = hits.join(items.withColumnRenamed("chunk_id", "item_id"), "item_id")
        ev = SE.evidence_text(hits, line, empty)
        return qs.select("qid").join(ev, "qid", "left").select(
            "qid", F.lit(route).alias("route"), F.lit(SOURCES[route]).alias("source"),
            F.coalesce(F.col("evidence"), F.lit(empty)).alias("evidence"))

    out.append(by_search("similar", case_chunks, k_cases,
                         SE.case_line(F.col("item_id"), F.col("case_type"), F.col("case_location"), F.col("chunk")),
                         "No similar cases found."))
    sop_items = sop_chunks.select("chunk_id", "chunk", "sop_title")
    out.append(by_search("procedure", sop_items, k_sops,
                         F.concat(F.lit("**SOP: "), X.title_words(F.col("sop_title")), F.lit("**\n"),
                                  X.head_chars(F.col("chunk"))),
                         "No matching procedure found."))
    out.append(q.where(F.col("route") == "structured").select(
        "qid", "route", F.lit(SOURCES["structured"]).alias("source"), F.lit(None).cast("string").alias("evidence")))
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o)
    return res
