"""Threads with known facts, and scoring of the tagger against them.

A thread is written for every order from its own row and line items, so each
fact in it is known. Some facts are left out of the text, and some texts carry
a misleading mention (negated, lower-case, part of a longer word); the scores
show what an evidence-only tagger makes of both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.operators import extract as E
from caseflow.plans.fixtures import CASE_TYPES, line_facts
from caseflow.sources.tables import spread

# --- Y6: truth threads ---------------------------------------------------------------------

# One sentence for each flag.
FLAG_SENTENCES = {
    "scam": "Money was lost to a scam by telephone.",
    "MP/POH escalation": "The file came in escalated by a member's office.",
    "language barrier": "Talks needed an interpreter.",
    "welfare concern": "Neighbours raised a welfare concern.",
}
# Misleading mentions by order key modulo 5: negated, lower-case, part of a word.
DECOYS = {0: "No interpreter was needed.", 1: "An spf sticker was on the bag.", 2: "ICAO rules were quoted."}
# Facts kept in the truth but never written in the text (evidence-only tagging must miss them).
UNSTATED = {"Arrest & Detention": ("agency", "MHA"), "Evacuation": ("flag", "welfare concern")}
RETURNFLAG_AGENCY = {"A": "ICA", "N": "SPF", "R": "MHA"}
OPEN_LINE_AGENCY = "MOH"


def _vocab_order(arr: Column, vocab: Sequence[str]) -> Column:
    return F.filter(F.array(*[F.lit(v) for v in vocab]), lambda v: F.array_contains(arr, v))


def truth_threads(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One thread per order with its ground truth (full and evidenced)."""
    lf = line_facts(lineitem)
    o = spread(orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"))
    j = o.join(lf, o["o_orderkey"] == lf["l_orderkey"], "left")
    codes = F.coalesce(F.col("codes"), F.array().cast("array<string>"))
    rmap = F.create_map(*[F.lit(x) for kv in RETURNFLAG_AGENCY.items() for x in kv])
    raw_ag = F.flatten(F.transform(codes, lambda c: F.array(
        F.element_at(rmap, F.substring(c, 1, 1)),
        F.when(F.substring(c, 2, 1) == "O", F.lit(OPEN_LINE_AGENCY)))))
    agencies = _vocab_order(F.array_compact(raw_ag), E.AGENCIES)
    ctype = F.element_at(F.array(*[F.lit(t) for t in CASE_TYPES]), (F.col("o_orderkey") % 6).cast("int") + 1)
    none = F.array().cast("array<string>")
    fl = F.concat(F.coalesce(F.col("flags"), none),
                  F.when(F.col("o_orderpriority") == "1-URGENT", F.array(F.lit("MP/POH escalation"))).otherwise(none),
                  F.when(ctype == "Scam", F.array(F.lit("scam"))).otherwise(none))   # a scam case is flagged scam
    flags = _vocab_order(fl, E.FLAGS)
    country = F.element_at(F.array(*[F.lit(c) for c in E.COUNTRIES]), (F.col("o_custkey") % 8).cast("int") + 1)
    base = j.select(
        F.concat(F.lit("SGCON/"), F.year("o_orderdate").cast("string"), F.lit("/"),
                 (F.lit(10000) + F.col("o_orderkey")).cast("string")).alias("case_ref"),
        ctype.alias("case_type"), country.alias("country"),
        F.when(F.col("o_orderstatus") == "F", F.lit("closed")).otherwise(F.lit("pending")).alias("status"),
        agencies.alias("agencies"), flags.alias("flags"), "o_orderkey", "o_orderdate", "last_ship")
    unst_ag = F.when(F.col("case_type") == "Arrest & Detention", F.array(F.lit("MHA"))).otherwise(F.array().cast("array<string>"))
    unst_fl = F.when(F.col("case_type") == "Evacuation", F.array(F.lit("welfare concern"))).otherwise(F.array().cast("array<string>"))
    base = base.withColumn("ev_agencies", F.array_except("agencies", unst_ag)) \
               .withColumn("ev_flags", F.array_except("flags", unst_fl))
    name = F.concat(F.lit("Citizen "), F.col("o_orderkey").cast("string"))
    flag_text = F.array_join(F.transform("ev_flags", lambda f: F.element_at(
        F.create_map(*[F.lit(x) for kv in FLAG_SENTENCES.items() for x in kv]), f)), " ")
    text = F.concat_ws("\n",
        F.concat(F.lit("Subject: Re: ["), F.col("case_ref"), F.lit("] "), F.col("case_type"), F.lit(" - "),
                 name, F.lit(" in "), F.col("country")),
        F.concat(F.lit("Date: "), F.date_format("o_orderdate", "dd MMM yyyy"), F.lit(", 08:00")),
        F.concat(name, F.lit(" wrote to the desk from "), F.col("country"), F.lit(".")),
        F.when(F.size("ev_agencies") > 0,
               F.concat(F.lit("Letters went to "), F.array_join("ev_agencies", ", "), F.lit("."))),
        F.when(F.size("ev_flags") > 0, flag_text),
        F.element_at(F.create_map(*[F.lit(x) for kv in DECOYS.items() for x in kv]), (F.col("o_orderkey") % 5).cast("int")),
        F.when(F.col("status") == "closed", F.lit("Case closed.")).otherwise(F.lit("Case pending.")),
        F.when(F.col("last_ship").isNotNull(),
               F.concat(F.lit("Date: "), F.date_format("last_ship", "dd MMM yyyy"), F.lit(", 09:00"))))
    return base.withColumn("parsed_text", text)


def _set_scores(prefix: str, pred: Column, truth: Column, full: Column) -> list[Column]:
    return [F.sum(F.size(F.array_intersect(pred, truth))).alias(f"{prefix}_tp"),
            F.sum(F.size(F.array_except(pred, truth))).alias(f"{prefix}_fp"),
            F.sum(F.size(F.array_except(truth, pred))).alias(f"{prefix}_fn"),
            F.sum(F.size(F.array_except(full, pred))).alias(f"{prefix}_fn_full")]


def truth_scores(threads: DataFrame) -> DataFrame:
    """Tagger output vs truth; set fields scored per element (tp, fp,
    fn against evidenced truth, fn against full truth); scalars by equality."""
    tagged = threads.select(
        "agencies", "flags", "ev_agencies", "ev_flags", "status", "country", "case_type",
        E.tag_agencies("parsed_text").alias("p_agencies"), E.tag_flags("parsed_text").alias("p_flags"),
        E.tag_status("parsed_text").alias("p_status"), E.tag_first("parsed_text", E.COUNTRIES).alias("p_country"),
        F.regexp_extract("parsed_text", r"\[SGCON[^\]]*\]\s*(.+?)\s*-\s", 1).alias("p_type"))
    return tagged.agg(
        F.count(F.lit(1)).alias("n"),
        *_set_scores("agencies", F.col("p_agencies"), F.col("ev_agencies"), F.col("agencies")),
        *_set_scores("flags", F.col("p_flags"), F.col("ev_flags"), F.col("flags")),
        F.count(F.when(F.col("p_status") == F.col("status"), 1)).alias("status_correct"),
        F.count(F.when(F.col("p_country") == F.col("country"), 1)).alias("country_correct"),
        F.count(F.when(F.col("p_type") == F.col("case_type"), 1)).alias("type_correct"),
    )


def write_truth_manifest(threads: DataFrame, path: str) -> None:
    """K6: ground truth per generated case as JSON lines (one file per task)."""
    threads.select("case_ref", "case_type", "country", "status", "agencies", "flags",
                   "ev_agencies", "ev_flags").write.mode("overwrite").json(path)
