"""Benchmark decontamination: a distributed positional inverted index.

Method. The training side is tokenised once into positional postings
``(term_id, doc_id, pos)``, stored by document in the shared folder. Posting
lists that no test phrase consults are pruned before they are stored: the test
vocabulary is broadcast while it has at most ``common.MAX_BROADCAST_ROWS`` terms and
joined by shuffle beyond. Document frequencies come from the index itself. A
test phrase is then answered from its rarest terms: the list of the rarest term,
shifted by the term's offset in the phrase, gives candidate starts; these meet
the shifted lists of the next rarest terms, and what survives is intersected
with the lists of all remaining terms, so a hit is an exact phrase match. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import ascii_lower, bounded, stage

#: A word, after A-Z is lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
END = ""  # end mark: its posting's position is the document's number of words


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``items(item_id, text)`` -> distinct ``(phrase_id, terms, items)``.

    A phrase is ``window`` consecutive words of an item, or all words of an item
    with fewer (but some). Equal phrases of different items are one row;
    ``items`` lists the item ids as strings. Null ids and null or wordless texts
    give none.
    """
    w = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"),
                                                  words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    p = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("terms"))
    p = p.groupBy("terms").agg(F.collect_set("item_id").alias("items"))
    return p.select(F.xxhash64("terms").alias("phrase_id"), "terms", "items")


def build_index(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Positional postings ``(term_id, doc_id, pos)`` of the terms in ``vocabulary(term, term_id)``.

    Words are counted from 0. Term id -1 is the end mark: one row per document,
    its ``pos`` is the number of words. Null doc_ids are not indexed; rows that
    repeat a doc_id are indexed as one document.
    """
    tokens = docs.where("doc_id is not null").select("doc_id", F.posexplode(
        F.concat(words(F.col("text")), F.array(F.lit(END)))).alias("pos", "term"))
    index = tokens.join(bounded(vocabulary), "term")
    return stage(index.select("term_id", "doc_id", "pos"), "postings")


def _terms(p: DataFrame, vocabulary: DataFrame, freq: DataFrame) -> DataFrame:
    """(phrase_id, n, off, term_id, rarity): the phrase's terms, rarity 1 = rarest."""
    t = p.select("phrase_id", F.size("terms").alias("n"), F.posexplode("terms").alias("off", "term"))
    t = t.join(vocabulary, "term").join(freq, "term_id")
    by = Window.partitionBy("phrase_id").orderBy("df", "off")
    return t.select("phrase_id", "n", "off", "term_id", F.row_number().over(by).alias("rarity"))


def phrase_hits(index: DataFrame, p: DataFrame, vocabulary: DataFrame, anchors: int = 2) -> DataFrame:
    """Exact phrase matches ``(doc_id, start, n, phrase_id)``.

    Candidates come from the ``anchors`` rarest terms of each phrase: their
    offset-adjusted lists are intersected first. The survivors then look up
    every remaining term at its own position.
    """
    freq = index.where("term_id <> -1").groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    # a phrase with a term that no document has cannot match
    terms = _terms(p, vocabulary, freq)
    whole = terms.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("known"), F.max("n").alias("n")).where("known = n")
    terms = stage(terms.join(whole.select("phrase_id"), "phrase_id", "left_semi"), "terms")

    rare = terms.where(F.col("rarity") <= anchors)
    shifted = index.join(bounded(rare), "term_id").where("pos >= off").select(
        "phrase_id", "n", "doc_id", (F.col("pos") - F.col("off")).alias("start"),
        F.expr("shiftleft(1L, rarity - 1)").alias("bit"))
    # one bit for each list, so that rows which repeat a document count once
    alive = (shifted.groupBy("phrase_id", "n", "doc_id", "start").agg(F.bit_or("bit").alias("lists"))
             .where(F.bit_count("lists") >= F.least("n", F.lit(anchors))))
    alive = stage(alive.select("phrase_id", "n", "doc_id", "start"), "candidates")

    rest = terms.where(F.col("rarity") > anchors).select("phrase_id", "off", "term_id")
    need = alive.join(rest, "phrase_id").select("phrase_id", "n", "doc_id", "start", "term_id",
                                                (F.col("start") + F.col("off")).alias("pos"))
    # only postings of documents with a candidate are shuffled
    near = index.join(bounded(alive.select("doc_id").distinct()), "doc_id", "left_semi")
    found = need.join(near, ["doc_id", "pos", "term_id"], "left_semi")
    met = found.groupBy("phrase_id", "n", "doc_id", "start").agg(F.count(F.lit(1)).alias("met"))
    met = met.where(F.col("met") + anchors >= F.col("n")).select("phrase_id", "n", "doc_id", "start")
    return met.union(alive.where(F.col("n") <= anchors))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, anchors: int = 2) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_hit``, ``items`` (sorted ids as strings), ``spans``, ``contaminated``.

    A word is hit when it lies inside an occurrence of a phrase (see
    :func:`phrases`); ``spans`` = maximal hit runs ``(start, end)`` in words, end
    excluded. Null or empty texts have no words and no hits. Rows with a null
    doc_id are not compared: 0 words, no hit. Rows that repeat a doc_id are one
    document and get the same figures. An empty benchmark hits nothing.
    """
    names = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "contaminated")]
    p = stage(phrases(items.select("item_id", "text"), window), "phrases")
    terms = p.select(F.explode("terms").alias("term")).distinct()
    vocabulary = stage(terms.select("term", F.xxhash64("term").alias("term_id"))
                       .union(docs.sparkSession.sql(f"select '{END}' as term, -1L as term_id")), "vocabulary")
    index = build_index(docs.select("doc_id", "text"), vocabulary)
    hits = stage(phrase_hits(index, p, vocabulary, anchors), "hits")

    # union of the hit intervals of a document, in order of their starts
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    runs = hits.select("doc_id", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    seen = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("seen", seen).withColumn(
        "run", F.sum(F.when(F.col("start") <= F.col("seen"), 0).otherwise(1)).over(by))
    runs = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("end"))
    spans = runs.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
                                       F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    named = (hits.select("doc_id", "phrase_id").distinct().join(p.select("phrase_id", F.explode("items").alias("item")), "phrase_id")
             .groupBy("doc_id").agg(F.sort_array(F.collect_set("item")).alias("items")))
    sizes = index.where("term_id = -1").groupBy("doc_id").agg(F.max("pos").alias("n_words"))
    facts = sizes.join(spans, "doc_id", "left").join(named, "doc_id", "left").select(
        F.col("doc_id").alias("fact_doc"), "n_words", "n_hit", "items", "spans")
    d = docs.select(*names)
    return d.join(facts, d["doc_id"] == facts["fact_doc"], "left").select(
        *[d[c] for c in names], F.coalesce("n_words", F.lit(0)).cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def proximity(docs: DataFrame, queries: DataFrame, span: int = 20) -> DataFrame:
    """Documents holding all distinct terms of a query within ``span`` consecutive words.

    ``queries(query_id, text)`` -> ``(query_id, doc_id, start, end)``: the first
    shortest such stretch (end excluded). Starts from the list of the query's
    rarest term; the other lists are joined within ``span`` words of it, each
    reduced to one bit mask per candidate window start. Null ids and queries
    without words give no row.
    """
    q = queries.where("query_id is not null").select("query_id", F.array_distinct(words(F.col("text"))).alias("terms"))
    q = q.where(F.size("terms") > 0)
    t = q.select("query_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    vocabulary = stage(t.select("term", F.xxhash64("term").alias("term_id")).distinct(), "vocabulary")
    index = build_index(docs.select("doc_id", "text"), vocabulary).distinct()
    freq = index.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    t = t.join(vocabulary, "term").join(freq, "term_id")
    by = Window.partitionBy("query_id").orderBy("df", "term")
    t = stage(t.select("query_id", "n", "term_id", F.row_number().over(by).alias("rarity")), "terms")
    anchor = index.join(t.where("rarity = 1").select("query_id", "term_id"), "term_id").select("query_id", "doc_id")
    # of documents with the rarest term: what follows each posting within `span` words
    near = index.join(t.select("query_id", "term_id", "rarity"), "term_id").select("query_id", "doc_id", "pos", "rarity")
    near = near.join(anchor.distinct(), ["query_id", "doc_id"], "left_semi")
    order = Window.partitionBy("query_id", "doc_id").orderBy("pos").rangeBetween(0, span - 1)
    ahead = near.select("query_id", "doc_id", "pos", F.collect_list(F.struct("pos", "rarity")).over(order).alias("w"))
    ahead = ahead.join(t.where("rarity = 1").select("query_id", "n"), "query_id")
    firsts = F.transform(F.sequence(F.lit(1), F.col("n")), lambda r: F.array_min(F.transform(
        F.filter("w", lambda x: x["rarity"] == r), lambda x: x["pos"])))
    ahead = ahead.select("query_id", "doc_id", F.col("pos").alias("start"), firsts.alias("f"), "n")
    ahead = ahead.where(F.size(F.filter("f", lambda x: x.isNotNull())) == F.col("n"))
    ahead = ahead.select("query_id", "doc_id", "start", (F.array_max("f") + 1).alias("end"))
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("length"), "start", "end")).alias("b")
    return ahead.groupBy("query_id", "doc_id").agg(best).select("query_id", "doc_id", "b.start", "b.end")
