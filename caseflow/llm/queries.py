"""The registered queries of the subpackage: name -> builder, name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm import anchors, decontam, langid, line_dedup, metric_join, minhash_forest, packing, prefix_trie, resampling, sharding, string_kernel, style_tree, tokens
from caseflow.llm.common import table
from caseflow.llm.oracles import OP11_SQL, OP12_SQL, OP13_SQL


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every whole text."""
    return tokens.token_counts(table(spark, d, "documents").select("doc_id", "text"))


def op2_decontamination(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark words found in documents: 10-word phrases by positional index."""
    r = decontam.decontaminate(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return r.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines found in several documents stay in the smallest doc_id."""
    r = line_dedup.line_dedup(table(spark, d, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))


def op5_minhash_forest(spark: SparkSession, d: str) -> DataFrame:
    """Near-duplicate components at Jaccard 0.8 on 4-word shingles."""
    return minhash_forest.near_duplicates(table(spark, d, "documents").select("doc_id", "text"), words=4)


def op6_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Words of 13-word passages that a smaller doc_id also has are removed."""
    r = anchors.substring_dedup(table(spark, d, "documents").select("doc_id", "text"))
    return r.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_metric_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Vectors linked at cosine 0.95."""
    return metric_join.near_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"))


def op7_html_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Main text of every page."""
    r = style_tree.main_text(table(spark, d, "pages").select("page_id", "url", "html"))
    return r.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every text, learned from three folds of four."""
    docs = table(spark, d, "documents").select("doc_id", "text").withColumn(
        "held_out", langid.held_out(F.col("doc_id"), 2, 4))
    model = string_kernel.train(docs.where("not held_out"), table(spark, d, "labels"))
    return string_kernel.toxicity(docs, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    """Language of every text, learned from two folds of three."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").withColumn(
        "held_out", langid.held_out(F.col("doc_id"), 1, 3))
    model = langid.train(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_prefix_trie(spark: SparkSession, d: str) -> DataFrame:
    """Every prefix of the rebuilt conversations with members, children, leaves and savings."""
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(table(spark, d, "conversations"))))


def op12_importance_resampling(spark: SparkSession, d: str) -> DataFrame:
    """Five documents in a hundred drawn towards the benchmark's words, with exact ranks."""
    r = resampling.resample(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "benchmark"))
    return r.select("doc_id", "n_features", "weight", "score", "rank")


def op13_sharding(spark: SparkSession, d: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes, equal texts together."""
    return sharding.shard_documents(table(spark, d, "documents").select("doc_id", "text"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
ph AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS p, least(len(w), 10) AS n
       FROM iw, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s) WHERE len(w) > 0),
st AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM dw),
sizes AS (SELECT DISTINCT n FROM ph),
win AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS p FROM st, sizes WHERE s + n - 1 <= len(w)),
hit AS (SELECT doc_id, s, win.n AS n, item_id FROM win JOIN ph ON win.p = ph.p AND win.n = ph.n),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos ON dw.doc_id = pos.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""

OP3_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT doc_id, line, pos, {_LOWER.format(f"trim(line, {_BLANKS})")} AS key FROM l),
f AS (SELECT key, min(doc_id) AS holder FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, line, pos, f.key IS NOT NULL AND k.doc_id > holder AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
OP5_SQL = f"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 3], ' ') AS g
       FROM dw, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 3) + 1)) AS s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT u AS id, u AS m FROM e UNION SELECT e.v, r.m FROM r JOIN e ON r.id = e.u),
c AS (SELECT id, min(m) AS m FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id,
       coalesce(c.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.id = d.doc_id
"""
OP6_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS g
      FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS s) WHERE len(w) >= 13),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS p FROM g JOIN m ON g.g = m.g WHERE doc_id > m),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, count(*) FILTER (r.p IS NOT NULL) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (r.p IS NULL) AS kept
      FROM x LEFT JOIN r ON x.doc_id = r.doc_id AND x.p = r.p GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT u AS id, u AS m FROM l UNION SELECT l.v, r.m FROM r JOIN l ON r.id = l.u),
c AS (SELECT id, min(m) AS m FROM r GROUP BY id),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.m, v.vec_id) AS component_id,
       coalesce(c.m, v.vec_id) = v.vec_id AS kept
FROM v LEFT JOIN n ON n.u = v.vec_id LEFT JOIN c ON c.id = v.vec_id
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_decontamination": op2_decontamination,
    "op3_line_dedup": op3_line_dedup,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_minhash_forest": op5_minhash_forest,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_language_id": op9_language_id,
    "op10_metric_range_join": op10_metric_range_join,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_sharding": op13_sharding,
}

SQL = {
    "op2_decontamination": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op5_minhash_forest": OP5_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_metric_range_join": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_importance_resampling": OP12_SQL,
    "op13_sharding": OP13_SQL,
}
