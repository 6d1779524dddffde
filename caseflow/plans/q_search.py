"""Similarity search queries (V1-V7, X25) over embeddings, chunks and documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X
from caseflow.operators import ivf as IV
from caseflow.operators import search as SE
from caseflow.plans import fixtures as FX
from caseflow.plans import fixtures_sql as S
from caseflow.plans.catalog import register
from caseflow.session import checkpoint_dir
from caseflow.sources.tables import Tables
from caseflow.sources.versioned import VersionedTable

K_CASES = 3       # similar cases per query (reference default)
K_PROCEDURES = 2  # procedures per query (reference default)

_CENTROID_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dims AS (SELECT label, i, avg(v[i]) AS m FROM e, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) r
         GROUP BY label, i),
cent AS (SELECT label, list(m ORDER BY i) AS c FROM dims GROUP BY label),
cq AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS q FROM cent),
hits AS (SELECT qid, rank, item_id, round(score, 6) AS score FROM (
           SELECT cq.label AS qid, e.vec_id AS item_id, list_dot_product(e.v, cq.q) AS score,
                  row_number() OVER (PARTITION BY cq.label ORDER BY list_dot_product(e.v, cq.q) DESC, e.vec_id) AS rank
           FROM cq, e) WHERE rank <= 3)"""


def _label_queries(spark, d):
    emb = Tables(spark, d).embeddings
    q = SE.centroids(emb, "label").select(F.col("label").alias("qid"),
                                          SE.normalize(F.col("centroid")).alias("embedding"))
    return q, emb


def _knn_labels(spark, d):
    q, emb = _label_queries(spark, d)
    return SE.knn(q, emb.select(F.col("vec_id").alias("item_id"), "embedding"), K_CASES), emb


@register("knn_exact", "WITH " + _CENTROID_SQL + "\nSELECT qid, CAST(rank AS INTEGER) AS rank, item_id, score FROM hits",
          ops=("V5",))
def knn_exact(spark, d):
    """Exact top-3 vectors for each label centroid."""
    return _knn_labels(spark, d)[0].select("qid", F.col("rank").cast("int").alias("rank"), "item_id", "score")


@register("evidence_text", "WITH " + _CENTROID_SQL + """
SELECT h.qid, string_agg('**vec_' || CAST(h.item_id AS VARCHAR) || '** (label ' || CAST(e.label AS VARCHAR) || ')',
                         chr(10) || chr(10) ORDER BY h.rank) AS evidence
FROM hits h JOIN embeddings e ON h.item_id = e.vec_id GROUP BY h.qid""", ops=("V7",))
def evidence_text(spark, d):
    """Ranked hits folded into one cited evidence string per query."""
    hits, emb = _knn_labels(spark, d)
    h = hits.join(emb.select(F.col("vec_id").alias("item_id"), "label"), "item_id")
    line = F.concat(F.lit("**vec_"), F.col("item_id").cast("string"), F.lit("** (label "),
                    F.col("label").cast("string"), F.lit(")"))
    return SE.evidence_text(h, line)


def _ivf(spark, d):
    q, emb = _label_queries(spark, d)
    return q, emb, IV.build(emb.select(F.col("vec_id").alias("item_id"), "embedding"))


@register("knn_ivf", "WITH " + _CENTROID_SQL + "\nSELECT qid, CAST(rank AS INTEGER) AS rank, item_id, score FROM hits", ops=("V5",))
def knn_ivf(spark, d):
    """Top-3 vectors for each label centroid from an inverted file, probed until its bounds prove them."""
    q, _, index = _ivf(spark, d)
    return IV.search(index, q, K_CASES).select("qid", F.col("rank").cast("int").alias("rank"), "item_id", "score")


@register("knn_ivf_recall", "SELECT count(DISTINCT label) * 3 AS n_exact, true AS at_least_nine_tenths FROM embeddings", ops=("V5",))
def knn_ivf_recall(spark, d):
    """Recall@3 when half of a cell's reach is counted, against the exact answer, over all label queries."""
    q, emb, index = _ivf(spark, d)
    exact = SE.knn(q, emb.select(F.col("vec_id").alias("item_id"), "embedding"), K_CASES)
    return SE.recall_at_k(IV.search(index, q, K_CASES, share=0.5), exact).select("n_exact", (F.col("recall") >= 0.9).alias("at_least_nine_tenths"))


def _chunks_and_sop(spark, d):
    th = FX.stored_threads(spark, d)
    chunks = th.select(F.col("case_ref").alias("chunk_id"),
                       X.scrub_pii(F.col("parsed_text"), F.col("c_name")).alias("chunk"))
    sop = FX.sop(spark)
    return chunks, sop


@register("knn_ties", "WITH " + _CENTROID_SQL.split("hits AS")[0].rstrip().rstrip(",") + """,
items AS (SELECT vec_id * 50 + j AS item_id, v FROM e, (SELECT unnest(range(50)) AS j))
SELECT qid, CAST(rank AS INTEGER) AS rank, item_id, round(score, 6) AS score FROM (
  SELECT cq.label AS qid, item_id, list_dot_product(v, cq.q) AS score,
         row_number() OVER (PARTITION BY cq.label ORDER BY list_dot_product(v, cq.q) DESC, item_id) AS rank
  FROM cq, items) WHERE rank <= 7""", ops=("V5",))
def knn_ties(spark, d):
    """Top-7 where every vector comes 50 times: ties go to the smaller id, in any block."""
    q, emb = _label_queries(spark, d)
    items = emb.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(49)), lambda j: F.col("vec_id") * 50 + j)).alias("item_id"), "embedding")
    return SE.knn(q, items, 7, item_block=4096).select("qid", F.col("rank").cast("int").alias("rank"), "item_id", "score")


_TOKENS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}]+')"
_BUCKET = "(CAST('0x' || substr(md5({t}), 1, 8) AS BIGINT) % 65536)"


def _scrub_sql(text: str) -> str:
    ids = f"regexp_replace({text}, '[STFG][0-9]{{7}}[A-Z]', '[NRIC]', 'g')"
    return f"CASE WHEN c_name IS NULL OR c_name = '' THEN {ids} ELSE replace({ids}, c_name, '[NAME]') END"


def _tfidf_sql(corpus: str, p: str = "") -> str:
    """CTE ``{p}idf`` fitted on ``corpus`` (one text column)."""
    return f"""{p}corpus(text) AS ({corpus}),
{p}ct AS (SELECT row_number() OVER () AS d, text FROM {p}corpus),
{p}cb AS (SELECT DISTINCT d, {_BUCKET.format(t="t")} AS bucket FROM (SELECT d, unnest({_TOKENS.format(c="text")}) AS t FROM {p}ct)),
{p}idf AS (SELECT bucket, ln(((SELECT count(*) FROM {p}corpus) + 1) / (count(*) + 1)) AS idf FROM {p}cb GROUP BY bucket)"""


def _vectors_sql(name: str, source: str, p: str = "") -> str:
    """CTE ``name(id, bucket, w)`` of quantised unit weights for ``source(id, text)``."""
    return f"""{name}_t AS (SELECT id, {_BUCKET.format(t="t")} AS bucket, count(*) AS tf
  FROM (SELECT id, unnest({_TOKENS.format(c="text")}) AS t FROM ({source})) GROUP BY 1, 2),
{name}_w AS (SELECT id, x.bucket, tf * idf AS w FROM {name}_t x JOIN {p}idf f ON x.bucket = f.bucket),
{name} AS (SELECT id, bucket, round(w / sqrt(s) * 4096) / 4096 AS w
  FROM (SELECT *, sum(w * w) OVER (PARTITION BY id) AS s FROM {name}_w) WHERE s > 0)"""


def _topk_sql(k: int, q_ids: str, i_ids: str, p: str = "") -> str:
    """CTE ``hits(qid, rank, item_id, score)`` of exact top-k over all pairs."""
    return f"""{p}dots AS (SELECT q.id AS qid, i.id AS item_id, sum(q.w * i.w) AS score FROM {p}q q JOIN {p}i i ON q.bucket = i.bucket GROUP BY 1, 2),
{p}hits AS (SELECT qid, rank, item_id, round(score, 6) AS score FROM (
  SELECT a.id AS qid, b.id AS item_id, coalesce(score, 0.0) AS score,
         row_number() OVER (PARTITION BY a.id ORDER BY coalesce(score, 0.0) DESC, b.id) AS rank
  FROM ({q_ids}) a CROSS JOIN ({i_ids}) b LEFT JOIN {p}dots x ON x.qid = a.id AND x.item_id = b.id) WHERE rank <= {k})"""


def search_ctes(corpus: str, queries: str, items: str, k: int, p: str) -> list[str]:
    """CTEs up to ``{p}hits`` for ``queries(id, text)`` against ``items(id, text)``."""
    return [_tfidf_sql(corpus, p), _vectors_sql(f"{p}q", queries, p), _vectors_sql(f"{p}i", items, p),
            _topk_sql(k, f"SELECT id FROM ({queries})", f"SELECT id FROM ({items})", p)]


_CHUNKS = "SELECT case_ref AS id, {} AS text FROM threads"
CASE_CHUNKS_SQL = f"chunks AS ({_CHUNKS.format(_scrub_sql('parsed_text'))})"


@register("embed_tfidf", S.on_threads(
    "SELECT a.id AS chunk_id, coalesce(n, 0) AS n_features, coalesce(l, '') AS features FROM (SELECT id FROM chunks) a LEFT JOIN "
    "(SELECT id, count(*) AS n, string_agg(bucket || ':' || CAST(w * 4096 AS BIGINT), ',' ORDER BY bucket) AS l FROM v GROUP BY id) b ON a.id = b.id",
    CASE_CHUNKS_SQL, _tfidf_sql("SELECT text FROM chunks"), _vectors_sql("v", "SELECT * FROM chunks")),
    ops=("V3",))
def embed_tfidf(spark, d):
    """Offline embedding of every scrubbed case chunk (hashed TF-IDF), entry by entry."""
    chunks, _ = _chunks_and_sop(spark, d)
    e = SE.embed_tfidf(chunks, "chunk", "chunk_id").select("chunk_id", F.arrays_zip("embedding.indices", "embedding.values").alias("v"))
    e = e.withColumn("v", F.filter("v", lambda x: x["indices"].isNotNull()))
    line = F.transform("v", lambda x: F.concat_ws(":", x["indices"].cast("string"), (x["values"] * SE.GRID).cast("long").cast("string")))
    return e.select("chunk_id", F.size("v").cast("long").alias("n_features"), F.array_join(line, ",").alias("features"))


@register("sop_search", S.on_threads(
    "SELECT qid, CAST(rank AS INTEGER) AS rank, item_id, score FROM hits",
    CASE_CHUNKS_SQL, S.sop_values_sql(), _tfidf_sql("SELECT text FROM chunks UNION ALL SELECT chunk FROM sop"),
    _vectors_sql("q", "SELECT * FROM chunks"), _vectors_sql("i", "SELECT chunk_id AS id, chunk AS text FROM sop"),
    _topk_sql(K_PROCEDURES, "SELECT id FROM chunks", "SELECT chunk_id AS id FROM sop")), ops=("V6", "V3"))
def sop_search(spark, d):
    """Top-2 procedures for every case chunk."""
    chunks, sop = _chunks_and_sop(spark, d)
    embed = SE.fit_tfidf(chunks.select("chunk").unionByName(sop.select("chunk")), "chunk")
    qe = embed(chunks, "chunk", "chunk_id")
    ie = embed(sop, "chunk", "chunk_id")
    return SE.knn(qe.withColumnRenamed("chunk_id", "qid"), ie.withColumnRenamed("chunk_id", "item_id"), K_PROCEDURES).select(
        "qid", F.col("rank").cast("int").alias("rank"), "item_id", "score")


_DOC_CHUNKS = ("SELECT doc_id || ':' || pos AS id, substr(text, CAST(pos * 1000 + 1 AS BIGINT), 1000) AS text FROM documents, "
               "LATERAL (SELECT unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS pos)")


@register("similar_documents", "WITH " + f"""chunks AS ({_DOC_CHUNKS}), bench AS (SELECT item_id AS id, text FROM benchmark),
{_tfidf_sql('SELECT text FROM chunks UNION ALL SELECT text FROM bench')}, {_vectors_sql('q', 'SELECT * FROM bench')},
{_vectors_sql('i', 'SELECT * FROM chunks')}, {_topk_sql(K_CASES, 'SELECT id FROM bench', 'SELECT id FROM chunks')}
SELECT qid, CAST(rank AS INTEGER) AS rank, item_id, score FROM hits""", ops=("V5", "V3", "X25"))
def similar_documents(spark, d):
    """Top-3 document chunks for every benchmark passage."""
    t = Tables(spark, d)
    docs = t.documents.select("doc_id", F.posexplode(X.fixed_chunks("text", 1000)).alias("pos", "chunk"))
    docs = docs.select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("pos").cast("string")).alias("item_id"),
                       "chunk")
    bench = t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("chunk"))
    embed = SE.fit_tfidf(docs.select("chunk").unionByName(bench.select("chunk")), "chunk")
    return SE.knn(embed(bench, "chunk", "qid"), embed(docs, "chunk", "item_id"), K_CASES).select(
        "qid", F.col("rank").cast("int").alias("rank"), "item_id", "score")


_DELTA_SQL = r"""
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id,
       CASE WHEN o.h IS NULL THEN 'insert' WHEN n.h IS NULL THEN 'delete'
            WHEN o.h <> n.h THEN 'update' ELSE 'same' END AS action
FROM (SELECT case_ref AS chunk_id, sha256(coalesce({scrub_old}, '')) AS h FROM threads
      WHERE o_orderdate < TIMESTAMP '2001-01-01') o
FULL OUTER JOIN (SELECT case_ref AS chunk_id, sha256(coalesce({scrub_new}, '')) AS h FROM threads
                 WHERE len(coalesce(codes, CAST([] AS VARCHAR[]))) > 0) n
  ON o.chunk_id = n.chunk_id"""


_OLD_TEXT = ("CASE WHEN o_orderstatus = 'O' THEN array_to_string(string_split(parsed_text, chr(10))[1:2], chr(10)) "
             "ELSE parsed_text END")


@register("index_delta", S.on_threads(_DELTA_SQL.format(scrub_old=_scrub_sql(_OLD_TEXT),
                                                        scrub_new=_scrub_sql("parsed_text"))),
          ops=("V4", "V1"))
def index_delta(spark, d):
    """Snapshot diff on (chunk_id, content hash): what an index sync embeds."""
    old, new, _ = _snapshots(spark, d)
    return SE.snapshot_delta(old, new).select("chunk_id", "action")


def _snapshots(spark, d):
    """Three states of the chunk table: open threads cut short and none after 2000; threads with
    line items, whole; those but a seventh, of which a tenth is cut short."""
    th = FX.stored_threads(spark, d)
    short = F.array_join(F.slice(F.split("parsed_text", "\n"), 1, 2), "\n")
    chunk = lambda text: X.scrub_pii(text, F.col("c_name")).alias("chunk")
    some = F.size(F.coalesce("codes", F.array().cast("array<string>"))) > 0
    key, ref = F.col("o_orderkey"), F.col("case_ref").alias("chunk_id")
    return (th.where(F.col("o_orderdate") < F.lit("2001-01-01").cast("timestamp_ntz")).select(
                ref, chunk(F.when(F.col("o_orderstatus") == "O", short).otherwise(F.col("parsed_text")))),
            th.where(some).select(ref, chunk(F.col("parsed_text"))),
            th.where(some & (key % 7 != 0)).select(ref, chunk(F.when(key % 10 == 1, short).otherwise(F.col("parsed_text")))))


_SHORT = "array_to_string(string_split(parsed_text, chr(10))[1:2], chr(10))"
_LINES = "len(coalesce(codes, CAST([] AS VARCHAR[]))) > 0"
_SNAPSHOTS_SQL = f"""s1 AS (SELECT case_ref AS id, {_scrub_sql(_OLD_TEXT)} AS t FROM threads WHERE o_orderdate < TIMESTAMP '2001-01-01'),
s2 AS (SELECT case_ref AS id, {_scrub_sql("parsed_text")} AS t FROM threads WHERE {_LINES}),
s3 AS (SELECT case_ref AS id, {_scrub_sql(f"(CASE WHEN o_orderkey % 10 = 1 THEN {_SHORT} ELSE parsed_text END)")} AS t
       FROM threads WHERE {_LINES} AND o_orderkey % 7 <> 0)"""


@register("index_sync", S.on_threads(f"""
SELECT s3.id AS chunk_id, md5(s3.t) AS chunk_md5,
       (SELECT count(DISTINCT {_BUCKET.format(t="w")}) FROM (SELECT unnest({_TOKENS.format(c="s3.t")}) AS w)) AS n_features,
       CAST(CASE WHEN s2.t IS DISTINCT FROM s3.t THEN 3 WHEN s1.t IS DISTINCT FROM s2.t THEN 2 ELSE 1 END AS BIGINT) AS synced
FROM s3 LEFT JOIN s2 ON s2.id = s3.id LEFT JOIN s1 ON s1.id = s3.id""", _SNAPSHOTS_SQL), ops=("V4", "V1", "V3"))
def index_sync(spark, d):
    """A stored index brought from one state of the chunks to the next, three times: ``synced`` is the commit that
    embedded a chunk, so unchanged chunks keep an earlier one."""
    states = _snapshots(spark, d)
    embed = SE.fit_tfidf(states[0].select("chunk").unionByName(states[1].select("chunk")).unionByName(states[2].select("chunk")), "chunk")
    index = _index(spark)
    for state in states:
        SE.sync_index(index, state, embed)
    return index.read().select("chunk_id", F.md5("chunk").alias("chunk_md5"),
                               F.size("embedding.indices").cast("long").alias("n_features"), "synced")


def _index(spark, buckets=32):
    return VersionedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}", SE.index_schema(SE.SPARSE), ("chunk_id",), buckets)


def _chunk_table(spark, d):
    """The three states as commits 1 to 3 of a versioned table."""
    shape = T.StructType().add("chunk_id", "string").add("chunk", "string")
    table = VersionedTable(spark, f"{checkpoint_dir(spark).rstrip('/')}/chunks-{uuid.uuid4().hex}", shape, ("chunk_id",), 32)
    for state in _snapshots(spark, d):
        table.replace(state)
    return table


_DIFF = """SELECT {n} AS commit, unnest(CASE WHEN a.id IS NULL THEN ['insert'] WHEN b.id IS NULL THEN ['delete'] ELSE ['update_before', 'update_after'] END) AS change,
       coalesce(a.id, b.id) AS chunk_id, a.t AS was, b.t AS now
FROM s{m} a FULL OUTER JOIN s{n} b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.t IS DISTINCT FROM b.t"""


@register("chunk_changes", S.on_threads(f"""
SELECT CAST(commit AS BIGINT) AS commit, change, chunk_id, md5(CASE WHEN change IN ('delete', 'update_before') THEN was ELSE now END) AS chunk_md5
FROM ({_DIFF.format(m=1, n=2)} UNION ALL {_DIFF.format(m=2, n=3)})""", _SNAPSHOTS_SQL), ops=("K5",))
def chunk_changes(spark, d):
    """Change feed of the chunk table between its commits 1 and 3."""
    return _chunk_table(spark, d).changes(1, 3).select("commit", "change", "chunk_id", F.md5("chunk").alias("chunk_md5"))


@register("chunks_as_of", S.on_threads("SELECT id AS chunk_id, md5(t) AS chunk_md5 FROM s2", _SNAPSHOTS_SQL), ops=("K5",))
def chunks_as_of(spark, d):
    """The chunk table as of its second commit, read after the third."""
    return _chunk_table(spark, d).read(2).select("chunk_id", F.md5("chunk").alias("chunk_md5"))
