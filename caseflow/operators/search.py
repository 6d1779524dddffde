"""Chunks, embeddings and similarity search.

k-NN is exact. Both sides are dealt into blocks by a hash of their ids (block
counts follow the row counts), every pair of blocks is one task that returns
exactly k rows per query, and one window merges them (planned with a partial
``WindowGroupLimit`` before the shuffle); a task holds two blocks, and a hot
vector is one row. A side whose counted entries are within ``FEW_ENTRIES`` goes to
every task instead, and the other side stays where it lies: few items answer a
query at once, few queries keep their best of each batch of items.
Ranking is one total order, ``(score desc, item id asc)`` on the unrounded double;
only the output is rounded.

An index for many searches is in :mod:`caseflow.operators.ivf`.
"""

from __future__ import annotations

import math
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions import text as X
from caseflow.session import materialize, shuffles_dropped, stored
from caseflow.sources.versioned import Commit, VersionedTable

SCORE_DIGITS = 6
FEATURES = 1 << 16    # hash buckets of the offline embedder
GRID = 4096           # its weights are multiples of 1 / GRID, so dot products are exact in any order
SPARSE = T.StructType().add("indices", T.ArrayType(T.IntegerType())).add("values", T.ArrayType(T.DoubleType()))


# --- V3: embeddings --------------------------------------------------------------------

def tokens(text) -> Column:
    """Lower-cased runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(X._c(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _bucket(token: Column, features: int) -> Column:
    return (F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("long") % features).cast("int")


def _counts(df: DataFrame, text_col: str, id_col: str, features: int) -> DataFrame:
    """``(id, bucket, tf)``: exploded and combined before the shuffle."""
    return (df.select(F.col(id_col).alias("_id"), F.explode(tokens(text_col)).alias("_t"))
            .groupBy("_id", _bucket(F.col("_t"), features).alias("bucket")).agg(F.count(F.lit(1)).alias("tf")))


def _entries(texts: pa.ListArray, features: int, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of every distinct bucket of a batch of token lists, by row and bucket.

    A token is hashed once a batch, or once a task while ``known`` holds it."""
    flat = texts.flatten().cast(pa.binary()).dictionary_encode()
    if len(known) > 1 << 18:
        known.clear()
    for t in flat.dictionary.to_pylist():
        if t not in known:
            known[t] = int.from_bytes(md5(t).digest()[:4], "big") % features
    bucket = np.array([known[t] for t in flat.dictionary.to_pylist()], np.int64)
    size = pc.fill_null(pc.list_value_length(texts), 0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    key, tf = np.unique(row * features + bucket[flat.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    return key // features, key % features, tf


def _document_counts(features: int):
    """Texts of a task that hold each bucket; bucket -1 counts its texts."""
    def run(batches):
        df, n, known = np.zeros(features, np.int64), 0, {}
        for b in batches:
            df += np.bincount(_entries(b.column(0), features, known)[1], minlength=features)
            n += b.num_rows
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *found], pa.int32()), pa.array([n, *df[found]], pa.int64())], ["bucket", "df"])
    return run


def _embed_texts(features: int, fitted: Broadcast, id_col: str):
    """Token lists to unit vectors, a row each; a row without an id gets an empty one."""
    def run(batches):
        idf, known = fitted.value, {}
        for b in batches:
            row, bucket, tf = _entries(b.column(1), features, known)
            here = b.column(0).is_valid().to_numpy(zero_copy_only=False)[row] & ~np.isnan(idf[bucket])
            row, bucket, w = row[here], bucket[here], tf[here] * idf[bucket[here]]
            norm = np.sqrt(np.bincount(row, w * w, b.num_rows))[row]  # summed in bucket order, as written
            x = np.abs(np.divide(w, norm, out=np.zeros_like(w), where=norm > 0) * GRID)
            value = np.copysign(np.floor(x) + (x - np.floor(x) >= 0.5), w) / GRID + 0.0  # halves away from zero
            at = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((bucket, pa.int32()), (value, pa.float64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.StructArray.from_arrays(lists, ["indices", "values"])], [id_col, "embedding"])
    return run


def fit_tfidf(corpus: DataFrame, text_col: str, num_features: int = FEATURES):
    """Offline default embedder, fitted once: hashed term counts x IDF, L2-normalised.

    The fitted table (at most ``num_features`` rows) is materialised in the
    shared folder. Returns ``embed(df, text_col, id_col)`` giving ``(id, embedding)``
    with a sparse ``struct<indices, values>``; a text without tokens has an empty
    one. Texts are embedded row by row where they lie; only the texts of an id that
    comes more than once are brought together, since they share one vector of all their
    tokens. A hosted model plugs in as a pandas UDF returning ``array<float>``."""
    spark = corpus.sparkSession
    parts = corpus.select(tokens(text_col).alias("t")).mapInArrow(_document_counts(num_features), "bucket int, df bigint")
    df = materialize(parts.groupBy("bucket").agg(F.sum("df").alias("df")))
    n = df.where("bucket = -1").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    idf = materialize(df.where("bucket >= 0").select("bucket", F.log((F.lit(n) + 1) / (F.col("df") + 1)).alias("idf")))
    weights = np.full(num_features, np.nan)
    for r in idf.collect():  # num_features rows at most
        weights[r.bucket] = r.idf
    fitted = spark.sparkContext.broadcast(weights)

    def together(frame: DataFrame, col: str, id_col: str) -> DataFrame:
        w = _counts(frame, col, id_col, num_features).join(F.broadcast(idf), "bucket")
        w = w.select("_id", "bucket", (F.col("tf") * F.col("idf")).alias("w"))
        vec = w.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "w"))).alias("_v"))
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
        value = lambda x: F.round(x["w"] / norm * GRID) / GRID
        vec = vec.select("_id", F.struct(F.transform("_v", lambda x: x["bucket"]).alias("indices"),
                                         F.transform("_v", lambda x: F.when(norm > 0, value(x)).otherwise(0.0)).alias("values")).alias("embedding"))
        none = F.expr("named_struct('indices', cast(array() as array<int>), 'values', cast(array() as array<double>))")
        return frame.select(id_col).join(vec, F.col(id_col) == F.col("_id"), "left").select(
            id_col, F.coalesce("embedding", none).alias("embedding"))

    def embed(frame: DataFrame, col: str, id_col: str) -> DataFrame:
        frame = frame.select(id_col, col)
        shape = T.StructType([T.StructField(id_col, frame.schema[id_col].dataType), T.StructField("embedding", SPARSE)])
        apart = lambda f: f.select(id_col, tokens(col).alias("t")).mapInArrow(_embed_texts(num_features, fitted, id_col), shape)
        repeated = frame.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("n"))
        repeated = materialize(repeated.where("n > 1").select("_again"))
        if repeated.isEmpty():
            return apart(frame)
        again = F.col(id_col) == F.col("_again")
        return apart(frame.join(repeated, again, "left_anti")).unionByName(
            together(frame.join(repeated, again, "left_semi"), col, id_col))
    return embed


def embed_tfidf(df: DataFrame, text_col: str, id_col: str, num_features: int = FEATURES,
                fit_on: DataFrame | None = None) -> DataFrame:
    """Fit on ``fit_on`` (default ``df``) and embed ``df``."""
    corpus = fit_on if fit_on is not None else df
    return fit_tfidf(corpus, text_col, num_features)(df, text_col, id_col)


def normalize(vec: Column) -> Column:
    """L2-normalise an array column (zero vector stays zero)."""
    d = vec.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(d, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def centroids(df: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group: exploded ``(group, pos)`` averages (partial
    aggregation, then a small shuffle), re-assembled in position order."""
    ex = df.select(group_col, F.posexplode(F.col(vec_col).cast("array<double>")).alias("pos", "x"))
    dims = ex.groupBy(group_col, "pos").agg(F.avg("x").alias("m"))
    return (dims.groupBy(group_col)
            .agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("_pm"))
            .select(group_col, F.transform("_pm", lambda s: s.getField("m")).alias("centroid")))


# --- V5 / V6: k-NN -------------------------------------------------------------------------

QUERY_BLOCK, ITEM_BLOCK = 4096, 16_384   # rows of a side in one task
FEW_ENTRIES = 1 << 20                     # vector entries of an item side that every task may hold (16 MB)
SCORES = 1 << 22                          # scores, or pairs of entries behind them, held at once in a task
SMALL = 64                                # items whose scores are sorted whole


def _dense_scores(q: pd.DataFrame, it: pd.DataFrame):
    """Score function over query rows, and the exact scores of chosen items.

    Matrix products may differ in the last bits with the shape of a block, so
    they only choose candidates; a row's own sum does not depend on its block."""
    a, b = (np.vstack(x["v"].to_numpy()).astype(np.float64) for x in (q, it))
    return (lambda lo, hi: a[lo:hi] @ b.T), (lambda i, idx: (b[idx] * a[i]).sum(axis=1)), 1e-9


def _sparse_scores(q: pd.DataFrame, it: pd.DataFrame):
    """The same for sparse vectors: entries of both sides meet on their index."""
    size = it["indices"].map(len).to_numpy()
    dims, row, val = np.concatenate([*it["indices"], []]).astype(np.int64), np.repeat(np.arange(len(it)), size), np.concatenate([*it["values"], []])
    order = np.argsort(dims, kind="stable")
    dims, row, val = dims[order], row[order], val[order]

    def scores(lo: int, hi: int) -> np.ndarray:
        part = q.iloc[lo:hi]
        d = np.concatenate([*part["indices"], []]).astype(np.int64)
        w, i = np.concatenate([*part["values"], []]), np.repeat(np.arange(hi - lo), part["indices"].map(len).to_numpy())
        first = np.searchsorted(dims, d)
        n = np.searchsorted(dims, d, "right") - first
        out, met = np.zeros((hi - lo) * len(it)), np.cumsum(n)
        cuts = np.unique(np.searchsorted(met, np.arange(SCORES, met[-1] if len(n) else 0, SCORES)))
        for x, y in zip([0, *cuts], [*cuts, len(n)], strict=True):  # about SCORES pairs of entries at a time
            m = n[x:y]
            at = np.repeat(first[x:y] - np.cumsum(m) + m, m) + np.arange(m.sum())
            np.add.at(out, np.repeat(i[x:y], m) * len(it) + row[at], np.repeat(w[x:y], m) * val[at])
        return out.reshape(hi - lo, len(it))

    return scores, None, 0.0


def _block_topk(k: int, sparse: bool):
    """One query block against one item block: exactly ``min(k, items)`` rows per query."""
    def run(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(it):
            return pd.DataFrame({"qid": q["qid"][:0], "item_id": it["item_id"][:0], "score": np.zeros(0)})
        it = it.sort_values("item_id", kind="stable", ignore_index=True)   # stable sorts then break ties by id
        scores, exact, band = (_sparse_scores if sparse else _dense_scores)(q, it)
        kk, step, rows, items, values = min(k, len(it)), max(1, SCORES // len(it)), [], [], []
        for lo in range(0, len(q), step):
            s = scores(lo, min(lo + step, len(q)))
            if not exact and len(it) <= SMALL:
                best = np.argsort(-s, axis=1, kind="stable")[:, :kk]
                rows.append(np.repeat(np.arange(lo, lo + len(s)), kk))
                items.append(best.ravel())
                values.append(np.take_along_axis(s, best, 1).ravel())
                continue
            cut = np.partition(s, len(it) - kk, axis=1)[:, len(it) - kk] - band
            for i, c in enumerate(cut):
                idx = np.flatnonzero(s[i] >= c)
                sc = exact(lo + i, idx) if exact else s[i, idx]
                best = np.argsort(-sc, kind="stable")[:kk]
                rows.append(np.full(kk, lo + i))
                items.append(idx[best])
                values.append(sc[best])
        return pd.DataFrame({"qid": q["qid"].to_numpy()[np.concatenate(rows)], "item_id": it["item_id"].to_numpy()[np.concatenate(items)],
                             "score": np.concatenate(values)})
    return run


def _scan_topk(k: int, sparse: bool, items: pd.DataFrame):
    """Query batches against a whole item side, ranked."""
    def run(batches):
        for q in batches:
            hits = _block_topk(k, sparse)(q, items)
            yield hits.assign(rank=np.tile(np.arange(1, min(k, len(items)) + 1, dtype=np.int32), len(q)))
    return run


def _scan_items(k: int, sparse: bool, queries: pd.DataFrame):
    """A whole query side against item batches: the best ``k`` of each batch for every query."""
    def run(batches):
        for it in batches:
            yield _block_topk(k, sparse)(queries, it)
    return run


def _merge_topk(cands: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("item_id").asc())
    return (cands.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("qid", "rank", "item_id", F.round("score", SCORE_DIGITS).alias("score")))


def knn(queries: DataFrame, items: DataFrame, k: int, *, q_id: str = "qid", i_id: str = "item_id",
        vec_col: str = "embedding", query_block: int = QUERY_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """Exact top-``k`` items per query by dot product (cosine on unit vectors).

    Vectors are arrays or sparse ``struct<indices, values>``. Returns
    ``(qid, rank, item_id, score)``; ties order by item id. Block sizes only set
    how the work is cut, never the answer."""
    sparse = queries.schema[vec_col].dataType.typeName() == "struct"
    vec = ([F.col(vec_col)["indices"].alias("indices"), F.col(vec_col)["values"].alias("values")] if sparse
           else [F.col(vec_col).cast("array<double>").alias("v")])
    q = queries.select(F.col(q_id).alias("qid"), *vec)
    it = items.select(F.col(i_id).alias("item_id"), *vec)
    kinds = f"qid {q.schema['qid'].dataType.simpleString()}, item_id {it.schema['item_id'].dataType.simpleString()}, score double"
    size = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.size("indices" if sparse else "v"))).first()
    few = lambda df, n: 0 < len(df.select(F.lit(1)).take(n + 1)) <= n
    if few(it, item_block):
        it = materialize(it)
        if size(it)[1] <= FEW_ENTRIES:  # all items fit a task: no query leaves its partition
            hits = q.mapInPandas(_scan_topk(k, sparse, it.toPandas()), f"{kinds}, rank int")
            return hits.select("qid", "rank", "item_id", F.round("score", SCORE_DIGITS).alias("score"))
    if few(q, query_block):
        q = materialize(q)
        if size(q)[1] <= FEW_ENTRIES:  # all queries fit a task: no item leaves its partition
            return _merge_topk(it.mapInPandas(_scan_items(k, sparse, q.toPandas()), kinds), k)
    it = materialize(it)  # counted, then dealt out: embedded once
    n_items = it.count()
    q = materialize(q)
    n_q, n_i = (max(1, math.ceil(x / n)) for x, n in ((q.count(), query_block), (n_items, item_block)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(n_q)).cast("int")).withColumn("ib", every(n_i))
    it = it.withColumn("ib", F.pmod(F.xxhash64("item_id"), F.lit(n_i)).cast("int")).withColumn("qb", every(n_q))
    cands = q.groupBy("qb", "ib").cogroup(it.groupBy("qb", "ib")).applyInPandas(_block_topk(k, sparse), kinds)
    return _merge_topk(cands, k)


# --- recall

def recall_at_k(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of exact neighbours the approximate result found."""
    hit = exact.join(approx.select("qid", "item_id", F.lit(1).alias("_h")), ["qid", "item_id"], "left")
    return hit.agg(F.count(F.lit(1)).alias("n_exact"), F.count("_h").alias("n_found"),
                   F.round(F.count("_h") / F.count(F.lit(1)), 4).alias("recall"))


# --- V7: evidence text ------------------------------------------------------------------------

def evidence_text(hits: DataFrame, line: Column, empty: str = "No similar cases found.") -> DataFrame:
    """Per query: ranked lines joined by a blank line (k rows per query, so
    the per-group list is bounded by k)."""
    grouped = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
                                      .alias("_l"))
    txt = F.concat_ws("\n\n", F.transform("_l", lambda s: s.getField("line")))
    return grouped.select("qid", F.when(F.size("_l") > 0, txt).otherwise(F.lit(empty)).alias("evidence"))


def case_line(ref: Column, ctype: Column, loc: Column, chunk: Column) -> Column:
    """``**ref** (type, location)`` newline preview."""
    return F.concat(F.lit("**"), ref, F.lit("** ("), F.coalesce(ctype, F.lit("None")), F.lit(", "),
                    F.coalesce(loc, F.lit("None")), F.lit(")\n"), X.case_preview(chunk))


# --- V4: incremental index sync ---------------------------------------------------------------

def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def snapshot_delta(old: DataFrame, new: DataFrame, key: str = "chunk_id", text: str = "chunk") -> DataFrame:
    """Full outer join of two snapshots on ``key`` and content hash:
    ``(key, action, chunk)`` with action insert/update/delete/same."""
    o = old.select(F.col(key).alias("_k"), content_hash(F.col(text)).alias("_oh"))
    n = new.select(F.col(key).alias("_k"), content_hash(F.col(text)).alias("_nh"), F.col(text).alias("_nt"))
    j = o.join(n, "_k", "full_outer")
    action = (F.when(F.col("_oh").isNull(), F.lit("insert")).when(F.col("_nh").isNull(), F.lit("delete"))
              .when(F.col("_oh") != F.col("_nh"), F.lit("update")).otherwise(F.lit("same")))
    return j.select(F.col("_k").alias(key), action.alias("action"), F.col("_nt").alias(text))


#: A stored index: one row a chunk; ``synced`` is the commit that embedded it.
def index_schema(embedding: T.DataType) -> T.StructType:
    return (T.StructType().add("chunk_id", "string").add("chunk", "string").add("hash", "string")
            .add("embedding", embedding).add("synced", "long"))


def sync_index(index: VersionedTable, new: DataFrame, embed) -> Commit:
    """Brings a stored index to the chunks ``new(chunk_id, chunk)``; returns its commit, whose counts say how
    many chunks were embedded (inserts and updates), dropped, and how many buckets rewritten.

    Ids and content hashes of both sides (two columns of the index) decide what changed; only those
    chunks are embedded, by ``embed(df, "chunk", "chunk_id")``, and only their buckets are read whole.
    What changed and its vectors are stored apart, once, and meet where they are merged."""
    spark = index.spark
    was = index.read().select("chunk_id", F.unhex("hash").alias("_was"))
    both = was.join(new.select("chunk_id", "chunk", F.lit(True).alias("_now")), "chunk_id", "full_outer")
    now = F.when(F.col("_now"), F.unhex(content_hash(F.col("chunk"))))
    delta = both.where(~F.col("_was").eqNullSafe(now)).select("chunk_id", "chunk", F.col("_now").isNull().alias("gone"))
    with shuffles_dropped(spark), stored(delta) as delta:
        changed = delta.where("NOT gone")
        with stored(embed(changed.select("chunk_id", "chunk"), "chunk", "chunk_id")) as vectors:
            number = index.commit().number + 1
            rows = changed.join(vectors, "chunk_id").withColumns({"hash": content_hash(F.col("chunk")), "synced": F.lit(number).cast("long")})
            lost = delta.where("gone").select("chunk_id", "gone")
            return index.merge(rows.unionByName(lost, allowMissingColumns=True), deleted="gone", again=True)
