"""Nearest neighbours by an inverted file with product quantisation, exact where asked (V5).

An index puts every vector into the cell of its nearest centre and keeps, beside the vector, a
code of one byte for each of ``parts`` stretches of its residual and the length of what the
code leaves out. Centres and code books are fitted on a bounded sample; all vectors are indexed.

Search is by dot product. A cell's block scores its queries on codes, takes true scores of the
best, and then of every vector whose code score plus its remainder could still reach the k-th:
inside the cells it looks at, it is exact. How far a cell reaches from its centre bounds what
any of its vectors can score, so a search goes on to every cell whose bound reaches the k-th
score found, and no other: the answer is then that of a full scan. Counting only a share of that
reach (``share`` below 1) looks at fewer cells and may miss neighbours. Cells are cut into blocks of items, so a full cell is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.search import ITEM_BLOCK, _merge_topk
from caseflow.session import materialize

SAMPLE = 65_536        # vectors that centres and code books are fitted on
CODES = 256            # entries of a code book
SLACK = 1e-9           # bounds are compared with this much room for rounding
SPARE = 8              # best codes, times k, whose true scores set the first threshold


def _centres(x: np.ndarray, n: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced rows; an empty centre keeps its place."""
    c = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Index of the nearest row of ``c`` for each row of ``x``, some rows at a time."""
    half, step = (c * c).sum(axis=1) / 2, max(1, (1 << 22) // max(1, len(c)))
    return np.concatenate([np.argmax(x[i:i + step] @ c.T - half, axis=1) for i in range(0, len(x), step)] or [np.zeros(0, int)])


@dataclass(frozen=True)
class Books:
    """Centres of cells, and a code book for each stretch of a residual."""

    centres: np.ndarray
    codes: list[np.ndarray]

    def stretches(self) -> list[slice]:
        ends = np.cumsum([b.shape[1] for b in self.codes])
        return [slice(e - b.shape[1], e) for e, b in zip(ends, self.codes, strict=True)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, code, length of what the code leaves out, distance from the centre) of each row."""
        cell = _nearest(x, self.centres)
        rest = x - self.centres[cell]
        far, code = np.sqrt((rest * rest).sum(axis=1)), np.empty((len(x), len(self.codes)), np.uint8)
        for j, (s, book) in enumerate(zip(self.stretches(), self.codes, strict=True)):
            code[:, j] = _nearest(rest[:, s], book)
            rest[:, s] -= book[code[:, j]]
        return cell, code, np.sqrt((rest * rest).sum(axis=1)), far


def fit(items: DataFrame, cells: int, parts: int, sample: int = SAMPLE) -> Books:
    """Books from the ``sample`` vectors whose ids hash lowest."""
    rows = items.select(F.col("v")).orderBy(F.xxhash64("item_id"), "item_id").limit(sample).toPandas()
    x = np.vstack(rows["v"].to_numpy()).astype(np.float64)
    centres = _centres(x, cells)
    rest = x - centres[_nearest(x, centres)]
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    return Books(centres, [_centres(rest[:, a:b], CODES) for a, b in zip(edges, edges[1:], strict=False)])


@dataclass(frozen=True)
class Index:
    """``rows(item_id, cell, block, v, code, left)``; ``cells`` holds each cell's reach and number of blocks."""

    books: Books
    rows: DataFrame
    reach: np.ndarray
    blocks: np.ndarray


def build(items: DataFrame, cells: int | None = None, parts: int = 16, item_block: int = ITEM_BLOCK) -> Index:
    """Index of ``items(item_id, embedding)``; null vectors are left out. ``cells`` defaults to the square root of the rows."""
    items = items.where("embedding IS NOT NULL").select("item_id", F.col("embedding").cast("array<double>").alias("v"))
    n = items.count()
    if not n:
        raise ValueError("no vectors to index")
    books = fit(items, cells or max(1, round(n ** 0.5)), parts)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, code, left, far = books.encode(np.vstack(b["v"].to_numpy()))
                yield b.assign(cell=cell.astype(np.int32), code=[c.tobytes() for c in code], left=left, far=far)

    kind = items.schema["item_id"].dataType.simpleString()
    rows = materialize(items.mapInPandas(encode, f"item_id {kind}, v array<double>, cell int, code binary, left double, far double"))
    size = {r[0]: (r[1], r[2]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)), F.max("far")).collect()}  # a row for each centre
    reach = np.array([size.get(c, (0, 0.0))[1] for c in range(len(books.centres))])
    blocks = np.array([-(-size.get(c, (0, 0.0))[0] // item_block) for c in range(len(books.centres))])
    block = F.pmod(F.xxhash64("item_id"), F.greatest(F.lit(1), F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("cell") + 1)))
    return Index(books, rows.withColumn("block", block.cast("int")), reach, blocks)


def _search_block(books: Books, k: int):
    stretches = books.stretches()

    def run(q: pd.DataFrame, it: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(it):
            return pd.DataFrame({"qid": q["qid"][:0], "item_id": it["item_id"][:0], "score": np.zeros(0)})
        it = it.sort_values("item_id", kind="stable", ignore_index=True)
        v, left = np.vstack(it["v"].to_numpy()), it["left"].to_numpy()
        code = np.frombuffer(b"".join(it["code"]), np.uint8).reshape(len(it), -1)
        centre, qids, items, scores, few = books.centres[it["cell"].iloc[0]], [], [], [], min(k, len(it))
        for qid, a in zip(q["qid"], q["v"], strict=True):
            a = np.asarray(a, np.float64)
            about = np.full(len(it), a @ centre)
            for j, s in enumerate(stretches):
                about += (books.codes[j] @ a[s])[code[:, j]]
            most = about + np.sqrt(a @ a) * left + SLACK
            best = np.argpartition(-about, min(SPARE * few, len(it)) - 1)[:SPARE * few]
            true = np.sort((v[best] * a).sum(axis=1))[-few]
            idx = np.flatnonzero(most >= true)  # all that can be among the k best of this block
            sc = (v[idx] * a).sum(axis=1)
            top = np.argsort(-sc, kind="stable")[:few]
            qids += [qid] * few
            items.append(idx[top])
            scores.append(sc[top])
        return pd.DataFrame({"qid": qids, "item_id": it["item_id"].to_numpy()[np.concatenate(items)], "score": np.concatenate(scores)})
    return run


def _probe(index: Index, probes: DataFrame, k: int) -> DataFrame:
    """Top ``k`` of every query ``(qid, v, cell)`` in every cell it looks at."""
    blocks = F.element_at(F.array(*[F.lit(int(b)) for b in index.blocks]), F.col("cell") + 1)
    p = probes.where(blocks > 0).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    kinds = f"qid {p.schema['qid'].dataType.simpleString()}, item_id {index.rows.schema['item_id'].dataType.simpleString()}, score double"
    return p.groupBy("cell", "block").cogroup(index.rows.groupBy("cell", "block")).applyInPandas(_search_block(index.books, k), kinds)


def search(index: Index, queries: DataFrame, k: int, probes: int = 8, share: float = 1.0) -> DataFrame:
    """Top ``k`` items of each ``queries(qid, embedding)``: ``(qid, rank, item_id, score)``, ties by item id.

    The ``probes`` cells with the best bounds are looked at first, then all others whose bound reaches the
    k-th score of these. ``share`` 1 is exact; less counts so much of a cell's reach. Null queries are left out."""
    q = materialize(queries.where("embedding IS NOT NULL").select("qid", F.col("embedding").cast("array<double>").alias("v")))
    centres, reach, some = index.books.centres, index.reach, index.blocks > 0
    kind = q.schema["qid"].dataType.simpleString()

    def cells(choose, share=1.0):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                a = np.vstack(b["v"].to_numpy())
                bound = np.where(some, a @ centres.T + np.sqrt((a * a).sum(axis=1))[:, None] * reach + SLACK, -np.inf)
                order = np.argsort(-bound, axis=1, kind="stable")
                if share < 1:  # the first cells stay those of the whole reach
                    bound -= (1 - share) * np.sqrt((a * a).sum(axis=1))[:, None] * reach
                row, place = np.nonzero(choose(b, np.take_along_axis(bound, order, 1)))
                yield pd.DataFrame({"qid": b["qid"].to_numpy()[row], "v": b["v"].to_numpy()[row], "cell": order[row, place].astype(np.int32)})
        return run

    first = q.mapInPandas(cells(lambda b, x: (np.arange(x.shape[1]) < probes) & np.isfinite(x)), f"qid {kind}, v array<double>, cell int")
    found = materialize(_probe(index, first, k))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc())
    least = found.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == k).select("qid", F.col("score").alias("least"))
    rest = q.join(least, "qid", "left").select("qid", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))

    def more(b: pd.DataFrame, x: np.ndarray) -> np.ndarray:
        return (np.arange(x.shape[1]) >= probes) & np.isfinite(x) & (x >= b["least"].to_numpy()[:, None])

    found = found.union(_probe(index, rest.mapInPandas(cells(more, share), f"qid {kind}, v array<double>, cell int"), k))
    return _merge_topk(found, k)
