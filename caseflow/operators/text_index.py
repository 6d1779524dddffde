"""Token search by character n-grams: which files of a stored table can hold a token.

For every run of three characters of the searched text the index has the list of the files it
occurs in. A token can only be in files that all its runs name, so the lists of its rarest runs
are intersected, and the search predicate itself runs on the files that are left: the answer
is that of a full scan. A token shorter than a run, or a text that the index does not know,
prunes nothing. Files that came after the index are always read.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import serving as SV

GRAM = 3
RAREST = 8  # runs of a token whose lists are intersected; the predicate decides the rest


def _grams(batches):
    """``(path, text)`` to the distinct runs of ``GRAM`` characters of each path, within a task."""
    found: dict[str, np.ndarray] = {}

    def rows(path: str) -> pa.RecordBatch:
        code = found.pop(path)
        text = np.column_stack([code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        runs = [text[i:i + GRAM] for i in range(0, len(text), GRAM)]
        return pa.RecordBatch.from_arrays([pa.array([path] * len(runs), pa.string()), pa.array(runs, pa.string())], ["path", "gram"])

    for b in filter(len, batches):
        paths = b.column(0).dictionary_encode()
        of = paths.indices.to_numpy(zero_copy_only=False)
        texts = [t.decode("utf-8", "replace") for t in b.column(1).cast(pa.binary()).to_pylist()]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        c = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the text's end
        at = np.flatnonzero(left >= GRAM)
        runs, path_of = c[at] << 42 | c[at + 1] << 21 | c[at + 2], np.repeat(of, size)[at]
        names = paths.dictionary.to_pylist()
        for i, path in enumerate(names):
            known = found.get(path, np.zeros(0, np.int64))
            found[path] = pd.unique(np.concatenate([known, runs[path_of == i] if len(names) > 1 else runs]))
        yield from map(rows, [p for p in found if p != names[-1]])  # a task reads file after file
    yield from map(rows, [*found])


def build(spark: SparkSession, table: str, folder: str) -> str:
    """Index of the parquet table at ``table``, written to ``folder``: ``files(id, path)`` and ``lists(gram, n_files, ids)``.

    The lists are sorted by run, so a lookup reads the row groups of its runs. A file counts once
    for a run however many rows have it; that is settled within the file's tasks, before the shuffle."""
    df = spark.read.parquet(table)
    at = F.col("_metadata.file_path")
    paths = sorted(r[0] for r in df.select(at.alias("path")).distinct().collect())  # as many as the scan's own listing holds
    spark.createDataFrame(list(enumerate(paths)), "id int, path string").write.parquet(f"{folder}/files")
    found = df.select(at.alias("path"), SV.searched_text(df).alias("text")).mapInArrow(_grams, "path string, gram string").distinct()
    found = found.join(spark.read.parquet(f"{folder}/files"), "path")
    lists = found.groupBy("gram").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # one number a file at most
    lists = lists.select("gram", F.size("ids").alias("n_files"), "ids")
    lists.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/lists")
    return folder


def _plain(path: str) -> str:
    """A path without scheme and escapes: listings and rows write the same file differently."""
    return unquote(re.sub(r"^[a-zA-Z0-9]+:/*", "/", path))


def files_for(spark: SparkSession, folder: str, q: str) -> set[int] | None:
    """Numbers of the indexed files that can match ``q``; None if the index cannot tell."""
    left: set[int] | None = None
    for token in SV.search_tokens(q):
        runs = {token.lower()[i:i + GRAM] for i in range(len(token.lower()) - GRAM + 1)}
        if not runs or SV.BLOB_SEPARATOR in token:
            continue
        lists = spark.read.parquet(f"{folder}/lists").where(F.col("gram").isin(*runs))
        sizes = sorted((r.n_files, r.gram) for r in lists.select("n_files", "gram").collect())  # a row for each run of the token
        if len(sizes) < len(runs):
            return set()
        rarest = [g for _, g in sizes[:RAREST]]
        for r in lists.where(F.col("gram").isin(*rarest)).orderBy("n_files").select("ids").collect():
            left = set(r.ids) if left is None else left & set(r.ids)
        if not left:
            return set()
    return left


def search(spark: SparkSession, table: str, folder: str, cq: SV.CaseQuery) -> DataFrame:
    """Rows of the table that ``cq`` selects, from the files that can hold its tokens."""
    whole = spark.read.parquet(table)
    left = files_for(spark, folder, cq.q) if cq.q else None
    if left is None:
        return SV.filtered(whole, cq)
    indexed = {_plain(r.path): r.id for r in spark.read.parquet(f"{folder}/files").collect()}
    paths = [p for p in whole.inputFiles() if _plain(p) not in indexed or indexed[_plain(p)] in left]
    if not paths:
        return whole.where(F.lit(False))
    some = spark.read.schema(whole.schema).option("basePath", table).parquet(*paths)
    return SV.filtered(some, cq)
