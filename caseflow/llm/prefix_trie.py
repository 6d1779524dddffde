"""Prefix trie of conversations by ternary search trees over range shards.

Method. Turns (role and text) are dictionary-encoded: equal turns get one dense number, in
the order of their SHA-256. A conversation is its list of numbers; equal lists are one row
with a count. The rows are put in lexicographic order and cut into shards of about
``SHARD`` numbers. Each shard builds a ternary search tree in one task, rows inserted
median first so that the branches stay balanced, and walks it with an explicit stack to add
up members, leaves and savings. Only nodes on the common prefix of two neighbouring shards'
adjoining rows exist in several shards; a shard knows how long these prefixes are. A node
belongs to the first shard that has it, so that "once per node" terms count once and all of a
shared node's figures merge by plain sums and minima.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.llm.common import bounded, in_order, shuffle_width, stage

SHARD = 1 << 18  # turn numbers of a shard, besides one conversation
JOINED = 4096  # ids joined into one string before they are hashed
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# --- sequences -----------------------------------------------------------------------------------------

def sequences(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` -> ``(conv_id, seq array<struct<id, bytes>>)`` in order of turn.

    Null turns come first; equal ones are ordered by the SHA-256 of the length of the role, a
    colon, role and text, so a repeated row counts twice and the result is the same for any order
    of rows. Null role or text is empty. Rows without conv_id belong to no conversation. Texts
    are read once and not shuffled. One conversation's numbers meet in one row, as a text does.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    t = stage(turns.where("conv_id is not null").select(
        "conv_id", "turn", key.alias("key"), F.octet_length(text).cast("long").alias("bytes")), "trie-turns")
    words = t.groupBy("key").agg(F.lit(1).alias("one"))
    words = in_order(words, ["key"], {"id": "one"}, "trie-dictionary").select("key", "id")
    t = t.join(words, "key")
    order = F.struct(F.col("turn").isNotNull().alias("given"), "turn", "id", "bytes")
    seq = F.transform(F.sort_array(F.collect_list(order)), lambda x: F.struct(x["id"].alias("id"), x["bytes"].alias("bytes")))
    return t.groupBy("conv_id").agg(seq.alias("seq"))


def rebuilt(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c with the first h turns of c - c % ``every`` (none if absent) in place of its own first h,
    h being the unsigned CRC-32 of c in decimal modulo ``most``."""
    seqs = stage(seqs, "trie-sequences")
    step = F.col("conv_id") % F.lit(every)
    heads = seqs.where(step == 0).select(F.col("conv_id").alias("base"), F.slice("seq", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    j = seqs.withColumn("base", F.col("conv_id") - step).withColumn("h", h).join(heads, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("seq", F.lit(1), F.lit(0)))
    return j.select("conv_id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq"), F.lit(1)))).alias("seq"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) -> runs of at most ``JOINED`` ids of a key: (key, first id, how many, the ids joined)."""
    def batch(rows):
        key, first, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(first, pa.int64()), pa.array(n, pa.int64()),
                                           pa.array(ids, pa.string())], ["key", "conv_id", "n", "ids"])
    now, run, rows = None, [], []
    for b in batches:
        for key, conv in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
            if key != now or len(run) == JOINED:
                if run:
                    rows.append((now, run[0], len(run), ",".join(map(str, run))))
                now, run = key, []
                if len(rows) >= 1000:
                    yield batch(rows)
                    rows = []
            run.append(conv)
    if run:
        rows.append((now, run[0], len(run), ",".join(map(str, run))))
    if rows:
        yield batch(rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs -> (conv_id, n, ends) of each key; the digest is fed run by run."""
    now = first = digest = None
    n, out = 0, []
    for b in batches:
        for key, conv, k, ids in zip(*(b.column(c).to_pylist() for c in ("key", "conv_id", "n", "ids")), strict=True):
            if key != now:
                if digest:
                    out.append((first, n, digest.hexdigest()))
                now, first, n, digest = key, conv, 0, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
            n += k
        if out:
            yield _ends(out)
            out = []
    if digest:
        yield _ends([*out, (first, n, digest.hexdigest())])


def _ends(rows) -> pa.RecordBatch:
    first, n, ends = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(n, pa.int64()), pa.array(ends, pa.string())],
                                      ["conv_id", "n", "ends"])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """``convs(conv_id, ids, sizes)`` -> one row for each list of ids: smallest conv_id, ``n`` conversations, and
    ``ends``: SHA-256 of their ids, ascending and comma-joined.

    A list that many conversations share is sorted in many ranges and reaches its digest as joined strings."""
    keyed = convs.select(F.sha2(F.array_join("ids", ","), 256).alias("key"), "conv_id")
    runs = keyed.repartitionByRange(shuffle_width(convs.sparkSession), "key", "conv_id").sortWithinPartitions("key", "conv_id")
    runs = stage(runs.mapInArrow(_joined, "key string, conv_id bigint, n bigint, ids string"), "trie-members")
    ends = runs.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "conv_id bigint, n bigint, ends string")
    return convs.join(ends, "conv_id")


# --- one shard -----------------------------------------------------------------------------------------

class Tree:
    """Ternary search tree. Node 0 is the root of the trie; ``eq`` of a node holds the tree of its children."""

    def __init__(self):
        self.symbol, self.low, self.eq, self.high, self.up, self.depth, self.size, self.n, self.conv = (array("q", [0]) for _ in range(9))
        self.ends: dict[int, str] = {}

    def _new(self, symbol: int, up: int, size: int) -> int:
        for column, v in ((self.symbol, symbol), (self.low, 0), (self.eq, 0), (self.high, 0), (self.up, up),
                          (self.depth, self.depth[up] + 1), (self.size, size), (self.n, 0), (self.conv, 0)):
            column.append(v)
        return len(self.symbol) - 1

    def path(self, ids: list[int], sizes: list[int]) -> list[int]:
        """The nodes of a sequence from the root on; made where they are missing."""
        out, node = [0], 0
        for s, size in zip(ids, sizes, strict=True):
            link, at = self.eq, node
            child = link[at]
            while child and self.symbol[child] != s:
                link, at = self.low if s < self.symbol[child] else self.high, child
                child = link[at]
            if not child:
                child = self._new(s, node, size)
                link[at] = child
            node = child
            out.append(node)
        return out

    def fill(self, rows: list[tuple]) -> None:
        """Inserts sorted ``(ids, sizes, conv, n, ends)``, the median of each stretch first."""
        todo = [(0, len(rows))]
        while todo:
            a, b = todo.pop()
            if a < b:
                m = (a + b) // 2
                ids, sizes, conv, n, ends = rows[m]
                node = self.path(ids, sizes)[-1]
                self.n[node], self.conv[node], self.ends[node] = n, conv, ends
                todo += [(a, m), (m + 1, b)]

    def walk(self) -> array:
        """All nodes, each after the one above it, by an explicit stack."""
        out, todo = array("q", [0]), [self.eq[0]]
        while todo:
            x = todo.pop()
            if x:
                out.append(x)
                todo += [self.low[x], self.high[x], self.eq[x]]
        return out


_NODE = ("path string, parent string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, "
         "n_children bigint, n_leaves bigint, saved_tokens bigint, ends string")


def _prefix_keys(ids: list[int], upto: int) -> list[str]:
    """A key for each prefix of 0 to ``upto`` numbers."""
    h, out = hashlib.sha256(), []
    for i in range(upto + 1):
        out.append(h.hexdigest())
        if i < len(ids):
            h.update(ids[i].to_bytes(8, "little", signed=True))
    return out


def _shard(t: pa.Table) -> pa.Table:
    """A shard's nodes; those that other shards have too carry their ``path``, children of such nodes their ``parent``."""
    columns = [t.column(c).to_pylist() for c in ("ids", "sizes", "conv_id", "n", "ends")]
    rows = sorted(zip(*columns, strict=True), key=lambda r: r[0])
    before, after = t.column("shared_before")[0].as_py(), t.column("shared_after")[0].as_py()
    tree = Tree()
    tree.fill(rows)
    first, last = tree.path(*rows[0][:2]), tree.path(*rows[-1][:2])
    old = set(first[:before + 1])  # an earlier shard has them
    shared = dict(zip(first[:before + 1], _prefix_keys(rows[0][0], before), strict=True)) if before >= 0 else {}
    if after >= 0:
        shared |= zip(last[:after + 1], _prefix_keys(rows[-1][0], after), strict=True)
    goes_on = last[-1] if after == len(rows[-1][0]) else -1  # its children are in the next shard

    size = len(tree.n)
    children, leaves, saved = (array("q", bytes(8 * size)) for _ in range(3))
    order, n, conv, up, has = tree.walk(), tree.n, tree.conv, tree.up, bytearray(size)
    for x in tree.ends:
        has[x] = 1  # a sequence of this node has set conv
    for x in reversed(order):
        own = x not in old
        if not tree.eq[x] and x != goes_on:
            leaves[x] = 1
        saved[x] += n[x] * tree.size[x] - own * tree.size[x]
        if x:
            p = up[x]
            conv[p] = min(conv[p], conv[x]) if has[p] else conv[x]
            has[p] = 1
            n[p] += n[x]
            children[p] += own
            leaves[p] += leaves[x]
            saved[p] += saved[x]
    path = [shared.get(x) for x in order]
    parent = [shared.get(up[x]) if x else None for x in order]
    above = [conv[up[x]] if x and up[x] not in shared else None for x in order]
    pick = lambda c: pa.array([c[x] for x in order], pa.int64())
    return pa.table([pa.array(path, pa.string()), pa.array(parent, pa.string()), pick(conv), pick(tree.depth), pa.array(above, pa.int64()),
                     pick(n), pick(children), pick(leaves), pick(saved), pa.array([tree.ends.get(x) for x in order], pa.string())],
                    ["path", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"])


# --- all shards ----------------------------------------------------------------------------------------

def _common(a: str, b: str) -> Column:
    """Length of the common prefix of two different arrays; -1 if one is null."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.when(F.col(a).isNull() | F.col(b).isNull(), F.lit(-1)).otherwise(F.array_position(same, False) - 1)


def sharded(rows: DataFrame, shard: int = SHARD) -> DataFrame:
    """Sequences in lexicographic order with their shard and how many first numbers its edges share with its neighbours."""
    rows = in_order(rows.withColumn("weight", F.size("ids").cast("long") + 1), ["ids"], {"before": "weight"}, "trie-order")
    total = rows.agg(F.sum("weight")).first()[0] or 0
    width = max(1, min(shard, -(-total // (4 * shuffle_width(rows.sparkSession)))))  # small tables use all cores
    rows = rows.withColumn("shard", F.expr(f"before div {width}L")).drop("weight", "before")
    w = Window.orderBy("shard")  # one row a shard
    edges = rows.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    edges = edges.select("shard", "first", "last", F.lag("last").over(w).alias("previous"), F.lead("first").over(w).alias("next"))
    edges = edges.select("shard", _common("previous", "first").alias("shared_before"), _common("last", "next").alias("shared_after"))
    return rows.join(edges, "shard")


def trie(convs: DataFrame, shard: int = SHARD) -> DataFrame:
    """``convs(conv_id, seq array<struct<id, bytes>>)``, one row a conversation -> one row for each prefix of a sequence.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (of the node above; root: null),
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes at or below), ``saved_tokens`` (at or below: members
    but one times the bytes of the node's last text), ``ends_sha256`` (of the conversations that end here). A
    conversation without turns ends at the root; an empty table gives no node. Ids are whole numbers; others raise.
    """
    convs = stage(convs.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq.id").alias("ids"), F.col("seq.bytes").alias("sizes")),
                  "trie-conversations")
    rows = sharded(distinct_sequences(convs), shard)
    nodes = stage(rows.groupBy("shard").applyInArrow(_shard, _NODE), "trie-nodes")
    once = nodes.where("path is null")
    merged = nodes.where("path is not null").groupBy("path").agg(
        F.first("parent", True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
    merged = stage(merged, "trie-shared")
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    below = once.where("parent is not null").select("parent", *names)
    below = below.unionByName(merged.drop("path").withColumn("parent_conv_id", F.lit(None).cast("long")))
    above = bounded(merged.select(F.col("path").alias("parent"), F.col("conv_id").alias("above")))
    below = below.join(above, "parent", "left").withColumn("parent_conv_id", F.col("above"))
    out = once.where("parent is null").select(*names).unionByName(below.select(*names))
    return out.select(*names[:-1], F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
