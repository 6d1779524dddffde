"""Documents cut into shards of near equal bytes by a minimax contiguous partition.

Method. Equal texts are one atomic group, whose size is that of all its rows.
Groups stand in the order of their smallest doc_id, and their ends are running
sums of sizes. The smallest capacity with which so many consecutive shards hold
everything is found by binary search; a capacity is checked greedily: a shard
ends at the last group end within its start plus the capacity. The search needs
no list of the ends: it works on a summary of at most about ``CELLS`` rows (least
and largest end of cells of equal width), which bounds every greedy step from both
sides. Where the bounds differ, the next summary splits the stretches in question
into narrower cells, until they agree. With the capacity known, a greedy pass from
the end gives how early each cut may be, and each cut takes the end nearest to an
equal share of what is left (a group above a fair share counting as one share): the
largest shard is the smallest possible, the others are even where a large group leaves
them the choice.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import in_order, stage

SHARDS = 16
CELLS = 1 << 14
COPIES = 4096  # rows that repeat one document are written in runs of so many


class Ends:
    """What a summary tells of the ordered group ends: least, largest and number of each cell."""

    def __init__(self, cells: list[tuple[int, int, int]], width: int):
        self.width = width
        self.low, self.high, self.n = ([c[k] for c in cells] for k in range(3))

    def below(self, t: int) -> tuple[int, int]:
        """Bounds of the largest end of at most ``t`` (0 if none)."""
        i = bisect_right(self.low, t) - 1
        if i < 0:
            return 0, 0
        if t >= self.high[i] or self.n[i] < 3:
            return (self.high[i],) * 2 if t >= self.high[i] else (self.low[i],) * 2
        return self.low[i], t

    def above(self, t: int) -> tuple[int, int]:
        """Bounds of the smallest end of at least ``t``; 0 is an end."""
        if t <= 0:
            return 0, 0
        i = bisect_left(self.high, t)
        if t <= self.low[i] or self.n[i] < 3:
            return (self.low[i],) * 2 if t <= self.low[i] else (self.high[i],) * 2
        return t, self.high[i]

    def forward(self, capacity: int, shards: int, side: int) -> list[int]:
        """Greedy ends of the shards; ``side`` 0: none too late, 1: none too early."""
        at, out = 0, []
        for _ in range(shards):
            at = self.below(at + capacity)[side]
            out.append(at)
        return out

    def backward(self, capacity: int, shards: int, total: int, side: int) -> list[int]:
        """Earliest end of each shard if all later ones are filled to ``capacity``."""
        at, out = total, [total]
        for _ in range(shards - 1):
            at = self.above(at - capacity)[side]
            out.append(at)
        return out[::-1]


def summary(groups: DataFrame, stretches: list[tuple[int, int]], rows: int, most: int) -> Ends:
    """Cells of width ``most`` or less over the ``stretches`` of ends, which hold ``rows`` ends at most: single ends if these are few."""
    width = 1 if rows <= CELLS else max(1, min(most, -(-sum(b - a + 1 for a, b in stretches) // CELLS)))
    inside = F.lit(False)
    for a, b in stretches:
        inside |= F.col("end").between(a, b)
    cells = groups.where(inside).groupBy(F.expr(f"end div {width}L").alias("cell")).agg(
        F.min("end"), F.max("end"), F.count(F.lit(1)))
    return Ends(sorted((r[1], r[2], r[3]) for r in cells.collect()), width)


def _stretches(lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    """Disjoint intervals that cover each pair of bounds."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(lows, highs, strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _refined(groups: DataFrame, ends: Ends, lows: list[int], highs: list[int]) -> Ends:
    parts = _stretches(lows, highs)
    rows = sum(n for low, high, n in zip(ends.low, ends.high, ends.n, strict=True) if any(low <= b and high >= a for a, b in parts))
    return summary(groups, parts, rows, ends.width // 2)


def _exact(groups: DataFrame, ends: Ends, bounds: tuple[int, int], of) -> int:
    """The largest (``of`` is ``max``) or smallest (``min``) end within ``bounds``, by summaries of ever fewer ends."""
    while bounds[0] < bounds[1]:
        ends = _refined(groups, ends, [bounds[0]], [bounds[1]])
        bounds = ends.below(bounds[1]) if of is max else ends.above(bounds[0])
    return bounds[0]


def _first(least: int, most: int, holds) -> int:
    """The smallest whole number from ``least`` for which ``holds``; ``most`` if none below it does."""
    while least < most:
        mid = (least + most) // 2
        least, most = (least, mid) if holds(mid) else (mid + 1, most)
    return least


class Shares:
    """Positions with the groups of more than a fair share counted as one share, so that the rest is divided evenly.

    ``largest`` holds the (size, start, end) of as many largest groups as there are shards."""

    def __init__(self, total: int, shards: int, largest: list[tuple[int, int, int]]):
        self.share, self.giants = total // shards, []
        for k, g in enumerate(largest[:shards - 1]):
            if g[0] <= self.share:
                break
            self.giants.append(g)
            self.share = (total - sum(x[0] for x in self.giants)) // (shards - k - 1)
        self.giants.sort(key=lambda g: g[1])

    def of(self, end: int) -> int:
        return end - sum(size - self.share for size, _, e in self.giants if e <= end)

    def back(self, at: int) -> int:
        for size, start, _ in self.giants:
            if at < start:
                break
            if at < start + self.share:
                return at
            at += size - self.share
        return at


def cuts(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """``groups(size, end)`` -> (smallest feasible capacity, ends of the first ``shards - 1`` shards)."""
    total, largest, rows = groups.agg(F.max("end"), F.max("size"), F.count(F.lit(1))).first()
    if not rows:
        return 0, [0] * (shards - 1)
    coarse = ends = summary(groups, [(1, total)], rows, total)
    least, most = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        # with the later bounds a capacity may seem to do, with the earlier ones it surely does
        least = _first(least, most, lambda c: ends.forward(c, shards, 1)[-1] >= total)
        most = _first(least, most, lambda c: ends.forward(c, shards, 0)[-1] >= total)
        lows, highs = ends.forward(least, shards, 0), ends.forward(most, shards, 1)
        if least == most and lows == highs:
            break
        ends = _refined(groups, ends, lows, highs)
    capacity, latest, ends = least, lows, coarse
    while True:
        lows, highs = (ends.backward(capacity, shards, total, side) for side in (0, 1))
        if lows == highs:
            break
        ends = _refined(groups, ends, lows, highs)
    top = groups.orderBy(F.col("size").desc(), "end").limit(shards).select("size", "start", "end").collect()
    shares = Shares(total, shards, [tuple(r) for r in top])
    at, out = 0, []
    for k in range(shards - 1):
        if at < total:
            want, last = shares.of(at) + (shares.of(total) - shares.of(at)) // (shards - k), min(latest[k], at + capacity)
            middle = shares.back(want)
            near = [_exact(groups, coarse, coarse.below(min(middle, last)), max), _exact(groups, coarse, coarse.above(max(middle, lows[k])), min),
                    lows[k], _exact(groups, coarse, coarse.above(at + 1), min)]
            at = min((x for x in near if max(at + 1, lows[k]) <= x <= last), key=lambda x: (abs(shares.of(x) - want), x))
        out.append(at)
    return capacity, out


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1), ``text_crc32`` unsigned over the
    same bytes. ``shard`` runs from 0; equal texts (a null text equals an empty one) share a
    shard, and no assignment of the ordered groups to consecutive shards has a smaller
    largest shard. ``slot`` numbers the rows of a shard from 0 without gaps, by group and
    doc_id, copies of a row in any order. ``law`` is ``bytes``; ``grown_shard`` is null,
    since another number of shards is another partition. Every row gets a place, null and
    repeated doc_ids too; an empty table gives no row. With fewer groups than shards the
    last shards are empty. Other input columns are not read or returned, whatever their names.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = stage(rows.groupBy("key", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "shard-rows")
    # the rows of one text may be many: their numbers come from ranges of (text, doc_id) as well
    rows = in_order(rows, ["key", "doc_id"], {"place": "copies"}, "shard-places")
    groups = rows.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("place").alias("base"),
                                     F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("copies"))
    groups = in_order(groups, ["first_id", "key"], {"start": "size", "first_slot": "copies"}, "shard-groups")
    groups = groups.withColumn("end", F.col("start") + F.col("size"))
    capacity, at = cuts(groups, shards)
    shard = sum(((F.col("start") >= c).cast("int") for c in at), F.lit(0))
    groups = groups.withColumn("shard", shard)
    first = {r[0]: r[1] for r in groups.groupBy("shard").agg(F.min("first_slot")).collect()}  # one row a shard
    starts = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(shards)])
    groups = groups.select("key", "shard", (F.col("first_slot") - F.col("base") - starts[F.col("shard")]).alias("shift"))
    placed = rows.join(groups, "key").select("doc_id", "size", "text_crc32", "shard", "copies",
                                             (F.col("place") + F.col("shift")).alias("slot"))
    placed = stage(placed, "shard-placed")
    one = placed.where(F.col("copies") == 1).drop("copies")
    runs = placed.where("copies > 1").withColumn("run", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}L")))).repartition("slot", "run")
    more = F.sequence(F.col("run") * COPIES, F.least("copies", (F.col("run") + 1) * COPIES) - 1)
    runs = runs.select("doc_id", "size", "text_crc32", "shard", "slot", F.explode(more).alias("copy"))
    out = one.unionByName(runs.withColumn("slot", F.col("slot") + F.col("copy")).drop("copy"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
