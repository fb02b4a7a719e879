"""Shards of near equal bytes, by minimax contiguous partition.

Documents of equal text are one group and stay together. Groups stand in the order of a hash of
their text; a shard is a run of them. The smallest capacity under which a greedy cut needs no more
than the given number of shards is found by binary search, and the cuts of that capacity are used.
A group larger than an even share makes a shard by itself; the others divide the remaining shards.

Group sizes never come to the driver as a whole. It holds at most `PIECES` sums of runs of groups
at a time: the greedy cut is checked once as if groups could be cut anywhere inside a run and once
as if only its ends were known. Where the two differ, only the runs in question are summed more
finely, until capacity and cuts are exact. Offsets are prefix sums over hash buckets.

Defined cases: a null text has no bytes and is grouped with empty texts. Sizes are bytes plus 1.
With fewer groups than shards some shards are empty. Repeated rows are rows of one group, each with
a slot of its own; rows of equal text and doc_id are alike, so which of them has which slot is open. A very
long text is a group like others, by its bytes. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leasebook.llm.common import stage

SHARDS = 16
# Groups of a bucket, about, and bounds of the number of buckets.
BUCKET_GROUPS = 1 << 16
LEAST_BITS, MOST_BITS = 12, 20
PIECES = 1 << 14
# Stretches that are summed more finely at a time.
STRETCHES = 256
# Rows of one group that are numbered together.
BIN_ROWS = 1 << 10
GROUP = ["k1", "k2"]


@dataclass
class Runs:
    """Known borders between groups, and whether more borders lie between two neighbours."""

    total: int
    edges: list[int] = field(default_factory=list)
    open: list[bool] = field(default_factory=list)

    def __post_init__(self):
        self.edges, self.open = [0, self.total], [True]

    def cuts(self, capacity: int, hopeful: bool) -> list[int]:
        """Greedy cut positions; hopeful: a border is assumed wherever one is not ruled out."""
        out, at = [], 0
        while at + capacity < self.total:
            until = at + capacity
            i = bisect_right(self.edges, until) - 1
            new = until if hopeful and self.open[i] else self.edges[i]
            if new <= at:
                return out + [math.inf]
            out.append(new)
            at = new
        return out

    def smallest(self, shards: int, least: int, hopeful: bool) -> int:
        low, high = max(least, -(-self.total // shards)), max(self.total, 1)
        while low < high:
            middle = (low + high) // 2
            cuts = self.cuts(middle, hopeful)
            if len(cuts) < shards and math.inf not in cuts:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, shards: int, least: int) -> tuple[list[int], list[tuple[int, int]]]:
        """The cuts, if they are certain, and the open stretches that could still move one.

        Where these are more than `STRETCHES`, only those that the cuts of the two capacities meet.
        """
        low, high = self.smallest(shards, least, True), self.smallest(shards, least, False)
        first, last = self.cuts(low, False), self.cuts(high, True)
        if low == high and first == last:
            return first, []
        wide = []
        for j in range(shards - 1):
            begin = first[j] if j < len(first) and first[j] != math.inf else (first[j - 1] if 0 < j <= len(first) else 0)
            end = min(last[j], self.total) if j < len(last) else self.total
            begin = min(begin, end)
            for i in range(max(bisect_right(self.edges, begin) - 1, 0), len(self.open)):
                if self.edges[i] > end:
                    break
                if self.open[i]:
                    wide.append((self.edges[i], self.edges[i + 1]))
        return [], wide if len(wide := self._merged(wide)) <= STRETCHES else self._merged(self._met(low) + self._met(high))

    def _met(self, capacity: int) -> list[tuple[int, int]]:
        """Open stretches in which the hopeful cuts of a capacity lie.

        If none were open, the cuts would be certain, so summing these makes headway.
        """
        out = []
        for until in self.cuts(capacity, True):
            i = bisect_right(self.edges, until) - 1
            if until != math.inf and self.edges[i] < until and self.open[i]:
                out.append((self.edges[i], self.edges[i + 1]))
        return out

    @staticmethod
    def _merged(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
        joined: list[tuple[int, int]] = []
        for begin, end in sorted(set(stretches)):
            if joined and joined[-1][1] >= begin:
                joined[-1] = (joined[-1][0], max(end, joined[-1][1]))
            else:
                joined.append((begin, end))
        return joined

    def refine(self, parts: list[tuple[int, int, int, int]]) -> None:
        """Take in runs of groups: first start, last start, last end, number of groups."""
        known = dict.fromkeys(self.edges)
        closed = {(self.edges[i], self.edges[i + 1]) for i, more in enumerate(self.open) if not more}
        for first, last, end, count in parts:
            known.update(dict.fromkeys((first, last, end)))
            closed.add((last, end))
            if count == 2:
                closed.add((first, last))
        self.edges = sorted(known)
        self.open = [pair not in closed for pair in zip(self.edges, self.edges[1:])]


def _sizes(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2"),
    )


def _before(column: str, bucket: Window) -> Column:
    return F.coalesce(F.sum(column).over(bucket.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _placed(groups: DataFrame) -> DataFrame:
    """Groups with the bytes and rows before them, in the order of their hashes."""
    bits = min(max((groups.count() // BUCKET_GROUPS).bit_length(), LEAST_BITS), MOST_BITS)
    bucketed = groups.withColumn("bucket", F.shiftrightunsigned("k1", 64 - bits).cast("int"))
    inside = Window.partitionBy("bucket").orderBy(*GROUP)
    # One row a bucket: 2^MOST_BITS rows at most.
    sums = bucketed.groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    over = Window.orderBy("bucket")
    starts = sums.select("bucket", _before("bytes", over).alias("byte_base"), _before("rows", over).alias("row_base"))
    return (
        bucketed.withColumns({"byte_in": _before("bytes", inside), "row_in": _before("rows", inside)})
        .join(F.broadcast(starts), "bucket")
        .select(*GROUP, "bytes", "rows", (F.col("byte_base") + F.col("byte_in")).alias("start"),
                (F.col("row_base") + F.col("row_in")).alias("row_start"))
    )


def _split(placed: DataFrame, shards: int, total: int, largest: int) -> list[int]:
    runs = Runs(total)
    while True:
        cuts, unsure = runs.unsure(shards, largest)
        if not unsure:
            return cuts
        pieces = max(PIECES // len(unsure), 2)
        cell = F.lit(None).cast("long")
        for k, (begin, end) in enumerate(unsure):  # STRETCHES at most
            step = -(-(end - begin) // pieces)
            cell = F.when((F.col("start") >= begin) & (F.col("start") < end),
                          F.floor((F.col("start") - begin) / F.lit(step)).cast("long") + k * (pieces + 1)).otherwise(cell)
        found = (
            placed.select("start", "bytes", cell.alias("cell")).where("cell IS NOT NULL").groupBy("cell")
            .agg(F.min("start").alias("first"), F.max("start").alias("last"), F.max(F.col("start") + F.col("bytes")).alias("end"),
                 F.count(F.lit(1)).alias("n"))
        )
        runs.refine([(r["first"], r["last"], r["end"], r["n"]) for r in found.toLocalIterator()])  # about PIECES rows


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of `docs`: doc_id, size, text_crc32, shard, slot (rows of a shard are numbered from 0)."""
    rows = _sizes(docs)
    groups = stage(rows.groupBy(*GROUP).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")))
    total = groups.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    alone, left = [], total
    for r in groups.orderBy(F.desc("bytes"), *GROUP).limit(shards).collect():  # at most one row a shard
        if len(alone) < shards - 1 and r["bytes"] * (shards - len(alone)) > left and r["bytes"] < left:
            alone.append((r["k1"], r["k2"], shards - 1 - len(alone)))
            left -= r["bytes"]
    heavy = docs.sparkSession.createDataFrame(alone, "k1 long, k2 long, own int")
    others = groups.join(F.broadcast(heavy.select(*GROUP)), GROUP, "left_anti")
    placed = stage(_placed(others))
    largest = placed.agg(F.max("bytes").alias("n")).first()["n"] or 0
    cuts = _split(placed, shards - len(alone), left, largest) if left else []
    number = sum(((F.col("start") >= c).cast("int") for c in cuts), F.lit(0))
    numbered = placed.withColumn("shard", number)
    first_rows = numbered.groupBy("shard").agg(F.min("row_start").alias("first_row"))  # one row a shard
    where = (
        numbered.join(F.broadcast(first_rows), "shard").select(*GROUP, "rows", "shard", (F.col("row_start") - F.col("first_row")).alias("offset"))
        .unionByName(groups.join(F.broadcast(heavy), GROUP).select(*GROUP, "rows", F.col("own").alias("shard"), F.lit(0).cast("long").alias("offset")))
    )
    # A large group is numbered in bins of about BIN_ROWS rows, so that no task gets all of it.
    bins = F.ceil(F.col("rows") / F.lit(BIN_ROWS))
    binned = rows.join(where, GROUP).withColumn("bin", F.pmod(F.xxhash64("doc_id"), bins).cast("int"))
    large = groups.where(F.col("rows") > BIN_ROWS).select(*GROUP, "rows")
    counts = (
        rows.join(large, GROUP).withColumn("bin", F.pmod(F.xxhash64("doc_id"), bins).cast("int"))
        .groupBy(*GROUP, "bin").agg(F.count(F.lit(1)).alias("n"))
        .select(*GROUP, "bin", _before("n", Window.partitionBy(*GROUP).orderBy("bin")).alias("bin_start"))
    )
    rank = F.row_number().over(Window.partitionBy(*GROUP, "bin").orderBy("doc_id")) - 1
    return (
        binned.join(counts, [*GROUP, "bin"], "left").withColumn("rank", rank)
        .select("doc_id", "size", "text_crc32", "shard",
                (F.col("offset") + F.coalesce("bin_start", F.lit(0)) + F.col("rank")).cast("long").alias("slot"))
    )
