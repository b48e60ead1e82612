"""Sharding by a minimax contiguous partition.

Documents stand in one order in which equal texts are neighbours; a group of equal texts is never split. Cuts between
groups are such that the largest shard is as small as it can be: a search over capacities, each checked greedily (fill
a shard up to the capacity, cut, go on). A greedy step asks for the last group start within reach; starts stay in a
sorted table in the shared folder, and one pass over a few of its pieces answers for hundreds of capacities at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Capacities that one pass tries.
TRIED = 256


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1), text_crc32, law 'bytes', shard, slot (gapless from 0 in each shard), grown_shard (null).

    Groups of equal texts stay whole. A group of at least an even share of what is left has a shard of its own, the
    rest is cut so that its largest shard is least. A null text counts as empty, and as equal to it. Null or repeated
    ids are kept as rows of their own; slots go by text hash and id. With fewer groups than shards some stay empty.
    An empty table gives no rows; further columns are not looked at.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("g"))
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    # At most so many groups can have an even share each.
    top = groups.orderBy(F.desc("bytes"), "g").limit(shards).collect()
    total = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    left, free, giants = total[0] or 0, shards, []
    for t in top:
        if free > 1 and t.bytes * free >= left:
            giants.append(t)
            left, free = left - t.bytes, free - 1
    widest = max((t.bytes for t in top if t not in giants), default=0)
    first = F.lit(len(giants))
    for i, t in enumerate(giants):
        first = F.when(F.col("g") == F.lit(bytes(t.g)), i).otherwise(first)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.withColumn("first", first.cast("int")).repartitionByRange(parts, "first", "g", "doc_id", "text_crc32").sortWithinPartitions("first", "g", "doc_id", "text_crc32")
    runs = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_running, "part int, pos long, sum long, starts boolean, doc_id long, size long, text_crc32 long, g binary")
    runs = materialize(runs, "shard-order")
    pieces = sorted(runs.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min_by("g", "pos").alias("head"), F.max_by("g", "pos").alias("tail"), F.max(F.when(F.col("starts") & (F.col("pos") > 0), F.struct("sum", "pos"))).alias("last")).collect(), key=lambda r: r.part)
    index = _Index(runs, pieces)
    cuts, cut_rows, at, row = [], [], 0, 0
    for t in giants:
        at, row = at + t.bytes, row + t.n
        cuts.append(at)
        cut_rows.append(row)
    if left > 0:
        more, more_rows = _minimax(index, at, row, at + left, free, widest)
        cuts += more
        cut_rows += more_rows
    cuts, cut_rows = cuts[: shards - 1], cut_rows[: shards - 1]
    offsets = spark.createDataFrame([(p.part, b, n) for p, b, n in zip(pieces, index.bytes, index.rows, strict=True)], "part int, before long, rows_before long") if pieces else spark.createDataFrame([], "part int, before long, rows_before long")
    out = runs.join(F.broadcast(offsets), "part")  # one row for each partition
    place = F.col("sum") + F.col("before")
    number, start = F.lit(0), F.lit(0).cast("long")
    for i, (c, r) in enumerate(zip(cuts, cut_rows, strict=True)):
        number, start = F.when(place >= c, i + 1).otherwise(number), F.when(place >= c, F.lit(r).cast("long")).otherwise(start)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), number.cast("int").alias("shard"), (F.col("pos") + F.col("rows_before") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def _running(batches):
    """Position and bytes so far within the partition, and where a new group starts."""
    pos = total = 0
    before = None
    for b in batches:
        size = b.column("size").to_numpy(zero_copy_only=False)
        g = np.array(b.column("g").to_pylist(), object)
        starts = np.empty(len(g), bool)
        if len(g):
            starts[0] = g[0] != before
            starts[1:] = g[1:] != g[:-1]
            before = g[-1]
        sums = np.cumsum(size)
        yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(pos + np.arange(len(g))), pa.array(total + sums - size), pa.array(starts), *(b.column(c) for c in ("doc_id", "size", "text_crc32", "g"))], names=["part", "pos", "sum", "starts", "doc_id", "size", "text_crc32", "g"])
        pos, total = pos + len(g), total + int(sums[-1] if len(g) else 0)


class _Index:
    """Group starts of the ordered table; on the driver there is one entry for each partition."""

    def __init__(self, runs: DataFrame, pieces: list):
        self.runs = runs
        self.parts = [p.part for p in pieces]
        n, b = [p.n for p in pieces], [p.bytes for p in pieces]
        self.bytes, self.rows = ([int(x) for x in np.cumsum([0, *y])[:-1]] for y in (b, n))
        # A partition's first row starts a group unless the partition before ends in that group.
        self.opens = [i == 0 or pieces[i - 1].tail != p.head for i, p in enumerate(pieces)]
        self.last, seen = [], (0, 0)  # the last group start up to each partition's first row
        for i, p in enumerate(pieces):
            if self.opens[i]:
                seen = (self.bytes[i], self.rows[i])
            self.last.append(seen)
            if p.last is not None:
                seen = (self.bytes[i] + p.last["sum"], self.rows[i] + p.last["pos"])

    def last_starts(self, targets: list[int]) -> list[tuple[int, int]]:
        """For each target the last group start, as bytes and rows before it, of at most so many bytes."""
        where = np.searchsorted(np.array(self.bytes), targets, side="right") - 1
        wanted = sorted({int(i) for i in where})
        base = {self.parts[i]: self.bytes[i] for i in wanted}
        goal = np.array(targets, np.int64)

        def find(batches):
            for b in batches:
                keep = b.column("starts").to_numpy(zero_copy_only=False) & (b.column("pos").to_numpy() > 0)
                owner = b.column("part").to_numpy()
                for part in np.unique(owner[keep]):  # a task may read the files of several partitions
                    own = keep & (owner == part)
                    sums, pos = b.column("sum").to_numpy()[own] + base[part], b.column("pos").to_numpy()[own]
                    i = np.searchsorted(sums, goal, side="right") - 1
                    hit = np.flatnonzero(i >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(sums[i[hit]]), pa.array(pos[i[hit]]), pa.array([part] * len(hit), pa.int32())], names=["t", "sum", "pos", "part"])

        some = self.runs.where(F.col("part").isin([self.parts[i] for i in wanted])).select("part", "pos", "sum", "starts")
        rows_of = dict(zip(self.parts, self.rows, strict=True))
        found = {}
        for r in some.mapInArrow(find, "t long, sum long, pos long, part int").groupBy("t").agg(F.max(F.struct("sum", "pos", "part")).alias("m")).collect():
            found[r.t] = (r.m["sum"], r.m["pos"] + rows_of[r.m["part"]])
        return [max(found.get(j, (-1, -1)), self.last[int(i)]) for j, i in enumerate(where)]


def _minimax(index: _Index, start: int, row: int, end: int, shards: int, widest: int) -> tuple[list[int], list[int]]:
    """Cuts of start..end into so many shards with the least largest shard, as bytes and as rows before them."""
    lo, hi = max(-(-(end - start) // shards), widest), -(-(end - start) // shards) + widest
    best: tuple[list[int], list[int]] = ([], [])
    while True:
        tried = sorted({lo + (hi - lo) * i // TRIED for i in range(TRIED + 1)})
        at = [[(start, row)] for _ in tried]
        for _ in range(shards - 1):
            open_ = [j for j, c in enumerate(tried) if at[j][-1][0] + c < end]
            if not open_:
                break
            for j, x in zip(open_, index.last_starts([at[j][-1][0] + tried[j] for j in open_]), strict=True):
                at[j].append(max(x, at[j][-1]))
        fits = [a[-1][0] + c >= end for a, c in zip(at, tried, strict=True)]
        j = fits.index(True)  # the highest always fits
        best = ([x[0] for x in at[j][1:]], [x[1] for x in at[j][1:]])
        if j == 0:
            return best
        lo, hi = tried[j - 1] + 1, tried[j]
        if lo > hi or lo == hi == tried[j]:
            return best
