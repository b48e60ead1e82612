"""Exact top-k search by distributed histogram selection.

Every candidate is scored against every query. Per query, a histogram of all scores over a range known to hold them
is summed over the corpus; the bin in which the k-th highest score lies becomes the next, narrower range, until a bin
is one integer wide and its value is the k-th score itself. A last pass keeps what scores at least that, ties broken
by the smaller id. Queries go in blocks of fixed size, so what is sent to executors is bounded; the corpus never moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import materialize

#: Queries that one block holds, bins of a histogram, corpus rows and queries of one tile of scores.
BLOCK, BINS, ROWS, TILE = 4096, 2048, 2048, 512
_OUT = "query_id long, rank int, vec_id long, score long"
_LIMIT = 1 << 53


class _Block(NamedTuple):
    ids: np.ndarray  # of queries
    vectors: dict[int, tuple[np.ndarray, np.ndarray]]  # by dimension: positions in ids, integer components
    lo: np.ndarray  # the range of scores, both ends in it, and the width of its bins; all as ordered()
    hi: np.ndarray
    width: np.ndarray


def ordered(s: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers in the same order: the distance of any two of these fits 64 bits."""
    return s.view(np.uint64) ^ np.uint64(1 << 63)


def _long(u: np.ndarray) -> np.ndarray:
    return (u ^ np.uint64(1 << 63)).view(np.int64)


def _widths(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return (hi - lo) // np.uint64(BINS) + np.uint64(1)


def integer_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows that take part, and by dimension their positions and floor(scale * x); others are null or hold null, NaN or infinity."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
    lengths = np.nan_to_num(np.asarray(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False), dtype=float), nan=-1).astype(np.int64)
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    whole = np.floor(values * scale)
    by_size = {}
    taking = lengths >= 0
    for d in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == d)
        rows = whole[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        fine = np.isfinite(rows).all(axis=1)
        taking[at[~fine]] = False
        by_size[int(d)] = (at[fine], rows[fine])
    return taking, by_size


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, exact; those beyond a long are held at its ends."""
    most = (np.abs(q).max(initial=0)) * (np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if most < _LIMIT:
        return (q @ v.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in q], object).reshape(q.shape) @ np.array([[int(x) for x in r] for r in v], object).reshape(v.shape).T
    return np.clip(exact.astype(object), -(2**63), 2**63 - 1).astype(np.int64) if exact.size else np.zeros((len(q), len(v)), np.int64)


def _tiles(block: _Block, ids: pa.Array, column: pa.Array, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of queries, ids of candidates, their scores, and which of these count."""
    _, by_size = integer_vectors(column, scale)
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    number = ids.fill_null(-1).to_numpy(zero_copy_only=False)
    for d, (rows, v) in by_size.items():
        if d not in block.vectors:
            continue
        at, q = block.vectors[d]
        for i in range(0, len(rows), ROWS):
            r = rows[i : i + ROWS]
            r = r[known[r]]
            part = v[i : i + ROWS][known[rows[i : i + ROWS]]]
            for j in range(0, len(at), TILE):
                p = at[j : j + TILE]
                s = scores(q[j : j + TILE], part)
                yield p, number[r], s, block.ids[p][:, None] != number[r][None, :]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank (from 1), vec_id, score; fewer if there are fewer candidates.

    Components become floor(scale * x). A candidate is every row with another id than the query's and as many
    components. Rows with a null id, a null vector or null or non-finite components take no part. Equal scores go by
    smaller id. Rows repeated under one id are each a candidate; of repeated query rows one is asked. Scores that a
    long cannot hold are held at its ends. Empty tables give no rows; further columns are not looked at.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(usable)
    # A floor is at most 1 farther from 0 than the number; a long, as SQL's floor gives, may not hold it.
    whole = F.transform("v", lambda x: F.abs(x.cast("double") * scale) + 1)
    # The largest norm by dimension bounds every score: |q . v| <= |q| |v|.
    norms = {r.d: r.m for r in v.where(usable).select(F.size("v").alias("d"), F.aggregate(whole, F.lit(0.0), lambda a, x: a + x * x).alias("s")).groupBy("d").agg(F.max("s").alias("m")).collect()}
    spark = vectors.sparkSession
    count = asked.select(F.countDistinct("vec_id")).first()[0] if norms else 0
    parts = []
    blocks = -(-count // (block * 3 // 4)) or 0
    pending = [(blocks, i) for i in range(blocks)]
    while pending:
        n, i = pending.pop()
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == i).groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = own.limit(block + 1).toArrow() if n < count else own.toArrow()
        if rows.num_rows > block:  # the hash dealt this block too many
            pending += [(2 * n, i), (2 * n, i + n)]
        elif rows.num_rows:
            parts.append(_block(spark, v, rows, norms, k, scale))
    out = spark.createDataFrame([], _OUT) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _block(spark, v: DataFrame, rows: pa.Table, norms: dict[int, float], k: int, scale: int) -> DataFrame:
    ids = rows.column("vec_id").combine_chunks().to_numpy(zero_copy_only=False)
    _, by_size = integer_vectors(rows.column("v"), scale)
    reach = np.zeros(len(ids))
    for d, (at, q) in by_size.items():
        reach[at] = np.ceil(np.sqrt((q * q).sum(axis=1)) * np.sqrt(norms.get(d, 0.0)) * (1 + 1e-9)) + 1
    # Where scores may leave the longs, all longs are the range; those farther out are held at its ends.
    far = reach >= 2.0**62
    most = np.where(far, 0, reach).astype(np.int64)
    lo, hi = np.where(far, np.uint64(0), ordered(-most)), np.where(far, np.uint64((1 << 64) - 1), ordered(most))
    wanted = np.full(len(ids), k, np.int64)
    width = _widths(lo, hi)
    live = np.ones(len(ids), bool)
    threshold = lo.copy()
    while live.any():
        kept = np.flatnonzero(live)
        at_of = np.full(len(ids), -1)
        at_of[kept] = np.arange(len(kept))
        state = _Block(ids[kept], {d: (at_of[p[live[p]]], q[live[p]]) for d, (p, q) in by_size.items()}, lo[kept], hi[kept], width[kept])
        shared = spark.sparkContext.broadcast((state, wanted[kept]))
        hist = v.mapInArrow(_histogram(shared, scale), "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        # The k-th score lies in the highest bin with at least k scores in it and above.
        above = Window.partitionBy("q").orderBy(F.desc("bin"))
        need = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(kept)), pa.int32()), "k": pa.array(wanted[kept])}))
        at = hist.withColumn("sum", F.sum("n").over(above)).join(F.broadcast(need), "q").where("sum >= k and sum - n < k").select("q", "bin", F.expr("k - (sum - n)").alias("k")).toArrow()
        q, b, left = (at.column(c).to_numpy() for c in ("q", "bin", "k"))
        found = np.zeros(len(kept), bool)
        found[q] = True
        live[kept[~found]] = False  # fewer than k candidates: all of them stay
        at = kept[q]
        lo[at] += b.astype(np.uint64) * width[at]
        hi[at] = lo[at] + np.minimum(hi[at] - lo[at], width[at] - np.uint64(1))
        wanted[at] = left
        threshold[at] = lo[at]
        live[at[width[at] == 1]] = False
        width[at] = _widths(lo[at], hi[at])
    final = _Block(ids, by_size, threshold, hi, width)
    near = v.mapInArrow(_at_least(spark.sparkContext.broadcast(final), k, scale), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return materialize(near.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")


def _histogram(shared, scale: int):
    """Counts of scores by query and bin. Bins below those that hold a partition's own k highest can't hold the k-th of all and are left out."""

    def run(batches):
        block, wanted = shared.value
        n = len(block.ids)
        counts = np.zeros((n, BINS), np.int64)
        for batch in batches:
            for p, _, s, ours in _tiles(block, batch.column(0), batch.column(1), scale):
                # What lies above the range was counted before; what lies below can't be the k-th.
                u, lo = ordered(s), block.lo[p][:, None]
                good = ours & (u >= lo) & (u <= block.hi[p][:, None])
                bins = ((u - lo) // block.width[p][:, None]).astype(np.int64)
                flat = (np.arange(len(p))[:, None] * BINS + bins)[good]
                counts[p] += np.bincount(flat, minlength=len(p) * BINS).reshape(len(p), BINS)
        from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        q, b = np.nonzero((counts > 0) & (from_top - counts < wanted[:, None]))
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(b, pa.int32()), pa.array(counts[q, b])], ["q", "bin", "n"])

    return run


def _at_least(shared, k: int, scale: int):
    """Candidates at or above each query's threshold; of a batch's ties no more than k, the smallest ids."""

    def run(batches):
        block = shared.value
        for batch in batches:
            for p, ids, s, ours in _tiles(block, batch.column(0), batch.column(1), scale):
                q, c = np.nonzero(ours & (s >= _long(block.lo[p])[:, None]))
                order = np.lexsort((ids[c], -s[q, c], q))
                q, c = q[order], c[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
                q, c = q[keep], c[keep]
                if len(q):
                    yield pa.RecordBatch.from_arrays([pa.array(block.ids[p[q]]), pa.array(ids[c]), pa.array(s[q, c])], ["query_id", "vec_id", "score"])

    return run
