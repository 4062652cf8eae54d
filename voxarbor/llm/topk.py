"""Exact top-k inner-product search by block-at-a-time pruning.

A task holds its rows in frames.  A frame's rows are put in the order of the pivot (one of
its own rows) they agree with best, so that a block of consecutive rows holds vectors that
lie together.  A block keeps, per dimension (term), its largest and smallest value; for a
query these sum to a bound on any score in the block.  Each query visits blocks in falling
order of that bound, scores them through their forward index (the block's matrix) and stops
once the bound is below its k-th best.  Its k-th best starts at the k-th best among SEED_ROWS
rows, scored beforehand and sent along with the query, so what other tasks would find prunes
too and a task hands on only rows that reach it.  Results are exact.

How much is pruned depends on the data: bounds are tight where vectors form clusters, and on
vectors spread evenly over a sphere of many dimensions hardly any block can be skipped.

Cases: null vectors, and those with a null, NaN or infinite component, take no part;
rows without id neither; shorter vectors count as padded with zeros; rows with the
query's own id are its own; ties go to the smaller id; fewer than k: all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, shared_dir

BLOCK_ROWS = 64
#: Blocks of a query that are looked at between two looks at its k-th best.
STEP_BLOCKS = 8
#: Rows that give queries their first k-th best.
SEED_ROWS = 4096
#: Queries that one pass over the vectors answers; they are sent to the executors
#: (at 64 dimensions 2 MB).
PASS_QUERIES = 4096
#: Rows whose blocks are pruned together.
FRAME_ROWS = 16_384


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and components floor(256 x) as double, of the vectors that take part."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", fine)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("v"))


def _padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        n = min(len(v), width)
        out[i, :n] = v[:n]
    return out


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where all sums stay below 2**53, else int64."""
    top = (np.abs(q).max(initial=0) * np.abs(m).max(initial=0)) * max(1, m.shape[1])
    if top < 2**53:
        return (q @ m.T).astype(np.int64)
    return q.astype(np.int64) @ m.astype(np.int64).T


_NONE = np.iinfo(np.int64).min


def clustered(m: np.ndarray) -> np.ndarray:
    """An order of rows in which those that agree with the same pivot are neighbours."""
    pivots = m[:: max(1, BLOCK_ROWS)]
    pivots = pivots / np.maximum(1e-9, np.linalg.norm(pivots, axis=1, keepdims=True))
    near = np.concatenate([(m[s : s + 1024] @ pivots.T).argmax(axis=1) for s in range(0, len(m), 1024)])
    return np.argsort(near, kind="stable")


def best_in(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int, floor: np.ndarray | None = None):
    """For each query its k best rows of (ids, m) that score `floor` or more: arrays (query
    index, id, score), and how many (query, block) pairs were scored."""
    order = clustered(m)
    ids, m = ids[order], m[order]
    blocks = [(ids[s : s + BLOCK_ROWS], m[s : s + BLOCK_ROWS]) for s in range(0, len(ids), BLOCK_ROWS)]
    high, low = np.stack([b.max(0) for _, b in blocks]), np.stack([b.min(0) for _, b in blocks])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    # bounds are sums of doubles: a relative margin keeps their rounding harmless
    bound += 1e-9 * np.abs(bound) + 1
    order = np.argsort(-bound, axis=1, kind="stable")
    floor = np.full(len(q), _NONE) if floor is None else floor
    best_s = np.full((len(q), k), _NONE)
    best_i = np.full((len(q), k), np.iinfo(np.int64).max)
    scored = 0
    for r in range(0, len(blocks), STEP_BLOCKS):
        some = order[:, r : r + STEP_BLOCKS]
        kth = np.maximum(best_s[:, -1], floor)
        open_ = (kth == _NONE)[:, None] | (np.take_along_axis(bound, some, 1) >= kth[:, None])
        if not open_.any():
            break
        at, col = np.nonzero(open_)
        which = some[at, col]
        scored += len(at)
        by = np.argsort(which, kind="stable")
        at, which = at[by], which[by]
        cut = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1], [True]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            sel, (bid, bm) = at[a:b], blocks[which[a]]
            s = _scores(q[sel], bm)
            least = np.maximum(best_s[sel, -1], floor[sel])[:, None]
            i, j = np.nonzero((s >= least) & (bid[None] != qids[sel][:, None]))
            if not len(i):
                continue
            hit = np.unique(i)
            sel, s = sel[hit], np.where((s[hit] >= least[hit]) & (bid[None] != qids[sel[hit]][:, None]), s[hit], _NONE)
            i = np.where(s == _NONE, np.iinfo(np.int64).max, np.broadcast_to(bid, s.shape))
            s, i = np.concatenate([best_s[sel], s], 1), np.concatenate([best_i[sel], i], 1)
            top = np.lexsort((i, ~s), axis=1)[:, :k]
            best_s[sel], best_i[sel] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
    at, col = np.nonzero(best_s != _NONE)
    return at, best_i[at, col], best_s[at, col], scored


def _one_pass(rows: DataFrame, seeds: tuple[np.ndarray, list], qids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    floor = np.full(len(q), _NONE)
    if len(seeds[0]):
        at, _, s, _ = best_in(seeds[0], _padded(seeds[1], q.shape[1]), qids, q, k)
        full = np.bincount(at, minlength=len(q)) == k
        low = np.full(len(q), np.iinfo(np.int64).max)
        np.minimum.at(low, at, s)
        floor[full] = low[full]
    shared = rows.sparkSession.sparkContext.broadcast((qids, q, floor))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, floor = shared.value
        held_i, held_m, n = [], [], 0

        def flush():
            at, ids, s, _ = best_in(np.concatenate(held_i), np.concatenate(held_m), qids, q, k, floor)
            return pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(ids), pa.array(s)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            held_i.append(batch.column("vec_id").to_numpy(zero_copy_only=False))
            held_m.append(_padded(batch.column("v").to_pylist(), q.shape[1]))
            n += batch.num_rows
            if n >= FRAME_ROWS:
                yield flush()
                held_i, held_m, n = [], [], 0
        if n:
            yield flush()

    return rows.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score.  Queries run in passes of PASS_QUERIES against all rows."""
    spark = vectors.sparkSession
    rows = materialise(quantised(vectors))
    out = f"{shared_dir(spark)}/found"
    some = rows.limit(SEED_ROWS).collect()
    seeds = np.array([r.vec_id for r in some], dtype=np.int64), [r.v for r in some]
    parts, ids, qs = 0, [], []
    # queries reach the driver a partition at a time, never all at once
    stream = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).toLocalIterator(prefetchPartitions=False)

    def answer() -> None:
        q = _padded(qs, max(len(v) for v in qs))
        _one_pass(rows, seeds, np.array(ids, dtype=np.int64), q, k).write.mode("append").parquet(out)

    for row in stream:
        ids.append(row.vec_id)
        qs.append(row.v)
        if len(ids) == PASS_QUERIES:
            answer()
            parts, ids, qs = parts + 1, [], []
    if ids:
        answer()
        parts += 1
    schema = "query_id long, vec_id long, score long"
    found = spark.read.schema(schema).parquet(out) if parts else spark.createDataFrame([], schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
