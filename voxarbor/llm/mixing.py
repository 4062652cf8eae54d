"""Mixing sources to target weights by subset-sum budget fitting.

Per source, whole copies of everything are taken while the target allows; what is
left of the budget is filled by documents chosen by exact token length: counts of
documents by length, a proportional share of every length, then bounded-knapsack
dynamic programming over the remaining counts for the rest of the budget.  Which
documents of a length are taken is decided by a seeded hash of their id.

Cases: null source is a source of its own and comes last; null or blank text has
size 0 and takes 0; a source of size 0 has target 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, pieces, worker_state

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, CAP = 1.5, 2.0
#: Budget (in words) that the dynamic programme resolves, at least.
DP_WORDS = 1 << 16
#: Steps of the programme between two that are kept.
STEPS_KEPT = 64
#: A (source, length) group beyond this is ranked in hash buckets.
GROUP_ROWS = 500
BUCKET_BITS = 10


def sized(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, source, columns to carry and size: words [^\\x20\\x09-\\x0D]+ of the whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("mixing")
        for batch in batches:
            for part in pieces(batch, "text"):
                # bytes.split() cuts at exactly \x20 and \x09-\x0D
                n = [0 if t is None else len(t.encode("utf-8", "surrogatepass").split()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in names), pa.array(n, pa.int64())], names=[*names, "size"])

    names = ["doc_id", "source", *carry]
    schema = docs.select(*names).withColumn("size", F.lit(0).cast("long")).schema
    return docs.select(*names, "text").mapInArrow(count, schema)


def targets(sizes: dict[str | None, int], weights=WEIGHTS, share=SHARE, cap=CAP) -> dict[str | None, float]:
    """Words wanted of each source: weights repeat over sources in code-point order
    (null last); shares above cap * size are fixed there and the excess is reshared."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), list(order), {}
    while free:
        w = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > cap * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / w for s in free})
            break
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to
    `budget` from below, by bounded knapsack.

    Up to a window of words (DP_WORDS, or twice the longest text) the programme settles the
    whole budget, and its sum is the best there is.  Of a larger budget all but a window is
    shared out in proportion first; the programme then fills the window, exactly, from
    everything that is left."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros_like(counts)
    if budget >= total:
        return counts.copy()
    window = max(DP_WORDS, 2 * int(lengths.max()))
    take = np.floor(counts * max(0.0, (budget - window) / total)).astype(np.int64)
    rest = int(budget - (take * lengths).sum())
    falling = np.argsort(-lengths, kind="stable")
    for i in falling:  # what rounding has left, one more of each length
        if rest <= window:
            break
        if take[i] < counts[i] and 0 < lengths[i] <= rest:
            take[i] += 1
            rest -= int(lengths[i])
    items: list[tuple[int, int, int]] = []  # length index, copies, words
    for i in falling:
        spare, step = int(counts[i] - take[i]), 1
        spare = min(spare, rest // int(lengths[i])) if lengths[i] > 0 else 0
        while spare > 0:
            n = min(step, spare)
            items.append((int(i), n, n * int(lengths[i])))
            spare, step = spare - n, step * 2
    # Sums that the first k items reach are bits of an integer; every STEPS_KEPT-th is kept,
    # those between are worked out again on the way back.
    mask, reach, kept, done = (1 << (rest + 1)) - 1, 1, [1], 0
    for _, _, words in items:
        reach |= (reach << words) & mask
        done += 1
        if done % STEPS_KEPT == 0:
            kept.append(reach)
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for block in range((done - 1) // STEPS_KEPT, -1, -1):
        first, steps = block * STEPS_KEPT, [kept[block]]
        for _, _, words in items[first : min(done, first + STEPS_KEPT) - 1]:
            steps.append(steps[-1] | (steps[-1] << words) & mask)
        for k in range(len(steps) - 1, -1, -1):
            if not steps[k] >> at & 1:
                i, n, words = items[first + k]
                take[i] += n
                at -= words
    return take


def mix(docs: DataFrame, seed: int = 17, weights=WEIGHTS, share=SHARE, cap=CAP, carry=()) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken words, and
    the columns named in `carry`.

    The driver holds one size per source; everything by length stays distributed."""
    base = materialise(sized(docs, *carry).withColumns({
        "_r": F.xxhash64("doc_id", F.lit(seed)),
        "_src": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source")),
    }))
    per = {r._src: (r.source, r.size) for r in base.groupBy("_src", "source").agg(F.sum("size").alias("size")).collect()}
    want = targets({source: size for source, size in per.values()}, weights, share, cap)
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        [(k, int(size), float(want[source])) for k, (source, size) in per.items()], "_src string, source_size long, target double")
    lengths = base.groupBy("_src", "size").agg(F.count(F.lit(1)).alias("n"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf.source_size.iloc[0]), float(pdf.target.iloc[0])
        whole = min(int(target // size), int(cap)) if size else 0
        budget = 0 if whole >= cap else int(round(target - whole * size))
        take = fit(pdf["size"].to_numpy(np.int64), pdf.n.to_numpy(np.int64), budget)
        return pd.DataFrame({"_src": pdf._src, "size": pdf["size"], "source_size": size, "target": target, "whole": whole, "take": take, "n": pdf.n})

    chosen = lengths.join(F.broadcast(plan), "_src").groupBy("_src").applyInPandas(
        choose, "_src string, size long, source_size long, target double, whole long, take long, n long")
    chosen = materialise(chosen)
    rows = base.join(chosen, ["_src", "size"])
    bucket = F.when(F.col("n") > GROUP_ROWS, F.shiftrightunsigned("_r", 64 - BUCKET_BITS)).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("_b", bucket)
    # only lengths taken in part need ranks
    part = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    sure = rows.where(~part).withColumn("_more", (F.col("take") > 0).cast("long"))
    some = rows.where(part)
    order = Window.partitionBy("_src", "size").orderBy("_b")
    before = some.groupBy("_src", "size", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_src", "size", "_b").orderBy("_r", "doc_id", *carry))
    some = some.withColumn("_rank", rank).join(before, ["_src", "size", "_b"])
    some = some.withColumn("_more", (F.col("_before") + F.col("_rank") <= F.col("take")).cast("long"))
    keep = ["doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("_more")).alias("copies"), *carry]
    out = sure.select(*keep).unionByName(some.select(*keep))
    return out.withColumn("taken", F.col("copies") * F.col("size"))
