"""Histogram-sort sharding, in DataFrame operations only.

Rows are ordered by (text hash, id hash); equal texts lie side by side.  Cut points
between shards are found without sorting: each round counts the exact bytes and
rows below candidate boundaries (a histogram over the next bits of the key, summed
on the map side), keeps only the one bucket that holds each cut, and refines it
until the cut is within tolerance.  Then one exchange puts every row in its place.

Equal texts stay in one shard: a cut that falls among them moves to their nearer edge.  Only a
text whose copies hold more than GROUP_SHARE of a shard's bytes, a third of all rows say, is
cut, by the id hash.

Cases: null text counts as the empty text; null ids hash like any value; rows equal
in text and id cannot be told apart and stay together; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Bits refined by a round: the first one looks at all rows, later ones at cut buckets.
FIRST_BITS, NEXT_BITS, KEY_BITS = 12, 8, 63
OVERHEAD = 16
#: A text whose copies hold less of a shard than this is never cut.
GROUP_SHARE = 0.25


def digest(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 1).alias("_k1"),
        F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("_k2"),
    )


class _Cut:
    """One wanted boundary: the key prefix that still holds it and bytes below that."""

    def __init__(self, target: float):
        self.target, self.below = target, 0
        self.k1, self.k2, self.used, self.fixed1 = 0, 0, 0, False
        self.done = False

    def prefix(self) -> tuple:
        return self.fixed1, self.k1, self.k2, self.used


def _digit(fixed1: bool, used: int, bits: int) -> Column:
    key = "_k2" if fixed1 else "_k1"
    return F.shiftright(F.col(key), KEY_BITS - used - bits).bitwiseAND((1 << bits) - 1)


def _within(p: tuple) -> Column:
    fixed1, k1, k2, used = p
    if fixed1:
        low = k2
        return (F.col("_k1") == k1) & F.col("_k2").between(low, low + (1 << (KEY_BITS - used)) - 1)
    return F.col("_k1").between(k1, k1 + (1 << (KEY_BITS - used)) - 1)


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.001) -> list[tuple[int, int]]:
    """The n_shards-1 keys (k1, k2) at which a new shard begins, ascending.

    The driver sees at most (n_shards-1) * 2**NEXT_BITS counts a round."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    cuts = [_Cut(total * (i + 1) / n_shards) for i in range(n_shards - 1)]
    slack, whole = tolerance * total / n_shards, GROUP_SHARE * total / n_shards
    while total and (open_ := [c for c in cuts if not c.done]):
        groups: dict[tuple, list[_Cut]] = {}
        for c in open_:
            groups.setdefault(c.prefix(), []).append(c)
        which, digit, bits_of = F.lit(None).cast("int"), F.lit(None).cast("long"), []
        within_any = F.lit(False)
        for g, p in enumerate(groups):
            bits = min(FIRST_BITS if p[3] == 0 and not p[0] else NEXT_BITS, KEY_BITS - p[3])
            bits_of.append(bits)
            which = F.when(_within(p), F.lit(g)).otherwise(which)
            digit = F.when(_within(p), _digit(p[0], p[3], bits)).otherwise(digit)
            within_any = within_any | _within(p)
        counted = (
            keys.where(within_any).groupBy(which.alias("g"), digit.alias("d"))
            .agg(F.sum("size").alias("bytes"), F.min("_k1").alias("lo1"), F.max("_k1").alias("hi1"),
                 F.min("_k2").alias("lo2"), F.max("_k2").alias("hi2"))
            .collect()
        )
        by: dict[int, list] = {}
        for r in counted:
            by.setdefault(r.g, []).append(r)
        for g, (p, members) in enumerate(groups.items()):
            rows = sorted(by.get(g, []), key=lambda r: r.d)
            for c in members:
                _narrow(c, rows, bits_of[g], slack, whole)
    out = [(c.k1, c.k2) for c in cuts]
    return sorted(out)


def _narrow(c: _Cut, rows: list, bits: int, slack: float, whole: float) -> None:
    fixed1, used = c.fixed1, c.used
    for r in rows:
        if c.below + r.bytes < c.target:
            c.below += r.bytes
            last = r
            continue
        step = KEY_BITS - used - bits
        low = r.d << step
        start = (c.k1, c.k2 | low) if fixed1 else (c.k1 | low, 0)
        near = min(c.target - c.below, c.below + r.bytes - c.target)
        one_text, one_row_key = r.lo1 == r.hi1, r.lo1 == r.hi1 and r.lo2 == r.hi2
        kept = one_text and not fixed1 and r.bytes <= whole  # copies of a text that stay together
        if near <= slack or kept or one_row_key or (fixed1 and step == 0):
            c.done = True
            if c.target - c.below <= c.below + r.bytes - c.target:
                c.k1, c.k2 = start
            elif fixed1:
                c.k1, c.k2 = r.lo1, r.hi2 + 1
            else:
                c.k1, c.k2 = r.hi1 + 1, 0
        elif one_text and not fixed1:
            c.fixed1, c.k1, c.k2, c.used = True, r.lo1, 0, 0
        else:
            c.k1, c.k2 = start
            c.used = used + bits
        return
    # rounding left the target above the last bucket: the cut is at its end
    c.done = True
    if rows:
        c.k1, c.k2 = last.hi1 + 1, 0


def histogram_shards(docs: DataFrame, n_shards: int, tolerance: float = 0.001) -> DataFrame:
    """doc_id, size, text_crc32, shard (0..n-1, near-equal bytes) and slot (0.. in a shard)."""
    keys = materialise(digest(docs))
    cuts = splitters(keys, n_shards, tolerance)
    shard = F.lit(0)
    for a, b in cuts:
        shard = shard + ((F.col("_k1") > a) | ((F.col("_k1") == a) & (F.col("_k2") >= b))).cast("int")
    placed = keys.withColumn("shard", shard if cuts else F.lit(0))
    # Slots: rows before a sub-bucket come from counts, ranks only inside it.  Crowded
    # buckets (at most 1,024 can hold over 4 times the mean) split by the id hash.
    top = F.shiftright("_k1", KEY_BITS - FIRST_BITS)
    sizes = placed.groupBy(top.alias("b")).count()
    mean = F.lit(4.0) * F.sum("count").over(Window.partitionBy(F.lit(1))) / (1 << FIRST_BITS)
    crowded = [r.b for r in sizes.withColumn("m", F.greatest(mean, F.lit(64.0))).where("count > m").select("b").collect()]
    sub = F.when(top.isin(crowded), F.shiftright("_k2", KEY_BITS - 8)).otherwise(F.lit(0)) if crowded else F.lit(0)
    placed = placed.withColumns({"_b": top, "_s": sub.cast("long")})
    counts = placed.groupBy("shard", "_b", "_s").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("shard").orderBy("_b", "_s")
    before = counts.withColumn("_before", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    inner = Window.partitionBy("shard", "_b", "_s").orderBy("_k1", "_k2", "doc_id", "text_crc32")
    return (
        placed.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(before, ["shard", "_b", "_s"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
                (F.col("_before") + F.col("_rn")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
