"""Range, nearest and best-of-ball joins of point tables by grid buckets.

Both sides get a cell of the search radius; one side is repeated to the 27 cells around.
The join is an equi-join on the cell, so it shuffles by cell and never compares all pairs.

`nearest` and `reached` need one point in reach, not all: they look through small cells first
and widen the search for the points that have found none.  Once a pass finds few, the others go
down from large cells to small ones and leave out what is too far as a whole.  The planner takes a repeated
side for as small as its source and would broadcast it; their joins are hinted to shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxarbor.functions.storage import materialise

XYZ = ("x", "y", "z")
#: Right points in an occupied cell, on average, above which smaller cells are looked through
#: first, and how often a cell may be quartered; the share of its points that a pass must find
#: for the next one to widen the search.
FULL_CELL, QUARTERINGS, FOUND = 2.0, 6, 0.25


def within(left: DataFrame, right: DataFrame, radius: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """Pairs of left(a, x, y, z) and right(b, x, y, z) at distance radius or less: a, b, d2."""
    cell = lambda axis, s: F.floor(F.col(axis) * F.lit(s) / F.lit(radius)).cast("long")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    l = left.select("a", *(F.col(c).alias(f"l{c}") for c in XYZ), *(cell(c, s).alias(f"c{c}") for c, s in zip(XYZ, scale, strict=True)))
    r = right.select("b", *(F.col(c).alias(f"r{c}") for c in XYZ), *(cell(c, s).alias(f"c{c}") for c, s in zip(XYZ, scale, strict=True)))
    for c in XYZ:
        r = r.withColumn("_o", F.explode(around)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("_o")).drop("_o")
    joined = l.join(r, [f"c{c}" for c in XYZ])
    d2 = sum(((F.col(f"l{c}") - F.col(f"r{c}")) * F.lit(s)) * ((F.col(f"l{c}") - F.col(f"r{c}")) * F.lit(s)) for c, s in zip(XYZ, scale, strict=True))
    return joined.withColumn("d2", d2.cast("double")).where(F.col("d2") <= radius * radius).select("a", "b", "d2")


def best(pairs: DataFrame, *order: Column | str) -> DataFrame:
    """The first pair of each a in the given order."""
    rank = F.row_number().over(Window.partitionBy("a").orderBy(*order))
    return pairs.withColumn("_r", rank).where("_r = 1").drop("_r")


def _cells(side: str, radius: float, scale) -> list[Column]:
    return [F.floor(F.col(f"{side}{c}") * F.lit(s) / F.lit(radius)).cast("long").alias(f"c{c}") for c, s in zip(XYZ, scale, strict=True)]


def _d2(scale) -> Column:
    return sum(((F.col(f"l{c}") - F.col(f"r{c}")) * F.lit(s)) * ((F.col(f"l{c}") - F.col(f"r{c}")) * F.lit(s)) for c, s in zip(XYZ, scale, strict=True)).cast("double")


def _places(points: DataFrame, side: str, *aggs: Column) -> DataFrame:
    """One row a place, as columns <side>x, <side>y, <side>z; points without a place go."""
    named = points.dropna(subset=list(XYZ)).withColumnsRenamed({c: f"{side}{c}" for c in XYZ})
    at = named.groupBy(*(f"{side}{c}" for c in XYZ))
    return materialise(at.agg(*aggs) if aggs else at.agg(F.lit(0).alias("_n")).drop("_n"))


def _meet(left: DataFrame, right: DataFrame, radius: float, scale, repeat_left: bool) -> tuple[DataFrame, list[str]]:
    """Pairs of places at distance radius or less with their d2, and the columns by which those
    of one left place lie together: its cell too, unless the left side is repeated."""
    cell = [f"c{c}" for c in XYZ]
    l, r = left.select("*", *_cells("l", radius, scale)), right.select("*", *_cells("r", radius, scale))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    for c in cell:
        if repeat_left:
            l = l.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
        else:
            r = r.withColumn("_o", F.explode(around)).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    joined = l.join(r.hint("shuffle_hash"), cell) if repeat_left else r.join(l.hint("shuffle_hash"), cell)
    own = [f"l{c}" for c in XYZ]
    return joined.withColumn("d2", _d2(scale)).where(F.col("d2") <= radius * radius), own if repeat_left else [*cell, *own]


def _first_found(left: DataFrame, right: DataFrame, radius: float, scale, first: Column) -> DataFrame:
    """(a, first): the aggregate `first` over the places of right (with b, the smallest id there)
    near left's place: at least over those that are nearest within the radius."""
    places = _places(right, "r", F.min("b").alias("b"))
    seen = places.agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.xxhash64(*_cells("r", radius / 4**k, scale))) for k in range(QUARTERINGS + 1))).first()
    depth = next((k for k in range(QUARTERINGS + 1) if seen[0] <= FULL_CELL * seen[k + 1]), QUARTERINGS)
    own = [f"l{c}" for c in XYZ]
    open_ = _places(left, "l")
    n, halved, found = open_.count(), 2 * depth, []
    while True:
        pairs, by = _meet(open_, places, radius / 2**halved, scale, n < seen[0])
        best = pairs.groupBy(*by).agg(first.alias("first")).select(*own, "first")
        now = materialise(open_.join(best.hint("shuffle_hash"), own, "left"))
        found.append(now.where("first IS NOT NULL"))
        open_ = now.where("first IS NULL").drop("first")
        hits = now.agg(F.count("first")).first()[0]
        if not halved or hits == n:
            break
        if hits < FOUND * n:
            found.append(_descend(open_, places, radius, scale, depth, first))
            break
        n, halved = n - hits, halved - 1
    at = reduce(DataFrame.unionByName, found)
    return left.select("a", *(F.col(c).alias(f"l{c}") for c in XYZ)).join(at.hint("shuffle_hash"), own).select("a", "first")


def _descend(left: DataFrame, places: DataFrame, radius: float, scale, depth: int, first: Column) -> DataFrame:
    """(lx, ly, lz, first): `first` over the places that are nearest within the radius to each place
    of left.  From cells of the radius each step goes to those of a quarter; a cell stays if the
    box around its places is not farther than the far corner of another one's."""
    cell, own = [f"c{c}" for c in XYZ], [f"l{c}" for c in XYZ]
    box = [f"{m}{c}" for m in ("low", "high") for c in XYZ]
    fine = _cells("r", radius / 4**depth, scale)
    up = [F.shiftright(c, 2) for c in cell]
    corners = lambda of: [getattr(F, m)(of(m, c)).alias(n) for (m, c), n in zip(((m, c) for m in ("min", "max") for c in XYZ), box, strict=True)]
    levels = [materialise(places.groupBy(*fine).agg(*corners(lambda m, c: F.col(f"r{c}").cast("double"))))]
    for _ in range(depth):
        coarse = levels[-1].groupBy(*(u.alias(c) for u, c in zip(up, cell, strict=True))).agg(*corners(lambda m, c: F.col(f"{'low' if m == 'min' else 'high'}{c}")))
        levels.append(coarse)
    now = left.select("*", *_cells("l", radius, scale))
    for c in cell:
        now = now.withColumn("_o", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))).withColumn(c, F.col(c) + F.col("_o")).drop("_o")
    square = lambda gap: sum(gap(c) * F.lit(s) * (gap(c) * F.lit(s)) for c, s in zip(XYZ, scale, strict=True))
    x = lambda c: F.col(f"l{c}").cast("double")
    near = square(lambda c: F.greatest(F.col(f"low{c}") - x(c), x(c) - F.col(f"high{c}"), F.lit(0.0)))
    far = square(lambda c: F.greatest(F.col(f"high{c}") - x(c), x(c) - F.col(f"low{c}")))
    for k, level in enumerate(reversed(levels)):
        if k:
            of = [f"u{c}" for c in cell]
            level = level.withColumns(dict(zip(of, up, strict=True)))
            now = now.withColumnsRenamed(dict(zip(cell, of, strict=True)))
        else:
            of = cell
        met = now.join(level.hint("shuffle_hash"), of).select(*own, *cell, near.alias("near"), far.alias("far")).where(F.col("near") <= radius * radius * (1 + 1e-9))
        least = F.min("far").over(Window.partitionBy(*own))
        now = met.withColumn("least", least).where(F.col("near") <= F.col("least") * (1 + 1e-9)).select(*own, *cell)
    met = now.join(places.select("*", *fine).hint("shuffle_hash"), cell)
    return met.withColumn("d2", _d2(scale)).where(F.col("d2") <= radius * radius).groupBy(*own).agg(first.alias("first"))


def nearest(left: DataFrame, right: DataFrame, radius: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """For each a with one in reach, the nearest b (ties: smallest b)."""
    found = _first_found(left, right, radius, scale, F.min(F.struct("d2", "b")))
    return best(found.select("a", "first.b", "first.d2"), "d2", "b")


def reached(left: DataFrame, right: DataFrame, radius: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """The a that have a point of right in reach, each once."""
    return _first_found(left, right, radius, scale, F.min("d2")).select("a").distinct()


def smallest(left: DataFrame, right: DataFrame, radius: float, scale=(1.0, 1.0, 1.0)) -> DataFrame:
    """For each a with one in reach, the smallest b: (a, b).  Places are compared, so copies of a
    place cost nothing."""
    spots, places = _places(left, "l"), _places(right, "r", F.min("b").alias("b"))
    pairs, by = _meet(spots, places, radius, scale, spots.count() < places.count())
    own = [f"l{c}" for c in XYZ]
    at = pairs.groupBy(*by).agg(F.min("b").alias("b")).select(*own, "b")
    return left.select("a", *(F.col(c).alias(f"l{c}") for c in XYZ)).join(at.hint("shuffle_hash"), own).groupBy("a").agg(F.min("b").alias("b"))


def mutual_nearest(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs that are each other's nearest."""
    ab = materialise(nearest(left, right, radius))
    ba = nearest(right.join(ab.select("b").distinct().hint("shuffle_hash"), "b", "left_semi").withColumnRenamed("b", "a"), left.withColumnRenamed("a", "b"), radius)
    return ab.join(ba.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
