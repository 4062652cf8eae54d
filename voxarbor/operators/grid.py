"""Voxel grids as rows (x, y, z[, v]): filters, morphology, components, windows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxarbor.functions.coords import FACE6, offsets
from voxarbor.functions.storage import materialise, release

from . import graph

XYZ = ["x", "y", "z"]
#: Bits of a packed voxel key per axis; coordinates are offset to be non-negative.
_BITS, _OFF = 21, 1 << 20


def foreground(voxels: DataFrame, threshold: int | Column, upsample_z: int = 1) -> DataFrame:
    """Voxels strictly above the threshold; each plane repeats upsample_z times."""
    kept = voxels.where(F.col("v") > threshold).select(*XYZ)
    if upsample_z == 1:
        return kept
    return kept.select("x", "y", F.explode(F.sequence(F.col("z") * upsample_z, F.col("z") * upsample_z + upsample_z - 1)).alias("z"))


def clip(voxels: DataFrame, low: tuple[int, int, int], lengths: tuple[int, int, int], extent: tuple[int, int, int]) -> DataFrame:
    """Box from low; a negative length counts back from the end (-1: to the end)."""
    for axis, a, n, e in zip(XYZ, low, lengths, extent, strict=True):
        n = e - a + n + 1 if n < 0 else n
        voxels = voxels.where((F.col(axis) >= a) & (F.col(axis) < min(a + n, e)))
    return voxels


def shift(mask: DataFrame, cells: list[tuple[int, int, int]]) -> DataFrame:
    """Every voxel at every offset, with repeats."""
    return mask.select(*XYZ, F.explode(offsets(cells)).alias("d")).select(*((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in XYZ))


def dilate(mask: DataFrame, steps: int = 1, cells=None) -> DataFrame:
    for _ in range(steps):
        mask = shift(mask, [(0, 0, 0), *(cells or FACE6)]).distinct()
    return mask


def erode(mask: DataFrame, steps: int = 1, cells=None) -> DataFrame:
    """Voxels all of whose neighbours are active: one grouped count a step, no join."""
    cells = cells or FACE6
    for _ in range(steps):
        spread = mask.select(*XYZ, F.explode(offsets([(0, 0, 0), *cells])).alias("d"))
        own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0) & (F.col("d.dz") == 0)
        spread = spread.select(*((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in XYZ), own.cast("int").alias("own"))
        mask = spread.groupBy(*XYZ).agg(F.max("own").alias("own"), F.count(F.lit(1)).alias("n")).where((F.col("own") == 1) & (F.col("n") == len(cells) + 1)).select(*XYZ)
    return mask


def opened(mask: DataFrame, steps: int) -> DataFrame:
    return dilate(erode(mask, steps), steps)


def closed(mask: DataFrame, steps: int) -> DataFrame:
    return erode(dilate(mask, steps), steps)


def key(x: Column, y: Column, z: Column) -> Column:
    """One long for a voxel, ordered by z, y, x."""
    k = F.shiftleft(z.cast("long") + _OFF, 2 * _BITS)
    return k + F.shiftleft(y.cast("long") + _OFF, _BITS) + (x.cast("long") + _OFF)


def key_of(x, y, z):
    """The same key of numpy integers."""
    return ((z + _OFF) << 2 * _BITS) + ((y + _OFF) << _BITS) + (x + _OFF)


def keyed(mask: DataFrame) -> DataFrame:
    return mask.withColumn("id", key(*(F.col(a) for a in XYZ)))


def neighbour_edges(mask: DataFrame, cells=None) -> DataFrame:
    """(src, dst) between active neighbours, src each voxel; pass half of a symmetric stencil
    to have each pair once."""
    spread = mask.select(key(*(F.col(a) for a in XYZ)).alias("src"), *XYZ, F.explode(offsets(cells or FACE6)).alias("d"))
    moved = spread.select("src", key(*(F.col(a) + F.col(f"d.d{a}") for a in XYZ)).alias("dst"))
    return moved.join(keyed(mask).select(F.col("id").alias("dst")), "dst", "left_semi")


def half(cells) -> list[tuple[int, int, int]]:
    return [c for c in cells if c > (0, 0, 0)]


def stencil(connectivity: int) -> list[tuple[int, int, int]]:
    most = {6: 1, 18: 2, 26: 3}[connectivity]
    span = (-1, 0, 1)
    return [(i, j, k) for i in span for j in span for k in span if 0 < abs(i) + abs(j) + abs(k) <= most]


def label(mask: DataFrame, connectivity: int = 6) -> DataFrame:
    """x, y, z, comp: comp is the smallest packed key of the component."""
    mask = materialise(keyed(mask))
    found = graph.components(mask.select("id"), neighbour_edges(mask, half(stencil(connectivity))))
    return mask.join(found, "id").select(*XYZ, "comp")


def summary(labels: DataFrame) -> DataFrame:
    """Per component: size, inclusive bounds, box volume, depth, truncated mean position."""
    bounds = [f(a).alias(f"{n}_{a}") for a in XYZ for f, n in ((F.min, "min"), (F.max, "max"))]
    out = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("voxels"), *bounds, *(F.floor(F.sum(a) / F.count(F.lit(1))).cast("int").alias(f"mean_{a}") for a in XYZ))
    side = [F.col(f"max_{a}") - F.col(f"min_{a}") + 1 for a in XYZ]
    return out.withColumn("box_volume", (side[0].cast("long") * side[1] * side[2])).withColumn("depth", side[2])


#: Edge of the cubes in which levels are worked out by one task.
LEVEL_BLOCK = 32
_FAR = 1 << 30


def _relax(pdf: pd.DataFrame) -> pd.DataFrame:
    """Levels of one block's voxels from those known and those that arrive, one level's voxels
    at a time."""
    arrives, side = pdf.arrives.to_numpy(), LEVEL_BLOCK + 2  # an empty rim all around
    at = [pdf[a].to_numpy() - LEVEL_BLOCK * int(pdf[f"b{a}"].iloc[0]) + 1 for a in XYZ]
    cell = (at[0] * side + at[1]) * side + at[2]
    given = pdf.level.fillna(_FAR).to_numpy().astype(np.int64)
    on, level = np.zeros(side**3, dtype=bool), np.full(side**3, _FAR, dtype=np.int64)
    on[cell[~arrives]] = True
    level[cell[~arrives]] = given[~arrives]
    come, when = cell[arrives], given[arrives]
    better = on[come] & (when < level[come])
    come, when = come[better], when[better]
    np.minimum.at(level, come, when)
    waiting = {int(n): come[when == n] for n in np.unique(when)}
    steps = np.array([side * side, -side * side, side, -side, 1, -1])
    n, front = 0, np.zeros(0, dtype=np.int64)
    while waiting or len(front):
        n = n + 1 if len(front) else min(waiting)
        new = waiting.pop(n, front[:0])
        front = np.union1d(front, new[level[new] == n])
        near = (front[:, None] + steps).ravel()
        near = np.unique(near[on[near] & (level[near] > n + 1)])
        level[near] = n + 1
        front = near
    out = pdf.loc[~arrives, [*XYZ, "bx", "by", "bz"]].copy()
    found = level[cell[~arrives]]
    out["level"] = pd.array(np.where(found < _FAR, found, 0), dtype="Int32")
    out.loc[found == _FAR, "level"] = pd.NA
    out["changed"] = found < given[~arrives]
    return out


def block_levels(mask: DataFrame, start: DataFrame) -> DataFrame:
    """x, y, z, level: hops inside the mask from the nearest start voxel; unreached ones are
    left out.  Blocks of LEVEL_BLOCK cubed expand to their faces in one task each; a round
    exchanges what crosses a face, so rounds follow the blocks a path crosses, not its hops."""
    block = {f"b{a}": F.floor(F.col(a) / LEVEL_BLOCK).cast("int") for a in XYZ}
    cells = [F.col(a).cast("int").alias(a) for a in XYZ]
    by, none = list(block), F.lit(None).cast("int")
    state = materialise(mask.select(*cells).distinct().withColumns(block).withColumn("level", none))
    arrivals = start.select(*cells).distinct().withColumn("level", F.lit(0)).withColumns(block)
    arrivals = materialise(arrivals.join(state.select(*XYZ), XYZ, "left_semi"))
    columns = [*XYZ, *by, "level"]
    while not arrivals.isEmpty():
        active = arrivals.select(*by).distinct()
        work = state.join(active, by, "left_semi").select(*columns).withColumn("arrives", F.lit(False))
        work = work.unionByName(arrivals.select(*columns).withColumn("arrives", F.lit(True)))
        done = materialise(work.groupBy(*by).applyInPandas(_relax, ", ".join(f"{c} int" for c in columns) + ", changed boolean"))
        before, state = state, materialise(state.join(active, by, "left_anti").select(*columns).unionByName(done.select(*columns)))
        rim = F.lit(False)
        for a in XYZ:
            rim = rim | F.pmod(F.col(a), F.lit(LEVEL_BLOCK)).isin(0, LEVEL_BLOCK - 1)
        out = done.where("changed").where(rim).select(*XYZ, *by, (F.col("level") + 1).alias("level"), F.explode(offsets(FACE6)).alias("d"))
        out = out.select(*(F.col(f"b{a}").alias(f"o{a}") for a in XYZ), *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in XYZ), "level").withColumns(block)
        other = F.lit(False)
        for a in XYZ:
            other = other | (F.col(f"b{a}") != F.col(f"o{a}"))
        out = out.where(other).groupBy(*XYZ, *by).agg(F.min("level").alias("level"))
        known = state.select(*XYZ, F.col("level").alias("known"))
        nxt = materialise(out.join(known, XYZ).where("known IS NULL OR known > level").select(*columns))
        release(before, done, arrivals)
        arrivals = nxt
    return state.where("level IS NOT NULL").select(*XYZ, "level")


def reachable(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """x, y, z, level: active voxels connected to a seed voxel and their hops from it."""
    return block_levels(mask, seeds)


def revisits(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: voxels reached from the seeds and how often one was looked at again."""
    reach = materialise(keyed(reachable(mask, seeds).select(*XYZ)))
    start = reach.join(seeds.select(*XYZ).distinct(), XYZ, "left_semi").agg(F.count(F.lit(1)).alias("starts"))
    looks = neighbour_edges(reach).agg(F.count(F.lit(1)).alias("looks"))
    return reach.agg(F.count(F.lit(1)).alias("reached")).crossJoin(start).crossJoin(looks).select(
        "reached", (F.col("looks") - F.col("reached") + F.col("starts")).alias("revisits"))


def surface(mask: DataFrame) -> DataFrame:
    """Active voxels with a background neighbour."""
    return mask.join(erode(mask), XYZ, "left_anti")


def depth_from_surface(mask: DataFrame) -> DataFrame:
    """x, y, z, radius: 1 on the surface, one more for each hop inward."""
    found = reachable(mask, surface(mask))
    return found.select(*XYZ, (F.col("level") + 1).alias("radius"))


def balls(centres: DataFrame, radius: str = "radius") -> DataFrame:
    """centre columns plus the voxels (vx, vy, vz) in each ball of its radius; each axis is
    spread over what the ones before have left of the squared radius."""
    out, left = centres, F.col(radius) * F.col(radius)
    for a in XYZ:
        n = F.floor(F.sqrt(F.greatest(left, F.lit(0)).cast("double"))).cast("int")
        out = out.withColumn(f"_{a}", F.explode(F.sequence(-n, n)))
        left = left - F.col(f"_{a}") * F.col(f"_{a}")
    return out.where(left >= 0).select(*centres.columns, *((F.col(a) + F.col(f"_{a}")).alias(f"v{a}") for a in XYZ))


def boxes(centres: DataFrame, half: Column) -> DataFrame:
    """centre columns plus the voxels (vx, vy, vz) of the cube of that half side around each,
    one axis after the other."""
    out = centres.withColumn("_n", half.cast("int"))
    for a in XYZ:
        out = out.withColumn("_d", F.explode(F.sequence(-F.col("_n"), F.col("_n")))).withColumn(f"v{a}", F.col(a) + F.col("_d"))
    return out.drop("_n", "_d")


def fill_balls(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    inside = balls(seeds).select(*(F.col(f"v{a}").alias(a) for a in XYZ))
    return mask.select(*XYZ).unionByName(inside).distinct()


def paint(image: DataFrame, region: DataFrame, value: int) -> DataFrame:
    """Image with every voxel of the region set to a value."""
    over = region.select(*XYZ).distinct().withColumn("v", F.lit(value))
    return image.select(*XYZ, "v").join(over.select(*XYZ), XYZ, "left_anti").unionByName(over)


def faces(mask: DataFrame) -> DataFrame:
    """Exposed faces of the mask: the voxel and the side (dx, dy, dz) that is open."""
    spread = mask.select(*XYZ, F.explode(offsets(FACE6)).alias("d")).select(*XYZ, "d.*")
    other = mask.select(*(F.col(a).alias(f"n{a}") for a in XYZ))
    on = [F.col(a) + F.col(f"d{a}") == F.col(f"n{a}") for a in XYZ]
    return spread.join(other, on, "left_anti")


def quads(mask: DataFrame) -> DataFrame:
    """Surface of the mask as quads: four corner keys in order around each exposed face."""
    f = faces(mask)
    axis = F.when(F.col("dx") != 0, 0).when(F.col("dy") != 0, 1).otherwise(2)
    far = [F.col(a) + (F.col(f"d{a}") > 0).cast("int") for a in XYZ]
    corners = []
    for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)):
        on = [(far[0], F.col("y") + i, F.col("z") + j), (F.col("x") + i, far[1], F.col("z") + j), (F.col("x") + i, F.col("y") + j, far[2])]
        pick = [F.when(axis == 0, on[0][k]).when(axis == 1, on[1][k]).otherwise(on[2][k]) for k in range(3)]
        corners.append(key(*pick))
    return f.select(*XYZ, "dx", "dy", "dz", F.array(*corners).alias("v"))


def quad_edges(q: DataFrame) -> DataFrame:
    """The undirected edges of quads, both diagonals included."""
    pairs = [(0, 1), (1, 2), (2, 3), (3, 0), (0, 2), (1, 3)]
    v = F.col("v")
    e = F.array(*(F.struct(F.least(v[a], v[b]).alias("src"), F.greatest(v[a], v[b]).alias("dst")) for a, b in pairs))
    return q.select(F.explode(e).alias("e")).select("e.*").distinct()


def triangles(q: DataFrame) -> DataFrame:
    v = F.col("v")
    return q.select(F.explode(F.array(F.array(v[0], v[1], v[2]), F.array(v[0], v[2], v[3]))).alias("t")).select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))


def connected_attributes(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """x, y, z, level, surface and the offset (px, py, pz) to the parent: the smallest active
    neighbour one hop nearer to a seed (zero at seeds)."""
    reach = materialise(reachable(mask, seeds))
    spread = reach.select(*XYZ, "level", F.explode(offsets(FACE6)).alias("d"))
    near = spread.select(*((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in XYZ), (F.col("level") + 1).alias("level"), F.struct(*((-F.col(f"d.d{a}")).alias(f"p{a}") for a in XYZ)).alias("p"))
    parent = reach.select(*XYZ, "level").join(near, [*XYZ, "level"]).groupBy(*XYZ).agg(F.min("p").alias("p"))
    edge = surface(mask).withColumn("surface", F.lit(True))
    out = reach.join(parent, XYZ, "left").join(edge, XYZ, "left")
    return out.select(*XYZ, "level", F.coalesce("surface", F.lit(False)).alias("surface"), *(F.coalesce(F.col(f"p.p{a}"), F.lit(0)).alias(f"p{a}") for a in XYZ))


def morphology_steps(voxel_um: float, has_seeds: bool) -> dict[str, int]:
    """Closing, opening, smoothing and coarsening steps for a voxel edge in micrometres."""
    close = 7 / voxel_um if not has_seeds else max(1, int(1.5 / voxel_um + 0.5))
    coarsen = 0 if voxel_um >= 1 else int(0.75 / voxel_um + 0.5)
    return {"close": int(close), "open": int(5 / voxel_um), "smooth": max(0, int(4.33333 - 3.33333 * voxel_um)), "coarsen": coarsen}


def cluster_bounds(labels: DataFrame, somas: DataFrame, orphans: bool = False) -> DataFrame:
    """Per component: half-open bounds, voxels and its somas; components without one only on
    request."""
    box = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("voxels"), *(x for a in XYZ for x in (F.min(a).alias(f"{a}min"), (F.max(a) + 1).alias(f"{a}max"))))
    held = labels.join(somas, XYZ).groupBy("comp").agg(F.array_sort(F.collect_list("seed_id")).alias("somas"))
    return box.join(held, "comp", "left" if orphans else "inner")


def windows(component: DataFrame, seeds: DataFrame, least: float, expand: float, voxel: tuple[float, float, float]) -> DataFrame:
    """Per component: its inclusive bounds grown to its seeds by (least + radius + expand) /
    voxel along each axis."""
    grown = seeds.groupBy("comp").agg(*(x for a, s in zip(XYZ, voxel, strict=True) for r in [F.floor((F.lit(least + expand) + F.col("radius")) / F.lit(s)).cast("int")]
                                        for x in (F.min(F.col(a) - r).alias(f"s_min_{a}"), F.max(F.col(a) + r).alias(f"s_max_{a}"))))
    j = component.join(grown, "comp")
    return j.select("comp", *(x for a in XYZ for x in (F.least(f"min_{a}", f"s_min_{a}").alias(f"min_{a}"), F.greatest(f"max_{a}", f"s_max_{a}").alias(f"max_{a}"))))


def hop_balls(centres: DataFrame, radius: str = "radius") -> DataFrame:
    """centre columns plus the voxels (vx, vy, vz) within so many face hops; each axis is spread
    over what the ones before have left of the radius."""
    out, left = centres, F.floor(F.col(radius)).cast("int")
    for a in XYZ:
        out = out.withColumn(f"_{a}", F.explode(F.sequence(-left, left)))
        left = left - F.abs(F.col(f"_{a}"))
    return out.select(*centres.columns, *((F.col(a) + F.col(f"_{a}")).alias(f"v{a}") for a in XYZ))


def polygon_quads(polygons: DataFrame) -> DataFrame:
    """Each polygon (v: 4, 6 or 8 corners in order) as quads (k, quad); other sizes raise."""
    cut = {4: [(0, 1, 2, 3)], 6: [(0, 1, 2, 3), (0, 3, 4, 5)], 8: [(0, 1, 2, 3), (3, 4, 7, 0), (4, 5, 6, 7)]}
    v = F.col("v")
    quads = F.raise_error(F.lit("polygons of 4, 6 or 8 corners only")).cast("array<array<bigint>>")
    for n, parts in cut.items():
        quads = F.when(F.size(v) == n, F.array(*(F.array(*(v[i].cast("long") for i in q)) for q in parts))).otherwise(quads)
    return polygons.select("*", F.posexplode(quads).alias("k", "quad"))


def scaled_patches(image: DataFrame, centres: DataFrame, side: int, scales: tuple[int, ...]) -> DataFrame:
    """centre columns, scale and the cells (i, j, v) of a square patch in the centre's plane,
    every scale-th pixel; v is null beyond the image."""
    span = F.sequence(F.lit(0), F.lit(side - 1))
    cells = centres.withColumn("scale", F.explode(F.array(*map(F.lit, scales)))).withColumn("i", F.explode(span)).withColumn("j", F.explode(span))
    at = {"x": F.col("x") + (F.col("i") - side // 2) * F.col("scale"), "y": F.col("y") + (F.col("j") - side // 2) * F.col("scale")}
    return cells.withColumns(at).join(image.select(*XYZ, "v"), XYZ, "left")


def signed_hops(mask: DataFrame, band: int) -> DataFrame:
    """x, y, z, sdf: signed distance in face hops to the skin of the mask, which lies half a hop
    outside its outermost voxels: negative at every voxel of the mask, positive at those up
    to `band` hops away from it."""
    mask = materialise(mask.select(*XYZ).distinct())
    skin = surface(mask).select(*(F.col(a).alias(f"s{a}") for a in XYZ), *XYZ, F.lit(band).alias("r"))
    hops = sum(F.abs(F.col(f"v{a}") - F.col(f"s{a}")) for a in XYZ)
    ring = hop_balls(skin, "r").groupBy(*(F.col(f"v{a}").alias(a) for a in XYZ)).agg((F.min(hops) - 0.5).alias("sdf"))
    inside = depth_from_surface(mask).select(*XYZ, (0.5 - F.col("radius")).alias("sdf"))
    return inside.unionByName(ring.join(mask, XYZ, "left_anti"))


def ball_field(centres: DataFrame) -> DataFrame:
    """x, y, z, sdf: distance to the nearest sphere's skin at every voxel in a ball."""
    d = F.sqrt(sum((F.col(f"v{a}") - F.col(a)) * (F.col(f"v{a}") - F.col(a)) for a in XYZ).cast("double"))
    return balls(centres).groupBy(*(F.col(f"v{a}").alias(a) for a in XYZ)).agg(F.min(d - F.col("radius")).alias("sdf"))


def interior(field: DataFrame) -> DataFrame:
    """The voxels strictly inside a signed distance field."""
    return field.where("sdf < 0").select(*XYZ)


def coverage_prune(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """x, y, z, radius of the voxels kept: roots first, then by falling radius (then key), a
    voxel is kept unless a kept one has it within its radius in face hops; roots always stay.
    Rounds instead of one sequence: a voxel is kept once all that could cover it and come
    before it have gone, and goes once one of them is kept."""
    n = keyed(nodes.select(*XYZ, F.col("radius").cast("int").alias("radius")))
    n = materialise(n.join(roots.select(*XYZ).distinct().withColumn("root", F.lit(True)), XYZ, "left").withColumn("root", F.coalesce("root", F.lit(False))))
    rank = lambda: F.struct("root", "radius", -F.col("id"))
    cover = hop_balls(n.select(F.col("id").alias("u"), rank().alias("ru"), *XYZ, "radius")).select("u", "ru", key(*(F.col(f"v{a}") for a in XYZ)).alias("v"))
    low = n.where("NOT root").select(F.col("id").alias("v"), rank().alias("rv"))
    covers = materialise(cover.join(low, "v").where("ru > rv").select("u", "v"))
    open_, kept = materialise(n.select("id")), None
    while not open_.isEmpty():
        won = materialise(open_.join(covers.select(F.col("v").alias("id")).distinct(), "id", "left_anti"))
        lost = covers.join(won.select(F.col("id").alias("u")), "u", "left_semi").select(F.col("v").alias("id"))
        settled = materialise(won.unionByName(lost.distinct()))
        rest = covers.join(settled.select(F.col("id").alias("u")), "u", "left_anti")
        rest = materialise(rest.join(settled.select(F.col("id").alias("v")), "v", "left_anti").select("u", "v"))
        left = materialise(open_.join(settled, "id", "left_anti"))
        both = won if kept is None else materialise(kept.unionByName(won))
        release(covers, open_, settled, *([] if kept is None else [kept, won]))
        covers, open_, kept = rest, left, both
    return n.select(*XYZ, "radius") if kept is None else n.join(kept, "id", "left_semi").select(*XYZ, "radius")


def in_windows(voxels: DataFrame, windows: DataFrame, tile: int = 64) -> DataFrame:
    """Voxels with each window (window, min_x .. max_z, bounds inclusive) that holds them; the two
    meet on tiles, so no voxel looks at a window elsewhere."""
    w = windows.select("window", *(f"{m}_{a}" for a in XYZ for m in ("min", "max")))
    for a in XYZ:
        w = w.withColumn(f"_{a}", F.explode(F.sequence(F.floor(F.col(f"min_{a}") / tile), F.floor(F.col(f"max_{a}") / tile))))
    v = voxels.withColumns({f"_{a}": F.floor(F.col(a) / tile) for a in XYZ})
    j = v.join(w, [f"_{a}" for a in XYZ])
    for a in XYZ:
        j = j.where(F.col(a).between(F.col(f"min_{a}"), F.col(f"max_{a}")))
    return j.select("window", *(f"{m}_{a}" for a in XYZ for m in ("min", "max")), *voxels.columns)
