"""Tracing on volumes and trees: weighted marching, radii, skeletons, segments, pruning."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxarbor.functions.coords import offsets
from voxarbor.functions.storage import materialise, release

from . import graph, grid, matching, trees

XYZ = ("x", "y", "z")


def _settle(connectivity: int):
    """The function that settles one block: its voxels take what arrives and offer it on, all
    cells that fell at once, until none falls any more."""
    cells, size = np.array(grid.stencil(connectivity)), grid.LEVEL_BLOCK
    side, lengths = size + 2, np.sqrt((cells * cells).sum(1))  # an empty rim all around
    steps = (cells[:, 0] * side + cells[:, 1]) * side + cells[:, 2]

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        base = [size * int(pdf[f"b{a}"].iloc[0]) - 1 for a in XYZ]
        at = [pdf[a].to_numpy(np.int64) - b for a, b in zip(XYZ, base, strict=True)]
        cell, new = (at[0] * side + at[1]) * side + at[2], pdf.arrives.to_numpy()
        own = cell[~new]
        w, cost, parent = np.full(side**3, np.nan), np.full(side**3, np.inf), np.full(side**3, -1)
        w[own], cost[own], parent[own] = pdf.w[~new], pdf.cost[~new], pdf.parent[~new]
        before = cost[own]
        to, offer, src = cell[new], pdf.cost.to_numpy()[new], pdf.parent.to_numpy()[new]
        while len(to):
            order = np.lexsort((src, offer, to))
            to, offer, src = to[order], offer[order], src[order]
            take = np.append(True, to[1:] != to[:-1]) & (offer < cost[to] - 1e-12)
            to, offer, src = to[take], offer[take], src[take]
            cost[to], parent[to] = offer, src
            x, y, z = to // (side * side) + base[0], to // side % side + base[1], to % side + base[2]
            near = to[:, None] + steps
            give = offer[:, None] + (w[to][:, None] + w[near]) / 2 * lengths
            falls = give < cost[near] - 1e-12  # false beyond the block and where no voxel is
            src = np.broadcast_to(grid.key_of(x, y, z)[:, None], near.shape)[falls]
            to, offer = near[falls], give[falls]
        out = pdf.loc[~new, [*XYZ, "bx", "by", "bz", "w"]].copy()
        out["cost"], out["parent"], out["changed"] = cost[own], parent[own], cost[own] < before
        return out

    return settle


def march(voxels: DataFrame, seeds: DataFrame, weight, connectivity: int = 6) -> DataFrame:
    """(id, cost, parent): cheapest path cost from any seed over active voxels; a step costs the
    mean weight of its ends times its length.  Blocks settle in one task each, and a round
    exchanges the offers that cross a face, an edge or a corner: rounds follow the blocks on
    a path, not its steps."""
    block = {f"b{a}": F.floor(F.col(a) / grid.LEVEL_BLOCK).cast("int") for a in XYZ}
    by, far, none = list(block), F.lit(float("inf")), F.lit(-1).cast("long")
    columns = [*XYZ, *by, "w", "cost", "parent"]
    schema = ", ".join(f"{c} int" for c in (*XYZ, *by)) + ", w double, cost double, parent long, changed boolean"
    v = voxels.select(*(F.col(a).cast("int").alias(a) for a in XYZ), weight.cast("double").alias("w"))
    state = materialise(v.withColumns({**block, "cost": far, "parent": none}).select(*columns))
    start = seeds.select(*XYZ).distinct()
    arrivals = materialise(state.join(start, list(XYZ), "left_semi").withColumn("cost", F.lit(0.0)).select(*columns))
    while not arrivals.isEmpty():
        active = arrivals.select(*by).distinct()
        work = state.join(active, by, "left_semi").withColumn("arrives", F.lit(False))
        work = work.unionByName(arrivals.withColumn("arrives", F.lit(True)))
        done = materialise(work.groupBy(*by).applyInPandas(_settle(connectivity), schema))
        before, state = state, materialise(state.join(active, by, "left_anti").select(*columns).unionByName(done.select(*columns)))
        rim = F.lit(False)
        for a in XYZ:
            rim = rim | F.pmod(F.col(a), F.lit(grid.LEVEL_BLOCK)).isin(0, grid.LEVEL_BLOCK - 1)
        out = done.where("changed").where(rim).withColumn("d", F.explode(offsets(grid.stencil(connectivity))))
        length = F.sqrt(sum(F.col(f"d.d{a}") * F.col(f"d.d{a}") for a in XYZ).cast("double"))
        out = out.select(
            *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in XYZ), *(F.col(f"b{a}").alias(f"o{a}") for a in XYZ),
            F.col("w").alias("ow"), F.col("cost").alias("o"), grid.key(*(F.col(a) for a in XYZ)).alias("src"), length.alias("length"))
        other = F.lit(False)
        for a in XYZ:
            other = other | (F.floor(F.col(a) / grid.LEVEL_BLOCK) != F.col(f"o{a}"))
        offer = out.where(other).join(state, list(XYZ)).withColumn("o", F.col("o") + (F.col("ow") + F.col("w")) / 2 * F.col("length"))
        offer = offer.where(F.col("o") < F.col("cost") - 1e-12).groupBy(*XYZ, *by).agg(F.min(F.struct("o", "src")).alias("o"))
        nxt = materialise(offer.select(*XYZ, *by, F.lit(0.0).alias("w"), F.col("o.o").alias("cost"), F.col("o.src").alias("parent")))
        release(before, done, arrivals)
        arrivals = nxt
    return state.where(F.col("cost") < far).select(
        grid.key(*(F.col(a) for a in XYZ)).alias("id"), "cost", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"))


def shell_radius(mask: DataFrame, nodes: DataFrame, most: int, background: float, plane: bool = False) -> DataFrame:
    """Per node: the largest r up to `most` for which no shell up to r has more than the given
    share of background voxels in the ball (or, in plane, the disc) so far (at least 1)."""
    near = grid.balls(nodes.select("node", *XYZ, F.lit(most).alias("r")), "r")
    if plane:
        near = near.where("vz = z")
    d2 = sum((F.col(f"v{a}") - F.col(a)) * (F.col(f"v{a}") - F.col(a)) for a in XYZ)
    near = near.select("node", *(F.col(f"v{a}").alias(a) for a in XYZ), F.ceil(F.sqrt(d2.cast("double"))).cast("int").alias("shell"))
    on = near.join(mask.select(*XYZ).withColumn("on", F.lit(1)), list(XYZ), "left")
    s = on.groupBy("node", "shell").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) - F.count("on")).alias("bg"))
    w = Window.partitionBy("node").orderBy("shell")
    s = s.withColumn("share", F.sum("bg").over(w) / F.sum("n").over(w))
    fails = F.min(F.when((F.col("share") > background) & (F.col("shell") > 0), F.col("shell")))
    return s.groupBy("node").agg(F.when(fails.isNull(), F.lit(most)).otherwise(F.greatest(fails - 1, F.lit(1))).alias("radius"))


def trace_parents(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, level, parent): breadth-first tree from several roots; the parent is the smallest
    neighbour one level nearer (null at roots)."""
    l = materialise(graph.levels(roots, edges))
    a = l.select(F.col("id").alias("src"), F.col("level").alias("ls"))
    up = edges.join(a, "src").join(l.withColumnRenamed("id", "dst"), "dst").where("ls = level - 1").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return l.join(up, "id", "left").select("id", "level", "parent")


def skeleton(mask: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, x, y, z, radius, level) and edges (src, dst) of a skeleton: voxels of equal
    hop distance from the seeds are cut into connected pieces, each piece is a node at its
    mean position, and pieces that touch across one hop are joined."""
    reach = materialise(grid.keyed(grid.reachable(mask, seeds)))
    level = reach.select("id", "level")
    edges = grid.neighbour_edges(reach.select(*XYZ))
    e = edges.join(level.select(F.col("id").alias("src"), F.col("level").alias("ls")), "src").join(level.select(F.col("id").alias("dst"), F.col("level").alias("ld")), "dst")
    e = materialise(e)
    near = grid.neighbour_edges(reach.select(*XYZ), grid.half(grid.stencil(26)))
    near = near.join(level.select(F.col("id").alias("src"), F.col("level").alias("ls")), "src").join(level.select(F.col("id").alias("dst"), F.col("level").alias("ld")), "dst")
    piece = materialise(graph.components(reach.select("id"), near.where("ls = ld").select("src", "dst")))
    r = F.cbrt(F.count(F.lit(1)) * 3 / (4 * F.pi()))
    nodes = reach.join(piece, "id").groupBy(F.col("comp").alias("node")).agg(*(F.avg(a).alias(a) for a in XYZ), r.alias("radius"), F.min("level").alias("level"))
    p = lambda c: piece.select(F.col("id").alias(c), F.col("comp").alias(f"p_{c}"))
    joined = e.where("ls < ld").join(p("src"), "src").join(p("dst"), "dst").select(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).distinct()
    return nodes, joined


def segments(tree: DataFrame) -> DataFrame:
    """(id, owner): the leaf farthest below each node by path length (ties: smallest id) owns
    it; nodes of one owner are a segment."""
    leaves = trees.with_children(tree).where("children = 0").select("id")
    far = trees.roots(tree).join(leaves, "id").select("id", F.struct(F.round("length", 9), -F.col("id"), "id").alias("far"))
    return trees.below(far, tree, far=F.max).select("id", F.col("far.id").alias("owner"))


def segment_table(tree: DataFrame) -> DataFrame:
    """Per segment: owner leaf, nodes, birth (path length of the leaf), death (path length of
    the node its top hangs on) and parent segment; the root's segment has death 0.  Birth
    and death are the tree's persistence diagram."""
    s = materialise(segments(tree).join(tree.select("id", "parent"), "id").join(trees.roots(tree).select("id", "length"), "id"))
    p = s.select(F.col("id").alias("p"), F.col("owner").alias("p_owner"), F.col("length").alias("p_length"))
    j = s.join(p, s.parent == p.p, "left")
    top = F.col("p_owner").isNull() | (F.col("p_owner") != F.col("owner"))
    return j.groupBy("owner").agg(F.count(F.lit(1)).alias("nodes"), F.max("length").alias("birth"), F.coalesce(F.max(F.when(top, F.col("p_length"))), F.lit(0.0)).alias("death"), F.max(F.when(top, F.col("p_owner"))).alias("parent_segment"))


def prune_segments(tree: DataFrame, least: float) -> DataFrame:
    """The tree without segments shorter than `least` (what hangs on them is shorter still)."""
    keep = segment_table(tree).where(F.col("birth") - F.col("death") >= least).select("owner")
    return tree.join(segments(tree).join(keep, "owner", "left_semi").select("id"), "id", "left_semi")


def smooth_curve(tree: DataFrame, window: int = 5) -> DataFrame:
    """Positions and radii averaged along each segment with triangular weights, all nodes at
    once from the values before."""
    h = window // 2
    s = segments(tree).join(trees.roots(tree).select("id", "depth"), "id").join(tree, "id")
    w = Window.partitionBy("owner").orderBy("depth")
    out = {}
    for c in (*XYZ, "radius"):
        terms = [(1.0 + h - abs(k), F.lag(c, k).over(w)) for k in range(-h, h + 1)]
        total = sum(F.when(v.isNotNull(), F.lit(f)).otherwise(F.lit(0.0)) for f, v in terms)
        out[c] = sum(F.coalesce(v * f, F.lit(0.0)) for f, v in terms) / total
    return s.withColumns(out).select("id", "parent", *XYZ, "radius")


def split_multifurcations(tree: DataFrame) -> DataFrame:
    """Nodes with more than two children get a chain of helper nodes at their place so that
    none has more than two: (id, parent, x, y, z, radius); helpers have negative ids (those of
    the tree are 0 or more).
    Children keep their order by id; a root may keep any number."""
    kids = trees.child_lists(tree).where(F.size("child_ids") > 2).join(tree.where("parent IS NOT NULL").select("id"), "id", "left_semi")
    # the n-th helper is named after the n-th child, which hangs on it
    name = lambda n: F.lit(-1) - F.element_at("child_ids", n + 1)
    helper = kids.select("id", "child_ids", F.explode(F.expr("sequence(1, size(child_ids) - 2)")).alias("n"))
    at = tree.select("id", *XYZ, "radius")
    new = helper.join(at, "id").select(name(F.col("n")).alias("new"), F.when(F.col("n") == 1, F.col("id")).otherwise(name(F.col("n") - 1)).alias("parent"), *XYZ, "radius")
    moved = kids.select("child_ids", F.posexplode("child_ids").alias("k", "child"))
    moved = moved.where("k > 0").select("child", name(F.least(F.col("k"), F.size("child_ids") - 2)).alias("to_parent"))
    old = tree.join(moved, tree.id == moved.child, "left").select("id", F.coalesce("to_parent", "parent").alias("parent"), *XYZ, "radius")
    return old.unionByName(new.withColumnRenamed("new", "id"))


def merge_in_balls(tree: DataFrame, seeds: DataFrame, reach: float) -> tuple[DataFrame, DataFrame]:
    """Contraction of all nodes within reach of a seed into it (several seeds: the smallest
    id).  Returns (id, into) and the relabelled undirected edges without loops or repeats."""
    to = matching.smallest(tree.select(F.col("id").alias("a"), *XYZ), seeds.select(F.col("seed_id").alias("b"), *XYZ), reach).withColumnRenamed("b", "seed")
    into = materialise(tree.join(to, tree.id == to.a, "left").select("id", F.coalesce(-F.col("seed") - 1, "id").alias("into")))
    e = tree.where("parent IS NOT NULL").select("id", "parent")
    a, b = into.select("id", F.col("into").alias("s")), into.select(F.col("id").alias("parent"), F.col("into").alias("d"))
    e = e.join(a, "id").join(b, "parent").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst")).where("src <> dst").distinct()
    return into, e


def mean_shift(nodes: DataFrame, reach: float, rounds: int = 4, stop: float = 0.5, factor: float | None = None, fixed=None) -> DataFrame:
    """(id, x, y, z, radius): each node moves to the mean of the original nodes in reach, its
    own position counted twice, until its squared shift is at most `stop`; radii are averaged
    likewise.  With a factor a node's reach is its radius times that, `reach` at most.  Nodes
    for which the condition `fixed` holds (somas) stay as they are."""
    nowhere = reduce(or_, (F.col(a).isNull() | F.isnan(F.col(a).cast("double")) for a in XYZ))
    still = nowhere if fixed is None else F.coalesce(fixed, F.lit(False)) | nowhere
    radius = F.col("radius").cast("double") if "radius" in nodes.columns else F.lit(None).cast("double")
    limit = F.lit(float(reach)) if factor is None else F.least(radius * factor, F.lit(float(reach)))
    left = F.when(still, 0).otherwise(rounds).cast("int")
    base = materialise(nodes.select("id", *(F.col(a).cast("double").alias(a) for a in XYZ), radius.alias("radius"), limit.alias("limit"), left.alias("left"), nowhere.alias("nowhere")))
    places = base.where("NOT nowhere").groupBy(*XYZ).agg(F.count(F.lit(1)).cast("double").alias("n"), F.coalesce(F.sum("radius"), F.lit(0.0)).alias("sradius"))
    tiles = _tiles(places, float(reach)) if rounds else None
    now = base.drop("nowhere")
    done = [now.where("left = 0")]
    while not (open_ := now.where("left > 0")).isEmpty():
        now = materialise(_shift(open_, tiles, float(reach), stop))
        done.append(now.where("left = 0"))
    if rounds:
        release(tiles)
    return reduce(DataFrame.unionByName, done).select("id", *(F.round(a).alias(a) for a in XYZ), "radius")


def _edge(reach: float) -> float:
    """The edge of mean shift's blocks; balls may go that far out of a block, too."""
    return 1.5 * reach * (1 + 1e-9) + 1e-9


def _tiles(places: DataFrame, reach: float) -> DataFrame:
    """The places(x, y, z, n, sradius) of each block, packed: (tx, ty, tz, tile)."""
    key = ["tx", "ty", "tz"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        all_ = np.ascontiguousarray(pdf[[*XYZ, "n", "sradius"]].to_numpy(float))
        parts = [all_[k:k + 65536].tobytes() for k in range(0, len(all_), 65536)]
        return pd.DataFrame({**{c: int(pdf[c].iloc[0]) for c in key}, "tile": parts})

    at = places.select("*", *(F.floor(F.col(c) / _edge(reach)).cast("long").alias(f"t{c}") for c in XYZ))
    return materialise(at.groupBy(*key).applyInPandas(pack, "tx long, ty long, tz long, tile binary"))


def _shift(nodes: DataFrame, tiles: DataFrame, reach: float, stop: float) -> DataFrame:
    """nodes(id, x, y, z, radius, limit, left) moved until `left` rounds are over or the shift is
    small, which sets left to 0.  Nodes are dealt into blocks, which get the tiles around them;
    those whose ball leaves these come back with the rounds they still have, at least one fewer."""
    edge = _edge(reach)
    block = [f"b{c}" for c in XYZ]
    lots = 8 * nodes.sparkSession.sparkContext.defaultParallelism
    own = lambda: (F.floor(F.col(c) / edge).cast("long").alias(f"b{c}") for c in XYZ)
    q, near = nodes.select("*", *own()), nodes.select(*own()).distinct()
    for c in XYZ:
        near = near.withColumn(f"t{c}", F.explode(F.array(*(F.try_add(F.col(f"b{c}"), F.lit(k)) for k in (-1, 0, 1)))))
    p = tiles.join(near.hint("shuffle_hash"), [f"t{c}" for c in XYZ]).select(*block, "tile")
    # a fixed number of lots: few bytes make much work here, and adaptive planning goes by bytes
    pair = q.repartition(lots, *block).groupBy(*block).cogroup(p.repartition(lots, *block).groupBy(*block))

    def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        low = np.array([q[c].iloc[0] for c in block], float) * edge - edge
        q = q.drop(columns=block)
        around = np.frombuffer(b"".join(p.tile)).reshape(-1, 5)
        at, n, sradius = around[:, :3], around[:, 3], around[:, 4]
        sums = _grid_sums(at, n, sradius) or (lambda c, r2: _line_sums(c, r2, at, n, sradius))
        x, radius, left = q[list(XYZ)].to_numpy(float), q.radius.to_numpy(float).copy(), q.left.to_numpy().copy()
        r2 = np.minimum(q.limit.to_numpy(float) ** 2, reach * reach)
        r, i = np.sqrt(r2)[:, None], np.arange(len(q))
        while len(i):
            got = sums(x[i], r2[i])
            to = (got[:, 1:4] + x[i]) / (got[:, :1] + 1)
            d = to - x[i]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            x[i], radius[i] = to, (got[:, 4] + radius[i]) / (got[:, 0] + 1)
            left[i] = np.where(d2 <= stop, 0, left[i] - 1)
            held = ((to - r[i] >= low) & (to + r[i] <= low + 3 * edge)).all(1)
            i = i[(left[i] > 0) & held]
        return q.assign(radius=radius, left=left, **{c: x[:, k] for k, c in enumerate(XYZ)})

    return pair.applyInPandas(run, "id long, x double, y double, z double, radius double, limit double, left int")


def _ragged(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from low to high of each row (without high), and their rows."""
    size = np.maximum(high - low, 0)
    row = np.repeat(np.arange(len(low)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + low[row]


def _line_sums(at: np.ndarray, r2: np.ndarray, p: np.ndarray, n: np.ndarray, radius: np.ndarray, lot: int = 256) -> np.ndarray:
    """n, x, y, z and radius summed over the places p in each ball.  Places of one y and z are a
    line; a ball holds one run of it, whose sums are differences of running sums, so that a
    ball in a dense volume costs its lines, not its places.  Where runs end is tested on the places."""
    out = np.zeros((len(at), 5))
    if not len(p) or not len(at):
        return out
    order = np.lexsort((p[:, 0], p[:, 1], p[:, 2]))
    p, n, radius = p[order], n[order], radius[order]
    x, y, z = p.T
    line0 = np.flatnonzero(np.r_[True, (y[1:] != y[:-1]) | (z[1:] != z[:-1])])
    ly, lz = y[line0], z[line0]
    ends = np.r_[line0[1:], len(p)]
    zs, z0 = np.unique(lz, return_index=True)
    # one sorted key over all planes' lines, and one over all lines' places
    most = 2 * math.sqrt(r2.max()) + 2
    low = np.minimum(p.min(0), at.min(0))
    wide = np.maximum(p.max(0), at.max(0)) - low + 2 * most
    line_key = np.repeat(np.arange(len(zs)), np.diff(np.r_[z0, len(lz)])) * wide[1] + (ly - low[1])
    key = np.repeat(np.arange(len(line0)), ends - line0) * wide[0] + (x - low[0])
    run = np.zeros((3, len(p) + 1))
    np.cumsum([n, n * x, radius], axis=1, out=run[:, 1:])
    slack = 1e-6
    for start in range(0, len(at), lot):
        a, b2 = at[start:start + lot], r2[start:start + lot]
        reach = np.sqrt(b2) + slack
        i, k = _ragged(np.searchsorted(zs, a[:, 2] - reach), np.searchsorted(zs, a[:, 2] + reach, "right"))
        half = np.sqrt(np.maximum(b2[i] - (zs[k] - a[i, 2]) ** 2, 0)) + slack
        mid = k * wide[1] + (a[i, 1] - low[1])
        j, line = _ragged(np.searchsorted(line_key, mid - half), np.searchsorted(line_key, mid + half, "right"))
        i = i[j]
        dy, dz = ly[line] - a[i, 1], lz[line] - a[i, 2]
        half = np.sqrt(np.maximum(b2[i] - dy * dy - dz * dz, 0)) + slack
        mid = line * wide[0] + (a[i, 0] - low[0])
        lo, hi = np.searchsorted(key, mid - half), np.searchsorted(key, mid + half, "right")
        ax, dy, dz, most2 = a[i, 0], dy * dy, dz * dz, b2[i]

        def out_of(where: np.ndarray, rows: np.ndarray) -> np.ndarray:
            dx = x[where] - ax[rows]  # noqa: B023
            return dx * dx + dy[rows] + dz[rows] > most2[rows]  # noqa: B023

        rows = np.flatnonzero(lo < hi)
        while len(rows):
            rows = rows[out_of(lo[rows], rows)]
            lo[rows] += 1
            rows = rows[lo[rows] < hi[rows]]
        rows = np.flatnonzero(lo < hi)
        while len(rows):
            rows = rows[out_of(hi[rows] - 1, rows)]
            hi[rows] -= 1
            rows = rows[lo[rows] < hi[rows]]
        count, sx, sr = run[:, hi] - run[:, lo]
        for c, v in enumerate((count, sx, count * ly[line], count * lz[line], sr)):
            out[start:start + lot, c] = np.bincount(i, v, len(a))
    return out


#: Cells a place and cells in all up to which places are laid out as a grid.
SPARSE_GRID, LARGE_GRID = 64, 1 << 23


def _grid_sums(p: np.ndarray, n: np.ndarray, radius: np.ndarray, lot: int = 1 << 16):
    """What `_line_sums` gives, as a function of the balls, or None unless the places p are whole
    numbers that fill a grid well enough.  A line's run is then found without a search."""
    if not len(p) or (np.abs(p) > 2**50).any() or (p != np.rint(p)).any():
        return None
    low = p.min(0)
    nx, ny, nz = (int(v) + 1 for v in p.max(0) - low)
    if nx * ny * nz > min(SPARSE_GRID * len(p), LARGE_GRID):
        return None
    # running sums along each line; a rim of empty lines stands for all that are beyond
    i, j, k = (p - low).astype(np.int64).T
    shape = (nz + 2, ny + 2, nx + 1)
    cell = np.ravel_multi_index((k + 1, j + 1, i + 1), shape)
    run = [np.cumsum(np.bincount(cell, v, math.prod(shape)).reshape(shape), axis=2).ravel() for v in (n, n * p[:, 0], radius)]
    slack = 1e-6

    def lines(at: np.ndarray, r2: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 5))
        most = math.sqrt(r2.max())
        wide = math.floor(most + slack) + 1
        steps = np.arange(-wide, wide + 2)
        x, (fy, fz) = at[:, :1] - low[0], np.floor(at[:, 1:]).T
        dy, dz = fy[:, None] + steps - at[:, 1:2], fz[:, None] + steps - at[:, 2:]
        dy2, dz2 = dy * dy, dz * dz
        row = np.clip(fy[:, None] + steps - low[1] + 1, 0, ny + 1).astype(np.int64) * (nx + 1)
        plane = np.clip(fz[:, None] + steps - low[2] + 1, 0, nz + 1).astype(np.int64) * ((ny + 2) * (nx + 1))
        for c, step in enumerate(steps):
            nearest = max(step - 1, -step)
            rest = most * most - nearest * nearest
            if rest < -slack:
                continue
            span = math.floor(math.sqrt(max(rest, 0)) + slack)
            cut = slice(wide - span, wide + span + 2)
            d2 = dy2[:, cut] + dz2[:, c:c + 1]
            half = np.sqrt(np.maximum(r2[:, None] - d2, 0)) + slack
            first, last = np.ceil(x - half), np.floor(x + half)
            # the outermost places are tested themselves
            first += np.square(first - x) + d2 > r2[:, None]
            last -= np.square(last - x) + d2 > r2[:, None]
            line = row[:, cut] + plane[:, c:c + 1]
            lo = np.clip(first, 0, nx).astype(np.int64)
            hi = np.maximum(np.clip(last + 1, 0, nx).astype(np.int64), lo) + line
            lo += line
            count = run[0].take(hi) - run[0].take(lo)
            here = count.sum(1)
            out[:, 0] += here
            out[:, 1] += (run[1].take(hi) - run[1].take(lo)).sum(1)
            out[:, 2] += (count * (fy[:, None] + steps[cut])).sum(1)
            out[:, 3] += here * (fz + step)
            out[:, 4] += (run[2].take(hi) - run[2].take(lo)).sum(1)
        return out

    def sums(at: np.ndarray, r2: np.ndarray) -> np.ndarray:
        out = np.zeros((len(at), 5))
        order, start = np.argsort(r2, kind="stable"), 0
        while start < len(at):
            # balls of like size go together, as many as fill a lot of lines of one plane
            rows = order[start:start + max(1, int(lot / (2 * math.sqrt(r2[order[start]]) + 3)))]
            out[rows] = lines(at[rows], r2[rows])
            start += len(rows)
        return out

    return sums


def cover_prune(nodes: DataFrame, group: str, factor: float = 1.0, first=None) -> DataFrame:
    """Greedy sphere grouping per group: those for which `first` holds (somas), then by falling
    radius (then id), a node is kept unless a kept node's ball of radius * factor holds it:
    (group, id, kept_by).  A group is a component of one tree; one task looks through it by
    cells of the largest ball, so that a kept node meets those near it only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["lead", "radius", "id"], ascending=[False, False, True], ignore_index=True)
        p, r = pdf[list(XYZ)].to_numpy(float), pdf.radius.to_numpy(float) * factor
        free, by = np.ones(len(pdf), bool), pdf.id.to_numpy().copy()
        edge = max(float(r.max()), 1e-9)
        cells: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, np.floor(p / edge).astype(np.int64).tolist())):
            cells.setdefault(c, []).append(i)
        span = (-1, 0, 1)
        for i in range(len(pdf)):
            if not free[i]:
                continue
            free[i] = False
            x, y, z = np.floor(p[i] / edge).astype(np.int64).tolist()
            for c in ((x + a, y + b, z + d) for a in span for b in span for d in span):
                if c not in cells:
                    continue
                here = np.array(cells[c], dtype=np.int64)
                here = here[free[here]]
                inside = ((p[here] - p[i]) ** 2).sum(1) <= r[i] * r[i]
                free[here[inside]] = False
                by[here[inside]] = pdf.id[i]
                if inside.any() or not len(here):
                    cells[c] = here[~inside].tolist()
        return pd.DataFrame({group: pdf[group], "id": pdf.id, "kept_by": by})

    lead = F.lit(False) if first is None else F.coalesce(first, F.lit(False))
    return nodes.select(group, "id", *XYZ, "radius", lead.alias("lead")).groupBy(group).applyInPandas(run, f"{group} long, id long, kept_by long")


def cover_groups(nodes: DataFrame, covered: DataFrame, fixed=None) -> DataFrame:
    """(id, members, x, y, z, radius): each kept node at the mean of those it covers, with their
    mean radius; nodes for which `fixed` holds keep their own place and radius."""
    cols = [*XYZ, "radius"]
    mean = nodes.join(covered.select("id", "kept_by"), "id").groupBy("kept_by").agg(F.count(F.lit(1)).alias("members"), *(F.avg(c).alias(f"m{c}") for c in cols))
    still = F.lit(False) if fixed is None else F.coalesce(fixed, F.lit(False))
    kept = nodes.join(mean, nodes.id == F.col("kept_by"))
    return kept.select("id", "members", *(F.when(still, F.col(c)).otherwise(F.col(f"m{c}")).alias(c) for c in cols))


def assign_somas(tree: DataFrame, somas: DataFrame, cost) -> DataFrame:
    """(id, soma, cost): the soma with the cheapest path to each node over tree edges, `cost`
    being an edge's (a column over a node and its parent's p_ columns).  Somas are traps: a
    path does not go through another one.  Cheapest paths keep a node's predecessor with
    the same soma, which is the constraint that a child's share is within its parent's."""
    e = trees.with_parent(tree).where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"), cost.alias("c"))
    e = materialise(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "c")))
    best = materialise(somas.select("id", F.col("id").alias("soma"), F.lit(0.0).alias("cost")))
    changed = best
    while not changed.isEmpty():
        offers = changed.join(e, changed.id == e.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((F.col("cost") + F.col("c")).alias("cost"), "soma")).alias("o"))
        both = best.join(offers, "id", "full")
        better = F.col("o").isNotNull() & (F.col("cost").isNull() | (F.col("o.cost") < F.col("cost") - 1e-12))
        now = materialise(both.select("id", F.when(better, F.col("o.soma")).otherwise(F.col("soma")).alias("soma"), F.when(better, F.col("o.cost")).otherwise(F.col("cost")).alias("cost"), better.alias("changed")))
        best, changed = now.drop("changed"), now.where("changed").select("id", "soma", "cost")
    return best


def soma_units(tree: DataFrame, somas: DataFrame) -> DataFrame:
    """(unit, nodes, somas): what is left between somas, with the somas each part touches.  A
    part with one soma is that soma's; only parts with more need an assignment."""
    gone = somas.select("id").distinct()
    rest = tree.join(gone, "id", "left_anti")
    cut = rest.join(gone.select(F.col("id").alias("s")), F.col("parent") == F.col("s"), "left").select("id", F.when(F.col("s").isNull(), F.col("parent")).alias("parent"))
    edges = cut.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    unit = materialise(graph.components(rest.select("id"), edges))
    touch = trees.undirected(tree).join(gone.select(F.col("id").alias("src")), "src").select(F.col("src").alias("soma"), F.col("dst").alias("id"))
    held = unit.join(touch, "id").groupBy("comp").agg(F.array_sort(F.collect_set("soma")).alias("somas"))
    sizes = unit.groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"))
    return sizes.join(held, "comp", "left").select(F.col("comp").alias("unit"), "nodes", "somas")
