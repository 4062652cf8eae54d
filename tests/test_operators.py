"""Operators without SQL form against small models, and sources as round trips."""

import functools
import heapq
import math
import operator
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxarbor.functions import coords
from voxarbor.operators import grid, matching, tracing, trees
from voxarbor.sources import images, swc
from voxarbor.streaming import tiles

XYZ = ["x", "y", "z"]


def _volume(spark, side=6, seed=3, share=0.6):
    rng = random.Random(seed)
    cells = {(x, y, z): rng.randint(1, 9) for x in range(side) for y in range(side) for z in range(side) if rng.random() < share}
    return cells, spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, v int")


def test_march_is_dijkstra(spark):
    cells, df = _volume(spark)
    start = sorted(cells)[0]
    got = {tuple(r[:3]): r.cost for r in tracing.march(df, spark.createDataFrame([start], "x int, y int, z int"), F.col("v").cast("double"), 26)
           .join(grid.keyed(df), "id").select(*XYZ, "cost").collect()}
    cost, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, p = heapq.heappop(heap)
        if d > cost[p]:
            continue
        for o in grid.stencil(26):
            q = tuple(a + b for a, b in zip(p, o))
            if q in cells:
                n = d + (cells[p] + cells[q]) / 2 * math.sqrt(sum(c * c for c in o))
                if n < cost.get(q, math.inf) - 1e-12:
                    cost[q] = n
                    heapq.heappush(heap, (n, q))
    assert got.keys() == cost.keys()
    assert all(abs(got[k] - cost[k]) < 1e-9 for k in cost)


def test_skeleton_joins_what_the_mask_joins(spark):
    line = spark.createDataFrame([(x, 0, 0) for x in range(6)] + [(9, 9, 9)], "x int, y int, z int")
    nodes, edges = tracing.skeleton(line, spark.createDataFrame([(0, 0, 0)], "x int, y int, z int"))
    assert nodes.count() == 6 and edges.count() == 5


def test_stencils():
    assert len(coords.ball_offsets(3)) == 123 and len(coords.ball_offsets(1.5)) == 19
    assert [len(grid.stencil(c)) for c in (6, 18, 26)] == [6, 18, 26]


def test_opening_and_closing(spark):
    cube = spark.createDataFrame([(x, y, z) for x in range(5) for y in range(5) for z in range(5) if (x, y, z) != (2, 2, 2)], "x int, y int, z int")
    assert grid.closed(cube, 1).count() == 125
    assert grid.opened(cube.unionByName(spark.createDataFrame([(9, 9, 9)], "x int, y int, z int")), 1).where("x = 9").count() == 0


def test_multifurcations_end_with_two_children(spark):
    t = spark.createDataFrame([(1, None), (2, 1)] + [(i, 2) for i in range(3, 9)], "id long, parent long").selectExpr("*", "0D x", "0D y", "0D z", "1D radius")
    out = tracing.split_multifurcations(t)
    assert trees.with_children(out).agg(F.max("children")).first()[0] == 2
    assert {r.root for r in trees.roots(out).collect()} == {1} and out.count() == 8 + 4


def test_cover_prune_keeps_largest_first(spark):
    n = spark.createDataFrame([(0, 1, 0.0, 3.0), (0, 2, 2.0, 1.0), (0, 3, 10.0, 1.0)], "g long, id long, x double, radius double").selectExpr("*", "0D y", "0D z")
    assert {r.id: r.kept_by for r in tracing.cover_prune(n, "g").collect()} == {1: 1, 2: 1, 3: 3}


def test_assign_somas_splits_at_the_middle(spark):
    t = spark.createDataFrame([(i, i - 1 if i > 1 else None, float(i)) for i in range(1, 8)], "id long, parent long, x double").selectExpr("*", "0D y", "0D z", "1D radius")
    got = {r.id: r.soma for r in tracing.assign_somas(t, spark.createDataFrame([(1,), (7,)], "id long"), trees.edge_length()).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 7, 6: 7, 7: 7}


def test_mean_shift_moves_to_the_mean(spark):
    n = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 2.0, 0.0, 0.0), (3, 50.0, 0.0, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r.x for r in tracing.mean_shift(n, 5.0).collect()}
    assert got[3] == 50 and abs(got[1] - got[2]) <= 2


def test_mean_shift_leaves_somas_and_averages_radii(spark):
    rows = [(1, 1, 0.0, 2.0, 0.0, 5.0), (2, 3, 0.0, 1.0, 0.0, 4.0), (3, 3, 0.0, 3.0, 0.0, 3.0)]
    n = spark.createDataFrame(rows, "id long, type int, x double, y double, z double, radius double")
    got = {r.id: r for r in tracing.mean_shift(n, 10.0, rounds=1, factor=1.0, fixed=F.col("type") == 1).collect()}
    assert (got[1].y, got[1].radius) == (2.0, 5.0)
    assert (got[2].x, got[2].y, got[2].z, got[2].radius) == (0.0, 2.0, 0.0, 4.0)


def _shifted(rows, reach, rounds, factor):
    """What mean_shift makes of rows (id, type, x, y, z, radius), all pairs compared; type 1 stays."""
    p, out = np.array([r[2:5] for r in rows], float), {}
    radii = np.array([r[5] for r in rows])
    for i, kind, *at, radius in rows:
        at, limit = np.array(at, float), min(radius * factor, reach)
        for _ in range(0 if kind == 1 else rounds):
            near = ((p - at) ** 2).sum(1) <= limit * limit
            to, radius = (p[near].sum(0) + at) / (near.sum() + 1), (radii[near].sum() + radius) / (near.sum() + 1)
            small, at = ((to - at) ** 2).sum() <= 0.5, to
            if small:
                break
        out[i] = (*at, radius)
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_mean_shift_equals_all_pairs(spark, monkeypatch, whole):
    """On whole places without a search along lines, on scattered ones with it.  A trail of ever denser
    places leads nodes out of their blocks."""
    rng = random.Random(11)
    put = [(rng.randint(-12, 12), rng.randint(-7, 7), rng.randint(-3, 3)) for _ in range(900)]
    put += [(20 + x, 0, y) for x in range(30) for y in range(-x // 4, x // 4 + 1)]
    if whole:
        monkeypatch.setattr(tracing, "_line_sums", None)
    else:
        put = [tuple(v + rng.uniform(-0.4, 0.4) for v in p) for p in put]
    rows = [(i, 1 if i % 40 == 0 else 3, *map(float, p), rng.choice([0.5, 1.0, 3.0])) for i, p in enumerate(put)]
    n = spark.createDataFrame([*rows, (-1, 3, None, 0.0, 0.0, 1.0)], "id long, type int, x double, y double, z double, radius double")
    got = {r.id: r for r in tracing.mean_shift(n, 4.0, rounds=7, factor=2.0, fixed=F.col("type") == 1).collect()}
    want = _shifted(rows, 4.0, 7, 2.0)
    assert len(got) == len(rows) + 1 and got[-1].x is None
    assert all(abs(got[i].radius - w[3]) < 1e-9 for i, w in want.items())
    assert all(abs(v - w) <= 0.5 + 1e-9 for i, at in want.items() for v, w in zip((got[i].x, got[i].y, got[i].z), at))


def test_grid_sums_equal_all_pairs():
    rng = np.random.default_rng(5)
    p = np.unique(rng.integers(-9, 12, (2500, 3)).astype(float), axis=0)
    n, radius = rng.integers(1, 4, len(p)).astype(float), rng.integers(1, 9, len(p)) * 0.5
    at = np.r_[p[:150], rng.integers(-16, 19, (150, 3)), rng.integers(-30, 40, (150, 3)) / 2, rng.uniform(-14, 14, (250, 3))]
    r2 = rng.choice([0.0, 0.25, 4.0, 9.0, 49.0, 50.5], len(at))
    inside = sum((p[None, :, c] - at[:, None, c]) ** 2 for c in range(3)) <= r2[:, None]
    want = np.stack([inside @ n, *(inside @ (n * p[:, c]) for c in range(3)), inside @ radius], axis=1)
    assert np.array_equal(tracing._grid_sums(p, n, radius, lot=64)(at, r2), want)
    assert tracing._grid_sums(p + 0.5, n, radius) is None and tracing._grid_sums(p * 1000, n, radius) is None


def test_line_sums_equal_all_pairs():
    """On a lattice, where balls' edges meet places exactly, and on scattered places."""
    rng = np.random.default_rng(4)
    for p in (np.unique(rng.integers(-9, 12, (2500, 3)).astype(float), axis=0), rng.uniform(-9, 12, (700, 3))):
        n, radius = rng.integers(1, 4, len(p)).astype(float), rng.integers(1, 9, len(p)) * 0.5
        at = np.r_[p[:150], rng.uniform(-14, 14, (250, 3))]
        r2 = rng.choice([0.0, 0.25, 4.0, 9.0, 49.0, 50.5], len(at))
        inside = sum((p[None, :, c] - at[:, None, c]) ** 2 for c in range(3)) <= r2[:, None]
        want = np.stack([inside @ v for v in (n, n * p[:, 0], n * p[:, 1], n * p[:, 2], n * 0 + radius)], 1)
        got = tracing._line_sums(at, r2, p, n, radius)
        assert (got[:, 0] == want[:, 0]).all() and np.allclose(got, want, atol=1e-8)


def test_goodness_of_fit_counts_a_node_at_the_soma(spark):
    rows = [(1, None, 50.0, 60.0), (2, 1, 50.0, 50.0), (3, 2, 60.0, 50.0), (4, 3, 60.0, 60.0), (5, 4, 60.0, 60.0)]
    t = spark.createDataFrame(rows, "id long, parent long, x double, y double").selectExpr("*", "50D z", "1D radius")
    got = {r.neurite: r for r in trees.goodness_of_fit(t, (50.0, 50.0, 50.0)).collect()}
    assert got[5].angle == pytest.approx(math.pi / 16)  # at the soma; straight out; half a right angle; no step
    assert (got[5].length, got[5].nodes) == (30.0, 4)


def test_march_crosses_blocks(spark):
    """Against Dijkstra on a sparse volume that lies in eight blocks, negative places included."""
    rng = random.Random(8)
    cells = {(x, y, z): rng.randint(1, 9) for x in range(25, 40) for y in range(-6, 7) for z in range(60, 68) if rng.random() < 0.55}
    df = spark.createDataFrame([(*k, v) for k, v in cells.items()], "x int, y int, z int, v int")
    for near in (6, 26):
        starts = sorted(cells)[:1] + sorted(cells)[-2:]
        cost, heap = {s: 0.0 for s in starts}, [(0.0, s) for s in starts]
        while heap:
            d, p = heapq.heappop(heap)
            if d > cost[p]:
                continue
            for o in grid.stencil(near):
                q = tuple(a + b for a, b in zip(p, o, strict=True))
                n = d + (cells[p] + cells.get(q, math.inf)) / 2 * math.sqrt(sum(c * c for c in o))
                if n < cost.get(q, math.inf) - 1e-12:
                    cost[q] = n
                    heapq.heappush(heap, (n, q))
        found = tracing.march(df, spark.createDataFrame([*starts, (0, 0, 0)], "x int, y int, z int"), F.col("v"), near)
        keys = grid.keyed(df).collect()
        place, got = {r.id: (r.x, r.y, r.z) for r in keys}, {r.id: r for r in found.collect()}
        assert {place[i]: round(r.cost, 9) for i, r in got.items()} == {k: round(v, 9) for k, v in cost.items()}
        for i, r in got.items():
            if r.parent is None:
                assert place[i] in starts
                continue
            a, b = place[r.parent], place[i]
            assert abs(cost[a] + (cells[a] + cells[b]) / 2 * math.dist(a, b) - r.cost) < 1e-9


def test_cover_prune_equals_all_pairs(spark):
    rng = random.Random(4)
    rows = [(g, g * 1000 + i, rng.random() < 0.03, *(rng.uniform(-9, 9) for _ in XYZ), rng.choice([0.0, 0.5, 1.0, 2.5])) for g in range(3) for i in range(150)]
    want = {}
    for g in range(3):
        left = sorted((r for r in rows if r[0] == g), key=lambda r: (not r[2], -r[6], r[1]))
        while left:
            top = left[0]
            held = [r for r in left if r is top or math.dist(r[3:6], top[3:6]) <= top[6] * 1.5]
            want |= {r[1]: top[1] for r in held}
            left = [r for r in left if r not in held]
    df = spark.createDataFrame(rows, "g long, id long, soma boolean, x double, y double, z double, radius double")
    covered = tracing.cover_prune(df, "g", 1.5, F.col("soma"))
    assert {r.id: r.kept_by for r in covered.collect()} == want
    groups = {r.id: r for r in tracing.cover_groups(df, covered, F.col("soma")).collect()}
    for r in (r for r in rows if want[r[1]] == r[1]):
        held = [q for q in rows if want[q[1]] == r[1]]
        assert groups[r[1]].members == len(held)
        assert abs(groups[r[1]].x - (r[3] if r[2] else sum(q[3] for q in held) / len(held))) < 1e-9


def test_folds_below_and_preorder(spark):
    """A forest of two chains with bushes, deeper than any power of two in reach."""
    rng, rows = random.Random(6), []
    for first, n in ((1, 150), (200, 40)):
        rows += [(first + i, None if i == 0 else first + (i - 1 if rng.random() < 0.8 else rng.randrange(i))) for i in range(n)]
    kids = {}
    for i, p in rows:
        kids.setdefault(p, []).append(i)
    order, todo = {}, sorted(kids[None], reverse=True)
    while todo:
        order[i := todo.pop()] = len(order)
        todo += sorted(kids.get(i, []), reverse=True)
    t = spark.createDataFrame(rows, "id long, parent long")
    assert {r.id: r.position for r in trees.depth_first(t).collect()} == order
    size = {}
    for i in sorted(order, key=order.get, reverse=True):
        size[i] = 1 + sum(size[k] for k in kids.get(i, []))
    got = trees.below(t.selectExpr("id", "1L AS n", "id AS most"), t, n=F.sum, most=F.max).collect()
    assert {r.id: r.n for r in got} == size
    with pytest.raises(ValueError, match="circle"):
        trees.below(spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1)], "id long, parent long, n long"), spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "id long, parent long"), n=F.sum)


def test_within_equals_all_pairs(spark):
    rng = random.Random(5)
    pts = [(i, *(rng.uniform(-20, 20) for _ in range(3))) for i in range(60)]
    df = spark.createDataFrame(pts, "a long, x double, y double, z double")
    got = {(r.a, r.b) for r in matching.within(df, df.withColumnRenamed("a", "b"), 9.0).collect()}
    assert got == {(p[0], q[0]) for p in pts for q in pts if math.dist(p[1:], q[1:]) <= 9.0}


def test_reached_and_nearest_equal_all_pairs(spark):
    """Clustered and thin points, copies of places, ties and places without a point in reach."""
    rng = random.Random(6)
    put = lambda: tuple(rng.choice([rng.uniform(-3, 3), float(rng.randint(-2, 2)), rng.uniform(-60, 60)]) for _ in range(3))
    a, b = [(i, *put()) for i in range(150)], [(i, *put()) for i in range(400)]
    a += [(200 + p[0], *p[1:]) for p in a[:20]]
    b += [(500 + p[0], *p[1:]) for p in b[:50]] + [(-1, None, 0.0, 0.0)]
    left, right = spark.createDataFrame(a, "a long, x double, y double, z double"), spark.createDataFrame(b, "b long, x double, y double, z double")
    for radius, scale in ((12.0, (1.0, 1.0, 1.0)), (7.0, (0.5, 1.0, 2.0))):
        d2 = lambda p, q: functools.reduce(operator.add, (((u - v) * s) * ((u - v) * s) for u, v, s in zip(p[1:], q[1:], scale, strict=True)))  # noqa: B023, E731
        want = {p[0]: min((d2(p, q), q[0]) for q in b[:-1]) for p in a}
        want = {k: v for k, v in want.items() if v[0] <= radius * radius}
        assert 20 < len(want) < len(a)
        got = matching.nearest(left, right, radius, scale)
        assert {r.a: (r.d2, r.b) for r in got.collect()} == want and got.count() == len(want)
        assert sorted(r.a for r in matching.reached(left, right, radius, scale).collect()) == sorted(want)
        least = {p[0]: min(q[0] for q in b[:-1] if d2(p, q) <= radius * radius) for p in a if p[0] in want}
        assert {r.a: r.b for r in matching.smallest(left, right, radius, scale).collect()} == least


def test_nearest_does_not_compare_what_is_too_far(spark, monkeypatch):
    """A full cube and places around it, most of them beyond reach, negative ones included: large balls
    are not compared place by place."""
    side, radii, meet = range(-6, 10), [], matching._meet
    cube = [(100 * i + k, float(x), float(y), float(z)) for i, (x, y, z) in enumerate((x, y, z) for x in side for y in side for z in side) for k in range(1 + i % 2)]
    rng = random.Random(9)
    a = [(i, *(rng.randint(-31, 34) for _ in range(3))) for i in range(300)] + [(300 + i, *(2 * rng.randint(-16, 17) + 0.5 for _ in range(3))) for i in range(60)]
    left = spark.createDataFrame([(i, *map(float, p)) for i, *p in a], "a long, x double, y double, z double")
    right = spark.createDataFrame(cube, "b long, x double, y double, z double")
    at = np.array([c[1:] for c in cube])
    for scale in ((1.0, 1.0, 1.0), (1.0, 1.5, 0.5)):
        want = {}
        for i, *p in a:
            d2 = (((at - p) * scale) ** 2).sum(1)
            if d2.min() <= 144:
                want[i] = (d2.min(), min(cube[j][0] for j in np.flatnonzero(d2 == d2.min())))
        assert 30 < len(want) < 250
        monkeypatch.setattr(matching, "_meet", lambda *args: radii.append(args[2]) or meet(*args))
        assert {r.a: (r.d2, r.b) for r in matching.nearest(left, right, 12.0, scale).collect()} == want
        assert sorted(r.a for r in matching.reached(left, right, 12.0, scale).collect()) == sorted(want)
    assert max(radii) < 4


def test_swc_round_trip(spark, tmp_path):
    t = spark.createDataFrame([("a", 1, 1, 0.0, 0.0, 0.0, 2.0, None), ("a", 2, 3, 1.0, 2.0, 3.0, 1.0, 1), ("b", 1, 1, 5.0, 5.0, 5.0, 1.0, None)],
                              "tree string, id long, type int, x double, y double, z double, radius double, parent long")
    swc.write(t, f"file://{tmp_path}/out", voxel=(0.5, 0.5, 1.0))
    text = spark.read.text(f"file://{tmp_path}/out")
    back = swc.parse(text, (0.5, 0.5, 1.0), "tree")
    assert sorted(map(tuple, back.select(*t.columns).collect()), key=repr) == sorted(map(tuple, t.collect()), key=repr)


def test_tolerant_swc(spark):
    text = spark.createDataFrame([("# c",), ("",), ("1,1,0,0,0,2,1",), (" 2 3  1 1 1 1 1",)], "value string")
    rows = swc.parse(text).orderBy("id").collect()
    assert [r.parent for r in rows] == [None, 1]


def test_markers(spark, tmp_path):
    (tmp_path / "marker_3_4_5_113").write_text("# x,y,z,radius\n3,4,5,0\n")
    r = swc.read_markers(spark, f"file://{tmp_path}").first()
    assert (r.x, r.y, r.z) == (3, 4, 5) and abs(r.radius - (3 * 113 / (4 * math.pi)) ** (1 / 3)) < 1e-9


@pytest.mark.parametrize("bits", [8, 16])
def test_tiff_round_trip(spark, tmp_path, bits):
    rows = [(x, y, z, x + y * 2 + z + 1) for x in range(4) for y in range(3) for z in range(2)]
    v = spark.createDataFrame(rows, "x int, y int, z int, v int")
    uri = f"file://{tmp_path}/img"
    assert images.write_tiff(v, uri, 4, 3, bits).count() == 2
    assert sorted(map(tuple, images.read_tiff(spark, uri).collect())) == sorted(rows)


def test_lzw():
    # clear, 'a', 'b', 258 ('ab'), end: 9-bit codes
    codes, bits = [256, 97, 98, 258, 257], ""
    bits = "".join(f"{c:09b}" for c in codes)
    bits += "0" * (-len(bits) % 8)
    assert images.lzw_decode(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"abab"


def test_v3draw():
    raw = b"raw_image_stack_by_hpeng" + b"L" + (1).to_bytes(2, "little") + b"".join(n.to_bytes(4, "little") for n in (2, 2, 1, 1)) + bytes([1, 2, 3, 4])
    assert images.v3draw_volume(raw).tolist() == [[[1, 2], [3, 4]]]


def test_names():
    assert images.input_kind("a/b.swc") == "swc" and images.folder_kind(["x.tif"]) == "tiff"
    with pytest.raises(ValueError):
        images.input_kind("a.txt")


def test_streamed_counts_equal_batch(spark, tmp_path):
    v = spark.createDataFrame([(x, 0, z, x * 3) for x in range(9) for z in range(20)], "x int, y int, z int, v int")
    v.write.parquet(f"file://{tmp_path}/in")
    q = tiles.start(tiles.tile_counts(tiles.planes(spark, f"file://{tmp_path}/in")), "tile_counts", f"file://{tmp_path}/check")
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tile_counts").collect())) == sorted(map(tuple, tiles.tile_counts(v).collect()))


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "x int, y int, z int")
    assert grid.label(none).count() == 0 and grid.reachable(none, none).count() == 0
    assert grid.dilate(none).count() == 0 and np.array(coords.ball_offsets(0)).shape == (1, 3)


def test_coverage_prune_is_greedy(spark):
    rng = random.Random(9)
    cells = {(x, y, z): rng.choice([1, 1, 1, 2, 3]) for x in range(9) for y in range(9) for z in range(5) if rng.random() < 0.5}
    roots = sorted(cells)[:2] + [(50, 50, 50)]
    kept = []
    for c in sorted(cells, key=lambda c: (c not in roots, -cells[c], c[2], c[1], c[0])):
        if c in roots or not any(sum(abs(a - b) for a, b in zip(c, k, strict=True)) <= cells[k] for k in kept):
            kept.append(c)
    nodes = spark.createDataFrame([(*k, r) for k, r in cells.items()], "x int, y int, z int, radius int")
    got = grid.coverage_prune(nodes, spark.createDataFrame(roots, "x int, y int, z int")).collect()
    assert {(r.x, r.y, r.z): r.radius for r in got} == {k: cells[k] for k in kept}
    assert grid.coverage_prune(nodes.limit(0), spark.createDataFrame(roots, "x int, y int, z int")).count() == 0


def test_signed_hops_of_a_cube(spark):
    cube = [(x, y, z) for x in range(5) for y in range(5) for z in range(5)]
    got = {(r.x, r.y, r.z): r.sdf for r in grid.signed_hops(spark.createDataFrame(cube, "x int, y int, z int"), 2).collect()}
    assert got[(2, 2, 2)] == -2.5 and got[(0, 2, 2)] == -0.5 and got[(-1, 2, 2)] == 0.5 and got[(-1, -1, 2)] == 1.5
    assert (-1, -1, -1) not in got and sum(v < 0 for v in got.values()) == 125


def test_random_walks_are_connected_and_repeat(spark):
    from voxarbor.operators import synthetic

    seeds = spark.createDataFrame([(1,), (2,), (2,)], "seed_id long")
    got = synthetic.random_walks(seeds, 10, 0.1).collect()
    for seed in (1, 2):
        cells = {(r.x, r.y, r.z) for r in got if r.seed_id == seed}
        assert len(cells) == sum(r.seed_id == seed for r in got) == 100 and all(0 <= v < 10 for c in cells for v in c)
        todo, seen = [(5, 5, 5)], {(5, 5, 5)}
        while todo:
            c = todo.pop()
            new = {q for o in grid.stencil(6) if (q := tuple(a + b for a, b in zip(c, o, strict=True))) in cells} - seen
            seen |= new
            todo += new
        assert seen == cells
    assert sorted(got) == sorted(synthetic.random_walks(seeds.repartition(7), 10, 0.1).collect())


def test_windows_as_paged_files(spark, tmp_path):
    """A window at an edge, one across tiles, one with a single voxel and one without any."""
    cells, voxels = _volume(spark, side=20, share=0.3)
    low_high = {1: ((-3, 0, 0), (4, 5, 6)), 2: ((10, 12, 14), (18, 17, 17)), 3: ((*min(cells),), (*min(cells),)), 4: ((90, 90, 90), (95, 95, 95))}
    rows = [(w, *(v for pair in zip(a, b, strict=True) for v in pair)) for w, (a, b) in low_high.items()]
    windows = spark.createDataFrame(rows, "window long, min_x int, max_x int, min_y int, max_y int, min_z int, max_z int")
    names = images.write_windows(grid.in_windows(voxels, windows, 8), f"file://{tmp_path}/w").collect()
    assert {r.window for r in names} == {1, 2, 3}
    for r in names:
        a, b = low_high[r.window]
        pages = images.tiff_pages((tmp_path / "w" / r.name).read_bytes())
        assert len(pages) == r.planes == b[2] - a[2] + 1
        for k, page in enumerate(pages):
            want = [[cells.get((x, y, a[2] + k), 0) for x in range(a[0], b[0] + 1)] for y in range(a[1], b[1] + 1)]
            assert page.tolist() == want


def test_mrc_and_reduced_pages(spark, tmp_path):
    import struct

    v = np.arange(24, dtype="<u2").reshape(2, 3, 4)
    header = bytearray(1024)
    struct.pack_into("<4i", header, 0, 4, 3, 2, 6)
    struct.pack_into("<i", header, 92, 16)
    data = bytes(header) + b"\0" * 16 + v.tobytes()
    assert images.mrc_volume(data).tolist() == v.tolist()
    (tmp_path / "a.mrc").write_bytes(data)
    got = {(r.x, r.y, r.z): r.v for r in images.read_mrc(spark, str(tmp_path / "a.mrc")).collect()}
    assert got == {(x, y, z): int(v[z, y, x]) for x in range(4) for y in range(3) for z in range(2)}
    for bad in (data[:100], bytes(1024)):
        with pytest.raises(ValueError, match="not an MRC"):
            images.mrc_volume(bad)
    paged = images.tiff_bytes(*v)
    assert [p.tolist() for p in images.tiff_pages(paged)] == v.tolist()
    # mark the second page as a reduced copy: its first tag becomes 254 with value 1
    at = paged.rfind(struct.pack("<HHI", 256, 4, 1))
    thumb = paged[:at] + struct.pack("<HHII", 254, 4, 1, 1) + paged[at + 12 :]
    assert [p.tolist() for p in images.tiff_pages(thumb)] == v[:1].tolist()
