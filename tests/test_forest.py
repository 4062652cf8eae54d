"""Operators on trees, blocks and codes against plain versions of themselves."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from voxarbor.functions import storage
from voxarbor.operators import grid, tables, tracing, trees
from voxarbor.plans import fixtures as fx
from voxarbor.sources import images

XYZ = ["x", "y", "z"]


def test_block_levels_follow_a_tube(spark):
    """A path of over 15,000 voxels that winds through two blocks, and a ball beside it."""
    path, x, y = [], 0, 0
    for z in range(0, 32, 2):
        for row in range(16):
            path += [(i, y, z) for i in (range(0, 31) if x == 0 else range(30, -1, -1))]
            x = 30 - x
            step = 2 if z % 4 == 0 else -2
            if row < 15:
                path.append((x, y + step // 2, z))
                y += step
        path.append((x, y, z + 1))
    ends = path[-1]
    cells = set(path) | {(64 - i, j, k) for i, j, k in path} | {(i, ends[1], ends[2]) for i in range(ends[0], 65 - ends[0])}
    cells |= {(40 + i, 60 + j, 20 + k) for i in range(-5, 6) for j in range(-5, 6) for k in range(-5, 6) if i * i + j * j + k * k <= 25}
    assert len(cells) > 15_000
    start, want = [(0, 0, 0), (500, 500, 500)], {(0, 0, 0): 0}
    queue = deque([(0, 0, 0)])
    while queue:
        c = queue.popleft()
        for d in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)):
            n = tuple(a + b for a, b in zip(c, d, strict=True))
            if n in cells and n not in want:
                want[n] = want[c] + 1
                queue.append(n)
    mask = spark.createDataFrame(sorted(cells), "x int, y int, z int")
    got = grid.block_levels(mask, spark.createDataFrame(start, "x int, y int, z int")).collect()
    assert {(r.x, r.y, r.z): r.level for r in got} == want
    assert max(want.values()) > 10_000 and len(want) < len(cells)
    assert grid.block_levels(mask.limit(0), spark.createDataFrame(start, "x int, y int, z int")).count() == 0


def random_tree(rng, n, first=1):
    return [(first + i, None if i == 0 else first + rng.randrange(max(0, i - 6), i), *(float(rng.randrange(50)) for _ in XYZ), 1.0) for i in range(n)]


SCHEMA = "id long, parent long, x double, y double, z double, radius double"


def test_circle_of_parents_raises(spark):
    rows = [(1, None, 0.0, 0.0, 0.0, 1.0), (2, 4, 0.0, 0.0, 0.0, 1.0), (3, 2, 0.0, 0.0, 0.0, 1.0), (4, 3, 0.0, 0.0, 0.0, 1.0)]
    with pytest.raises(ValueError, match="circle"):
        trees.roots(spark.createDataFrame(rows, SCHEMA)).count()


def test_short_leaf_branches_go_until_none_is_left(spark):
    rng = random.Random(3)
    rows = random_tree(rng, 18)
    got = {r.id for r in trees.prune_leaf_branches(spark.createDataFrame(rows, SCHEMA), 3, "hops").collect()}
    parent = {r[0]: r[1] for r in rows}
    while True:
        kids = {i: [c for c in parent if parent[c] == i] for i in parent}
        branches = {}
        for leaf in (i for i in parent if not kids[i] and parent[i] is not None):
            path = [leaf]
            while len(kids[parent[path[-1]]]) == 1 and parent[parent[path[-1]]] is not None:
                path.append(parent[path[-1]])
            top = parent[path[-1]]
            if len(kids[top]) > 1 and len(path) < 3:
                branches.setdefault(top, []).append(path)
        gone = set()
        for top, paths in branches.items():
            paths.sort(key=lambda p: p[0])
            gone |= {i for p in (paths[:-1] if len(paths) == len(kids[top]) else paths) for i in p}
        if not gone:
            break
        parent = {i: p for i, p in parent.items() if i not in gone}
    assert got == set(parent)


def test_somas_claim_one_after_the_other(spark):
    """On a graph with circles: walks of one soma after the other, none into another soma."""
    rng = random.Random(9)
    edges = {(i, rng.randrange(max(0, i - 4), i)) for i in range(1, 36)} | {(rng.randrange(36), rng.randrange(36)) for _ in range(5)}
    edges = {(a, b) for a, b in edges if a != b}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    somas, claimed, level = [9, 18, 27], {}, {}
    for s in somas:
        claimed[s], level[s], queue = s, 0, deque([s])
        while queue:
            c = queue.popleft()
            for n in near[c]:
                if n not in claimed and n not in somas:
                    claimed[n], level[n] = s, level[c] + 1
                    queue.append(n)
    both = [e for a, b in edges for e in ((a, b), (b, a))]
    got = trees.claim(spark.createDataFrame(both, "src long, dst long").distinct(), spark.createDataFrame([(s,) for s in somas], "id long")).collect()
    assert {r.id: (r.soma, r.level) for r in got} == {i: (claimed[i], level[i]) for i in claimed}
    for r in got:
        assert (r.parent is None) == (r.id in somas)
        assert r.parent is None or (r.parent in near[r.id] and level[r.parent] == r.level - 1 and claimed[r.parent] == r.soma)


def test_helpers_of_multifurcations_have_their_own_ids(spark):
    rows = [(0, None), (1, 0), *((2_000_000 + i, 1) for i in range(6)), *((10 + i, 2_000_003) for i in range(5))]
    t = spark.createDataFrame([(i, p, 0.0, 0.0, 0.0, 1.0) for i, p in rows], SCHEMA)
    got = tracing.split_multifurcations(t).collect()
    assert len({r.id for r in got}) == len(got) == len(rows) + 4 + 3
    kids = {}
    for r in got:
        kids.setdefault(r.parent, []).append(r.id)
    assert all(len(k) <= 2 for p, k in kids.items() if p not in (None, 0))


def test_numbered_has_no_gap(spark):
    df = spark.createDataFrame([(i * 37 % 101,) for i in range(300)], "k long").repartition(7)
    got = sorted((r.idx, r.k) for r in tables.numbered(df, "k").collect())
    assert [i for i, _ in got] == list(range(300)) and [k for _, k in got] == sorted(k for _, k in got)


def test_parent_outside_raises(spark):
    with pytest.raises(ValueError, match="no distribution"):
        tables.PolynomialDistribution.from_json("{}", "x")
    d = tables.PolynomialDistribution([1.0], 0.0, 1.0)
    low, high = spark.range(1).select(d.cdf(F.lit(0.0)), d.tail(F.lit(0.0))).first()
    assert abs(low) < 1e-12 and abs(high - 1) < 1e-12


def test_steps_and_names():
    assert grid.morphology_steps(1.0, False) == {"close": 7, "open": 5, "smooth": 1, "coarsen": 0}
    assert grid.morphology_steps(0.5, True)["close"] == 3


def lzw_encode(data: bytes) -> bytes:
    table, out, width, bits, n = {bytes([i]): i for i in range(256)}, bytearray(), 9, 0, 0

    def put(code):
        nonlocal bits, n
        bits, n = bits << width | code, n + width
        while n >= 8:
            n -= 8
            out.append(bits >> n & 255)
            bits &= (1 << n) - 1

    put(256)
    size, seen = 258, b""
    for byte in data:
        if seen + bytes([byte]) in table:
            seen += bytes([byte])
            continue
        put(table[seen])
        table[seen + bytes([byte])] = size
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
        if size == 4094:
            put(256)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        seen = bytes([byte])
    if seen:
        put(table[seen])
    put(257)
    if n:
        out.append(bits << (8 - n) & 255)
    return bytes(out)


def test_lzw_of_all_widths():
    rng = random.Random(1)
    data = bytes(rng.choice((0, 1, 7, 200, 255)) for _ in range(40_000))
    assert images.lzw_decode(lzw_encode(data)) == data
    with pytest.raises(ValueError, match="LZW"):
        images.lzw_decode(bytes([0xFF, 0xFF, 0xFF]))


def test_released_tables_are_gone(spark):
    df = storage.materialise(spark.range(5).toDF("a"))
    at = df.inputFiles()[0].removeprefix("file://")
    storage.release(df)
    with pytest.raises(FileNotFoundError):
        open(at)


def test_face_balls_and_polygons(spark):
    one = spark.createDataFrame([(0, 0, 0, 2)], "x int, y int, z int, radius int")
    assert grid.hop_balls(one).count() == 25
    with pytest.raises(Exception, match="corners"):
        grid.polygon_quads(spark.createDataFrame([([1, 2, 3],)], "v array<long>")).collect()
    assert fx.KEY
