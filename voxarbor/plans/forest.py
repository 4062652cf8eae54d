"""Queries on trees of several somas, chunked volumes, distributions and scores that need both
directions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxarbor.functions import coords
from voxarbor.operators import grid, matching, tables, trees

from . import fixtures as fx
from .fixtures import IMG, K6, SEEDS, TREE, mask_sql
from .registry import register
from .trees import _NB
from .volume import _BALLS, _cc_sql

XYZ = ["x", "y", "z"]

#: Walks from every 97th node that never turn back nor enter another such node; the smallest
#: start owns a node.
_CLAIM = f"""{TREE}, {_NB}, w(soma, id, prev, level) AS (
    SELECT id, id, CAST(NULL AS BIGINT), 0 FROM t WHERE id % 97 = 0
    UNION ALL
    SELECT w.soma, nb.v, w.id, w.level + 1 FROM w JOIN nb ON nb.u = w.id
    WHERE nb.v IS DISTINCT FROM w.prev AND nb.v % 97 <> 0),
  own AS (SELECT id, min(soma) AS soma FROM w GROUP BY id),
  c AS (SELECT w.soma, w.id, w.prev AS parent, w.level FROM w JOIN own USING (id, soma))"""


def _claimed(spark, sf):
    t = fx.tree(spark, sf)
    return t, trees.claim(trees.undirected(t), t.where("id % 97 = 0").select("id"))


@register("claimed_trees", f"WITH RECURSIVE {_CLAIM} SELECT soma, id, parent, level FROM c")
def claimed_trees(spark, sf):
    return _claimed(spark, sf)[1]


@register("claimed_swc_lines", f"""WITH RECURSIVE {_CLAIM},
  n AS (SELECT *, row_number() OVER (PARTITION BY soma ORDER BY level, id) AS n FROM c)
  SELECT n.soma, n.n, printf('%d %d %.3f %.3f %.3f %.3f %d', n.n, CASE WHEN n.parent IS NULL THEN 1 ELSE 3 END,
    t.x, t.y, t.z, t.radius, coalesce(p.n, -1)) AS line
  FROM n JOIN t USING (id) LEFT JOIN n p ON p.soma = n.soma AND p.id = n.parent""")
def claimed_swc_lines(spark, sf):
    t, c = _claimed(spark, sf)
    return trees.claimed_lines(c, t).withColumn("n", F.col("n").cast("long"))


@register("offset_names", f"""WITH {SEEDS} SELECT seed_id, printf('[%.3f,%.3f,%.3f]-r=%.3f-offset=(%.3f,%.3f,%.3f)-µm',
  x * 0.5, y * 0.5, z * 2.0, radius * 0.5, (x - 4) * 0.5, (y - 4) * 0.5, (z - 4) * 2.0) AS name FROM s""")
def offset_names(spark, sf):
    """File names of trees cut out of a volume: place, radius and the window's corner."""
    voxel = (0.5, 0.5, 2.0)
    at = [F.col(a) * v for a, v in zip(XYZ, voxel, strict=True)]
    corner = [(F.col(a) - 4) * v for a, v in zip(XYZ, voxel, strict=True)]
    name = F.format_string("[%.3f,%.3f,%.3f]-r=%.3f-offset=(%.3f,%.3f,%.3f)-µm", *at, F.col("radius") * min(voxel), *corner)
    return fx.seeds(spark, sf).select("seed_id", name.alias("name"))


@register("prune_short_leaves")
def prune_short_leaves(spark, sf):
    t = fx.tree(spark, sf)
    return trees.prune_leaf_branches(t, 3, "hops", t.where("parent IS NULL").select("id")).select("id", "parent")


@register("prune_to_convergence")
def prune_to_convergence(spark, sf):
    return trees.prune_leaf_branches(fx.tree(spark, sf), 150.0).select("id", "parent")


@register("scaled_trees", f"""WITH {TREE} SELECT id, type, round(x * 0.201, 3) AS x, round(y * 0.201, 3) AS y,
  round(z * 0.998, 3) AS z, round(radius * 0.201, 5) AS radius, parent FROM t""")
def scaled_trees(spark, sf):
    """Tree files in micrometres: three decimals of places, five of radii."""
    by = {"x": 0.201, "y": 0.201, "z": 0.998}
    cols = {c: F.round(F.col(c) * f, 3) for c, f in by.items()} | {"radius": F.round(F.col("radius") * 0.201, 5)}
    return fx.tree(spark, sf).withColumns(cols)


@register("half_stencils", f"""WITH {IMG}, {mask_sql(40)}, {K6}, j AS (SELECT m.x, m.y, m.z, dx + dy + dz AS side
  FROM m, k6 JOIN m n ON n.x = m.x + dx AND n.y = m.y + dy AND n.z = m.z + dz)
  SELECT x, y, z, count(*) FILTER (side < 0) AS lower, count(*) FILTER (side > 0) AS upper FROM j GROUP BY ALL""")
def half_stencils(spark, sf):
    """Active neighbours before and after each voxel: the two halves of the face stencil."""
    mask = fx.mask(spark, sf, 40)
    sides = []
    for sign, name in ((-1, "lower"), (1, "upper")):
        cells = [tuple(sign * int(i == k) for i in range(3)) for k in range(3)]
        # a neighbour on one side of a voxel sees it on the other
        sides.append(grid.shift(mask, [tuple(-c for c in cell) for cell in cells]).withColumn("side", F.lit(name)))
    seen = sides[0].unionByName(sides[1]).groupBy(*XYZ).agg(*(F.count_if(F.col("side") == n).alias(n) for n in ("lower", "upper")))
    return seen.join(mask, XYZ, "left_semi")


@register("revisit_count", f"""WITH RECURSIVE {IMG}, {mask_sql(40)}, {SEEDS}, {K6}, f(x, y, z) AS (SELECT m.x, m.y, m.z FROM m SEMI JOIN s USING (x, y, z)
  UNION SELECT m.x, m.y, m.z FROM f, k6 JOIN m ON m.x = f.x + dx AND m.y = f.y + dy AND m.z = f.z + dz),
  looks AS (SELECT count(*) AS n FROM f, k6 JOIN f g ON g.x = f.x + dx AND g.y = f.y + dy AND g.z = f.z + dz),
  starts AS (SELECT count(*) AS n FROM (SELECT DISTINCT m.x, m.y, m.z FROM m SEMI JOIN s USING (x, y, z)))
  SELECT count(*) AS reached, (SELECT n FROM looks) - count(*) + (SELECT n FROM starts) AS revisits FROM f""")
def revisit_count(spark, sf):
    return grid.revisits(fx.mask(spark, sf, 40), fx.seeds(spark, sf))


@register("chunked_mass", f"""{_cc_sql(48, '1')} SELECT comp, count(*) AS mass, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z
  FROM p JOIN lab USING (id) GROUP BY comp""")
def chunked_mass(spark, sf):
    """Centres of components from those of eight-plane chunks, merged by mass."""
    labels = grid.label(fx.mask(spark, sf, 48))
    parts = labels.groupBy("comp", F.floor(F.col("z") / 8)).agg(F.count(F.lit(1)).alias("mass"), *(F.avg(a).alias(a) for a in XYZ))
    return tables.merged_mass(parts).select("comp", "mass", *(F.round(a, 6).alias(a) for a in XYZ))


@register("radius_cdf", f"""WITH {TREE}, b AS (SELECT CAST(floor(radius / 0.5) AS BIGINT) AS bin, count(*) AS n FROM t GROUP BY 1)
  SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS share FROM b""")
def radius_cdf(spark, sf):
    return tables.cumulative_histogram(fx.tree(spark, sf), "radius", 0.5).withColumn("share", F.round("share", 6))


@register("l1_coverage", f"""WITH {SEEDS}, r(i) AS (SELECT CAST(range - 3 AS INTEGER) FROM range(7)),
  b AS (SELECT x + p.i AS x, y + q.i AS y, z + w.i AS z FROM s, r p, r q, r w WHERE abs(p.i) + abs(q.i) + abs(w.i) <= s.radius)
  SELECT x, y, z, count(*) AS n FROM b GROUP BY ALL""")
def l1_coverage(spark, sf):
    """How many balls in face hops cover each voxel."""
    return grid.hop_balls(fx.seeds(spark, sf)).groupBy(*(F.col(f"v{a}").alias(a) for a in XYZ)).agg(F.count(F.lit(1)).alias("n"))


@register("grid_compression", f"""WITH {IMG}, {mask_sql(45)}, b AS (SELECT count(*) AS active,
  CAST(max(x) - min(x) + 1 AS BIGINT) * (max(y) - min(y) + 1) * (max(z) - min(z) + 1) AS box FROM m)
  SELECT active, box, round(100.0 * active / box, 6) AS foreground, round(box * 2 / (active * 14.0), 6) AS compression, round(active * 14.0 / box, 6) AS bytes_per_cell FROM b""")
def grid_compression(spark, sf):
    """Active voxels against their bounding box, at 14 bytes a row and 2 bytes a dense cell."""
    side = [(F.max(a) - F.min(a) + 1).cast("long") for a in XYZ]
    b = fx.mask(spark, sf, 45).agg(F.count(F.lit(1)).alias("active"), (side[0] * side[1] * side[2]).alias("box"))
    held = F.col("active") * F.lit(14.0)
    return b.select("active", "box", F.round(100.0 * F.col("active") / F.col("box"), 6).alias("foreground"),
                    F.round(F.col("box") * 2 / held, 6).alias("compression"), F.round(held / F.col("box"), 6).alias("bytes_per_cell"))


@register("remove_positions", f"""WITH {TREE}, g AS (SELECT DISTINCT x, y, z FROM t WHERE id % 13 = 5), k AS (SELECT id FROM t ANTI JOIN g USING (x, y, z)),
  e AS (SELECT id AS src, CASE WHEN id % 41 = 0 THEN id ELSE parent END AS dst FROM t WHERE parent IS NOT NULL)
  SELECT src, dst, src = dst AS self_loop FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)""")
def remove_positions(spark, sf):
    """Edges left when the nodes at some positions go; loops of a node with itself are marked."""
    t = fx.tree(spark, sf)
    kept = t.join(t.where("id % 13 = 5").select(*XYZ).distinct(), XYZ, "left_anti").select("id")
    e = t.where("parent IS NOT NULL").select(F.col("id").alias("src"), F.when(F.col("id") % 41 == 0, F.col("id")).otherwise(F.col("parent")).alias("dst"))
    for c in ("src", "dst"):
        e = e.join(kept.select(F.col("id").alias(c)), c, "left_semi")
    return e.select("src", "dst", (F.col("src") == F.col("dst")).alias("self_loop"))


@register("many_trees", f"""WITH RECURSIVE {TREE}, f AS (SELECT 'a' AS file, id, parent FROM t WHERE id <= 40
    UNION ALL SELECT 'b', id, CASE WHEN id = 20 THEN NULL ELSE parent END FROM t WHERE id <= 60),
  o AS (SELECT file, id + CASE file WHEN 'b' THEN 40 ELSE 0 END AS id, parent + CASE file WHEN 'b' THEN 40 ELSE 0 END AS parent FROM f),
  r(id, root) AS (SELECT id, id FROM o WHERE parent IS NULL UNION ALL SELECT o.id, root FROM r JOIN o ON o.parent = r.id)
  SELECT file, o.id, parent, root FROM o JOIN r USING (id)""")
def many_trees(spark, sf):
    """Files of trees under one numbering, and the tree each node is in."""
    t = fx.tree(spark, sf).select("id", "parent")
    a = t.where("id <= 40").select(F.lit("a").alias("file"), "id", "parent")
    b = t.where("id <= 60").select(F.lit("b").alias("file"), "id", F.when(F.col("id") != 20, F.col("parent")).alias("parent"))
    return trees.load_many(a.unionByName(b)).select("file", "id", "parent", "root")


_JSON = '{"region": {"coefficients": [0.02, -0.1, 0.05, 0.6], "mean": 1.2, "std": 0.7}}'
_P = "(v * v * v * 0.02 - v * v * 0.1 + v * 0.05 + 0.6)"
_I = "(v * v * v * v * 0.02 / 4 - v * v * v * 0.1 / 3 + v * v * 0.05 / 2 + v * 0.6)"


def _at(sql: str, angle: str) -> str:
    return f"(SELECT {sql} FROM (SELECT ({angle} - 1.2) / 0.7 AS v))"


@register("angle_distribution", f"""WITH {TREE}, a AS (SELECT id, (id % 314) / 100.0::DOUBLE AS angle FROM t), n AS (SELECT {_at(_I, 'pi()')} - {_at(_I, '0.0')} AS total, {_at(_I, '0.0')} AS low),
  q AS (SELECT id, (angle - 1.2) / 0.7 AS v FROM a)
  SELECT id, round({_P} / total, 6) AS density, round(({_I} - low) / total, 6) AS below, round(1 - ({_I} - low) / total, 6) AS tail FROM q, n""")
def angle_distribution(spark, sf):
    """Density, distribution and tail of a polynomial read from JSON."""
    d = tables.PolynomialDistribution.from_json(_JSON, "region")
    a = (F.col("id") % 314) / F.lit(100.0)
    return fx.tree(spark, sf).select("id", F.round(d.pdf(a), 6).alias("density"), F.round(d.cdf(a), 6).alias("below"), F.round(d.tail(a), 6).alias("tail"))


_STEP = 40.0
_DIST = "sqrt((p.x - t.x) * (p.x - t.x) + (p.y - t.y) * (p.y - t.y) + (p.z - t.z) * (p.z - t.z))"


@register("distance_both_ways", f"""WITH {TREE},
  e AS (SELECT t.*, p.x AS px, p.y AS py, p.z AS pz, CASE WHEN {_DIST} > {_STEP} THEN CAST(pow(2, ceil(round(log2({_DIST} / {_STEP}), 9))) AS INTEGER) ELSE 1 END AS n FROM t LEFT JOIN t p ON p.id = t.parent),
  s AS (SELECT id, CASE WHEN i = 0 THEN x ELSE x + (px - x) * i / n END AS x, CASE WHEN i = 0 THEN y ELSE y + (py - y) * i / n END AS y, CASE WHEN i = 0 THEN z ELSE z + (pz - z) * i / n END AS z FROM e, range(64) r(i) WHERE i < n),
  a AS (SELECT row_number() OVER () AS k, * FROM s WHERE id % 3 <> 0), b AS (SELECT row_number() OVER () AS k, * FROM s WHERE id % 2 = 0)
  SELECT 'completeness' AS score, (SELECT count(*) FROM a) AS nodes, (SELECT count(DISTINCT a.k) FROM a JOIN b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 16) AS matched
  UNION ALL SELECT 'correctness', (SELECT count(*) FROM b), (SELECT count(DISTINCT b.k) FROM a JOIN b ON (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z) <= 16)""")
def distance_both_ways(spark, sf):
    """Of two resampled trees, the nodes of each that have one of the other within reach."""
    s = grid.materialise(trees.resample(fx.tree(spark, sf), _STEP))
    a, b = (s.where(w).select((F.col("id") * (1 << 20) + F.col("i")).alias("k"), *XYZ) for w in ("id % 3 <> 0", "id % 2 = 0"))
    out = None
    for name, one, other in (("completeness", a, b), ("correctness", b, a)):
        hit = matching.reached(one.withColumnRenamed("k", "a"), other.withColumnRenamed("k", "b"), 4.0)
        row = one.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(hit.agg(F.count(F.lit(1)).alias("matched"))).select(F.lit(name).alias("score"), "nodes", "matched")
        out = row if out is None else out.unionByName(row)
    return out


@register("skeleton_in_surface", f"""WITH {IMG}, {mask_sql(3)}, {K6}, {TREE}, q AS (SELECT m.x, m.y, m.z FROM m, k6 JOIN m n ON n.x = m.x + dx AND n.y = m.y + dy AND n.z = m.z + dz GROUP BY ALL HAVING count(*) = 6)
  SELECT count(*) AS nodes, count(q.x) AS inside, round(count(q.x) / count(*), 6) AS fraction FROM t LEFT JOIN q ON q.x = CAST(t.x AS INTEGER) AND q.y = CAST(t.y AS INTEGER) AND q.z = CAST(t.z AS INTEGER)""")
def skeleton_in_surface(spark, sf):
    """Nodes strictly within the surface of the mask: in it and not on its skin."""
    t = fx.tree(spark, sf).select(*(F.round(a).cast("int").alias(a) for a in XYZ))
    j = t.join(grid.erode(fx.mask(spark, sf, 3)).withColumn("on", F.lit(1)), XYZ, "left")
    return j.agg(F.count(F.lit(1)).alias("nodes"), F.count("on").alias("inside"), F.round(F.count("on") / F.count(F.lit(1)), 6).alias("fraction"))


@register("split_polygons", f"""WITH {SEEDS}, p AS (SELECT seed_id, [4, 6, 8][1 + seed_id % 3] AS n FROM s),
  q(n, k, a, b, c, d) AS (VALUES (4, 0, 0, 1, 2, 3), (6, 0, 0, 1, 2, 3), (6, 1, 0, 3, 4, 5), (8, 0, 0, 1, 2, 3), (8, 1, 3, 4, 7, 0), (8, 2, 4, 5, 6, 7))
  SELECT seed_id, k, seed_id * 10 + a AS a, seed_id * 10 + b AS b, seed_id * 10 + c AS c, seed_id * 10 + d AS d FROM p JOIN q USING (n)""")
def split_polygons(spark, sf):
    """Polygons of four, six or eight corners as quads."""
    n = F.element_at(F.array(F.lit(4), F.lit(6), F.lit(8)), (F.col("seed_id") % 3 + 1).cast("int"))
    p = fx.seeds(spark, sf).select("seed_id", F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col("seed_id") * 10 + i).alias("v"))
    return grid.polygon_quads(p).select("seed_id", "k", *(F.col("quad")[i].alias(c) for i, c in enumerate("abcd")))


@register("forced_soma_edges", f"""WITH {TREE}, {SEEDS}, h AS (SELECT t.id, -min(s.seed_id) AS into_ FROM t JOIN s ON (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z) <= 225 GROUP BY 1),
  n AS (SELECT id, x, y, z, radius FROM t WHERE id NOT IN (SELECT id FROM h) UNION ALL SELECT -seed_id, x, y, z, radius FROM s),
  d AS (SELECT id AS src, parent AS dst FROM t WHERE parent IS NOT NULL UNION SELECT parent, id FROM t WHERE parent IS NOT NULL),
  e AS (SELECT DISTINCT coalesce(a.into_, src) AS src, coalesce(b.into_, dst) AS dst FROM d LEFT JOIN h a ON a.id = src LEFT JOIN h b ON b.id = dst)
  SELECT src, dst, round(p.radius, 6) AS src_radius, round(q.radius, 6) AS dst_radius, round(sqrt((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z)), 5) AS length
  FROM e JOIN n p ON p.id = src JOIN n q ON q.id = dst WHERE src < dst""")
def forced_soma_edges(spark, sf):
    t, s = fx.tree(spark, sf), fx.seeds(spark, sf)
    held = matching.smallest(t.select(F.col("id").alias("a"), *XYZ), s.select(F.col("seed_id").alias("b"), *XYZ), 15.0).select(F.col("b").alias("soma"), F.col("a").alias("id"))
    place = [F.col(a).cast("double").alias(a) for a in (*XYZ, "radius")]
    n, e = trees.forced_somas(t, s.select(F.col("seed_id").alias("soma"), *place), held)
    for c in ("src", "dst"):
        e = e.join(n.select(F.col("id").alias(c), *(F.col(a).alias(f"{c}_{a}") for a in (*XYZ, "radius"))), c)
    length = F.sqrt(sum((F.col(f"src_{a}") - F.col(f"dst_{a}")) * (F.col(f"src_{a}") - F.col(f"dst_{a}")) for a in XYZ))
    return e.select("src", "dst", F.round("src_radius", 6).alias("src_radius"), F.round("dst_radius", 6).alias("dst_radius"), F.round(length, 5).alias("length"))


@register("stamp_resampled", f"""WITH {TREE}, e AS (SELECT t.*, p.x AS px, p.y AS py, p.z AS pz, p.radius AS pr, CASE WHEN {_DIST} > 1.0 THEN CAST(pow(2, ceil(round(log2({_DIST}), 9))) AS INTEGER) ELSE 1 END AS n FROM t LEFT JOIN t p ON p.id = t.parent WHERE t.id <= 30),
  k AS (SELECT DISTINCT CAST(round(CASE WHEN i = 0 THEN x ELSE x + (px - x) * i / n END, 0) AS INTEGER) AS x, CAST(round(CASE WHEN i = 0 THEN y ELSE y + (py - y) * i / n END, 0) AS INTEGER) AS y,
    CAST(round(CASE WHEN i = 0 THEN z ELSE z + (pz - z) * i / n END, 0) AS INTEGER) AS z FROM e, range(512) r(i) WHERE i < n),
  o(i) AS (SELECT CAST(range - 2 AS INTEGER) FROM range(5))
  SELECT DISTINCT k.x + a.i AS x, k.y + b.i AS y, k.z + c.i AS z FROM k, o a, o b, o c WHERE a.i * a.i + b.i * b.i + c.i * c.i <= 4""")
def stamp_resampled(spark, sf):
    """A tree's first thirty nodes, resampled to one voxel, as balls of two voxels in a mask."""
    parts = trees.resample(fx.tree(spark, sf).where("id <= 30"), 1.0)
    n = parts.select(*(F.round(a).cast("int").alias(a) for a in XYZ)).distinct().withColumn("radius", F.lit(2))
    return grid.balls(n).select(*(F.col(f"v{a}").alias(a) for a in XYZ)).distinct()


@register("scaled_patches", f"""WITH {IMG}, {SEEDS}, w(scale) AS (VALUES (1), (2), (4)), o(i) AS (SELECT CAST(range - 4 AS INTEGER) FROM range(8)),
  c AS (SELECT seed_id, scale, s.x + a.i * scale AS x, s.y + b.i * scale AS y, z FROM s, w, o a, o b)
  SELECT seed_id, scale, count(*) AS cells, CAST(sum(coalesce(v, 0)) AS BIGINT) AS total, count(v) AS filled FROM c LEFT JOIN img USING (x, y, z) GROUP BY ALL""")
def scaled_patches(spark, sf):
    """Eight by eight cells around each seed at three scales; zero where the image ends."""
    return grid.scaled_patches(fx.image(spark, sf), fx.seeds(spark, sf), 8, (1, 2, 4)).groupBy("seed_id", "scale").agg(
        F.count(F.lit(1)).alias("cells"), F.sum(F.coalesce("v", F.lit(0))).alias("total"), F.count("v").alias("filled"))


@register("repaired_parents", f"""WITH {TREE}, c AS (SELECT id, parent, row_number() OVER (ORDER BY id) - 1 AS idx FROM t WHERE id <= 500)
  SELECT c.idx, p.idx AS parent_idx FROM c LEFT JOIN c p ON p.id = c.parent""")
def repaired_parents(spark, sf):
    """A cluster's parents as positions in it; a parent outside raises."""
    c = tables.numbered(fx.tree(spark, sf).where("id <= 500").select("id", "parent"), "id")
    p = c.select(F.col("id").alias("parent"), F.col("idx").alias("parent_idx"))
    outside = F.raise_error(F.concat(F.lit("parent outside the cluster: node "), F.col("id").cast("string"))).cast("long")
    found = F.when(F.col("parent").isNull() | F.col("parent_idx").isNotNull(), F.col("parent_idx")).otherwise(outside)
    return c.join(p, "parent", "left").select("idx", found.alias("parent_idx"))


@register("population_image", f"""WITH {TREE}, b AS (SELECT id % 3 AS g, CAST(id % 50 AS DOUBLE) AS birth, CAST(id % 80 AS DOUBLE) AS death FROM t),
  v AS (SELECT g, i, j, sum(exp(-((birth - (i + 0.5) * 20) * (birth - (i + 0.5) * 20) + (death - (j + 0.5) * 20) * (death - (j + 0.5) * 20)) / 800.0)) AS v FROM b, range(4) a(i), range(4) c(j) GROUP BY ALL),
  n AS (SELECT g, i, j, v / max(v) OVER (PARTITION BY g) AS v FROM v), m AS (SELECT i, j, avg(v) AS mean FROM n GROUP BY ALL)
  SELECT g, round(sum(abs(v - mean)), 5) AS difference FROM n JOIN m USING (i, j) GROUP BY g""")
def population_image(spark, sf):
    """How far each group's persistence image lies from the mean image of all groups."""
    b = fx.tree(spark, sf).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).cast("double").alias("birth"), (F.col("id") % 80).cast("double").alias("death"))
    images = None
    for g in range(3):
        one = trees.persistence_image(b.where(F.col("g") == g), 4, 80.0, 20.0).withColumn("g", F.lit(g).cast("long"))
        images = one if images is None else images.unionByName(one)
    images = grid.materialise(images)
    mean = images.groupBy("i", "j").agg(F.avg("value").alias("mean"))
    return images.join(mean, ["i", "j"]).groupBy("g").agg(F.round(F.sum(F.abs(F.col("value") - F.col("mean"))), 5).alias("difference"))
