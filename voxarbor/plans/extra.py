"""More queries: coordinate algebra, meshes, windows, clusters, contractions, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.functions import coords
from voxarbor.operators import grid, matching, tables, tracing, trees
from voxarbor.sources import exports

from . import fixtures as fx
from .fixtures import IMG, K6, SEEDS, TREE, mask_sql
from .registry import register
from .tracing import _SEG, _TAB
from .volume import _cc_sql

XYZ = ["x", "y", "z"]


@register("coordinate_algebra", f"""WITH {SEEDS} SELECT seed_id, x + y AS added, x - y AS subtracted, x * z AS multiplied, CAST(trunc((x - 32) / 5.0) AS INTEGER) AS divided, CAST((x - 32) % 5 AS INTEGER) AS remainder,
  x < 40 AND y < 40 AND z < 20 AS all_less, x = y AND y = z AS all_equal, CAST(x * y * z AS BIGINT) AS product FROM s""")
def coordinate_algebra(spark, sf):
    x, y, z = (F.col(a) for a in XYZ)
    return fx.seeds(spark, sf).select("seed_id", (x + y).alias("added"), (x - y).alias("subtracted"), (x * z).alias("multiplied"), coords.trunc_div(x - 32, 5).alias("divided"), ((x - 32) % 5).alias("remainder"),
        ((x < 40) & (y < 40) & (z < 20)).alias("all_less"), ((x == y) & (y == z)).alias("all_equal"), (x * y * z).cast("long").alias("product"))


@register("unit_conversion", f"WITH {SEEDS} SELECT seed_id, CAST(round(x * 3 / 0.8) AS INTEGER) AS vx, CAST(round(z * 3 / 2.0) AS INTEGER) AS vz, 3 AS factor, CAST(3 * z + 2 AS INTEGER) AS last_plane FROM s")
def unit_conversion(spark, sf):
    f = coords.anisotropy((0.8, 0.8, 2.0))
    return fx.seeds(spark, sf).select("seed_id", coords.to_voxels(F.col("x") * 3, 0.8).alias("vx"), coords.to_voxels(F.col("z") * 3, 2.0).alias("vz"), F.lit(f).alias("factor"), (F.col("z") * f + f - 1).alias("last_plane"))


@register("visit_voxels", f"WITH {IMG} SELECT x, y, z, CASE WHEN v > 40 AND z % 2 = 0 THEN v * 10 ELSE v END AS v FROM img")
def visit_voxels(spark, sf):
    hit = (F.col("v") > 40) & (F.col("z") % 2 == 0)
    return fx.image(spark, sf).withColumn("v", F.when(hit, F.col("v") * 10).otherwise(F.col("v")))


@register("inner_soma_sample", f"WITH {SEEDS} SELECT seed_id, x, y, z FROM s WHERE x BETWEEN 4 AND 59 AND y BETWEEN 4 AND 59 AND z BETWEEN 2 AND 29")
def inner_soma_sample(spark, sf):
    """Somas away from the border; sampling with a share of 1 keeps all (see soma_sample)."""
    s = fx.seeds(spark, sf).where("x BETWEEN 4 AND 59 AND y BETWEEN 4 AND 59 AND z BETWEEN 2 AND 29")
    return s.select("seed_id", *XYZ)


@register("soma_sample", f"""WITH {SEEDS} SELECT seed_id, x, y, z FROM s
  WHERE CAST('0x' || substr(md5('7-' || seed_id), 1, 8) AS BIGINT) % 1000 < 300""")
def soma_sample(spark, sf):
    """Bernoulli sample by a hash of the id, so that reruns agree."""
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit("7-"), F.col("seed_id").cast("string"))), 1, 8), 16, 10).cast("long")
    return fx.seeds(spark, sf).where(drawn % 1000 < 300).select("seed_id", *XYZ)


@register("invalid_radii", f"WITH {TREE} SELECT id, CASE WHEN id % 9 = 0 THEN 0.0005 ELSE radius END AS radius FROM t WHERE id % 9 = 0")
def invalid_radii(spark, sf):
    t = fx.tree(spark, sf).withColumn("radius", F.when(F.col("id") % 9 == 0, 0.0005).otherwise(F.col("radius")))
    return t.where("radius < 0.001").select("id", "radius")


@register("component_mass", f"{_cc_sql(48, '1')} SELECT comp, count(*) AS mass, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM p JOIN lab USING (id) GROUP BY comp")
def component_mass(spark, sf):
    return grid.label(fx.mask(spark, sf, 48)).groupBy("comp").agg(F.count(F.lit(1)).alias("mass"), *(F.round(F.avg(a), 6).alias(a) for a in XYZ))


@register("cluster_bounds", f"""{_cc_sql(47, '1')}, {SEEDS}, h AS (SELECT comp, array_to_string(list_sort(list(seed_id)), ',') AS somas FROM p JOIN lab USING (id) JOIN s USING (x, y, z) GROUP BY comp)
  SELECT comp, count(*) AS voxels, min(x) AS xmin, max(x) + 1 AS xmax, min(y) AS ymin, max(y) + 1 AS ymax, min(z) AS zmin, max(z) + 1 AS zmax, any_value(h.somas) AS somas FROM p JOIN lab USING (id) JOIN h USING (comp) GROUP BY comp""")
def cluster_bounds(spark, sf):
    b = grid.cluster_bounds(grid.label(fx.mask(spark, sf, 47)), fx.seeds(spark, sf).select("seed_id", *XYZ))
    return b.withColumn("somas", F.concat_ws(",", F.transform("somas", lambda i: i.cast("string"))))


@register("component_windows", f"""{_cc_sql(47, '1')}, {SEEDS}, c AS (SELECT comp, min(x) AS ax, max(x) AS bx, min(y) AS ay, max(y) AS by_, min(z) AS az, max(z) AS bz FROM p JOIN lab USING (id) GROUP BY comp),
  h AS (SELECT comp, s.*, CAST(floor((3 + radius) / 0.5) AS INTEGER) AS rx, CAST(floor((3 + radius) / 1.0) AS INTEGER) AS rz FROM p JOIN lab USING (id) JOIN s USING (x, y, z))
  SELECT comp, least(min(ax), min(x - rx)) AS min_x, greatest(max(bx), max(x + rx)) AS max_x, least(min(ay), min(y - rx)) AS min_y, greatest(max(by_), max(y + rx)) AS max_y, least(min(az), min(z - rz)) AS min_z, greatest(max(bz), max(z + rz)) AS max_z FROM c JOIN h USING (comp) GROUP BY comp""")
def component_windows(spark, sf):
    labels = grid.materialise(grid.label(fx.mask(spark, sf, 47)))
    held = labels.join(fx.seeds(spark, sf), XYZ)
    return grid.windows(grid.summary(labels), held, 2.0, 1.0, (0.5, 0.5, 1.0))


@register("connected_attributes", f"""WITH RECURSIVE {IMG}, {mask_sql(40)}, {SEEDS}, {K6}, f(x, y, z, level) AS (SELECT m.x, m.y, m.z, 0 FROM m SEMI JOIN s USING (x, y, z)
  UNION SELECT m.x, m.y, m.z, level + 1 FROM f, k6 JOIN m ON m.x = f.x + dx AND m.y = f.y + dy AND m.z = f.z + dz WHERE level < 40 AND NOT EXISTS (SELECT 1 FROM s WHERE s.x = m.x AND s.y = m.y AND s.z = m.z)),
  l AS (SELECT x, y, z, min(level) AS level FROM f GROUP BY ALL),
  p AS (SELECT l.x, l.y, l.z, min({{'px': dx, 'py': dy, 'pz': dz}}) AS p FROM l, k6 JOIN l n ON n.x = l.x + dx AND n.y = l.y + dy AND n.z = l.z + dz WHERE n.level = l.level - 1 GROUP BY 1, 2, 3)
  SELECT l.x, l.y, l.z, level, (SELECT count(*) FROM m, k6 WHERE m.x = l.x + dx AND m.y = l.y + dy AND m.z = l.z + dz) < 6 AS surface, coalesce(p.px, 0) AS px, coalesce(p.py, 0) AS py, coalesce(p.pz, 0) AS pz FROM l LEFT JOIN p USING (x, y, z)""")
def connected_attributes(spark, sf):
    return grid.connected_attributes(fx.mask(spark, sf, 40), fx.seeds(spark, sf))


@register("surface_quads", f"""WITH {IMG}, {mask_sql(47)}, {K6} SELECT count(*) AS quads, count(*) * 2 AS triangles FROM m, k6 WHERE NOT EXISTS (SELECT 1 FROM m n WHERE n.x = m.x + dx AND n.y = m.y + dy AND n.z = m.z + dz)""")
def surface_quads(spark, sf):
    q = grid.materialise(grid.quads(fx.mask(spark, sf, 47)))
    return q.agg(F.count(F.lit(1)).alias("quads")).crossJoin(grid.triangles(q).agg(F.count(F.lit(1)).alias("triangles")))


@register("mesh_edges")
def mesh_edges(spark, sf):
    return grid.quad_edges(grid.quads(fx.mask(spark, sf, 48)))


@register("mesh_lines")
def mesh_lines(spark, sf):
    """OBJ lines of the mask's surface, vertices numbered in order of their keys."""
    q = grid.materialise(grid.quads(fx.mask(spark, sf, 49)))
    corners = tables.numbered(q.select(F.explode("v").alias("key")).distinct(), "key")
    at = lambda s: (F.shiftright("key", s).bitwiseAND((1 << 21) - 1) - (1 << 20)).cast("double")
    verts = corners.select("idx", at(0).alias("x"), at(21).alias("y"), at(42).alias("z"))
    f = q.select("x", "y", "z", "dx", "dy", "dz", F.posexplode("v").alias("k", "key")).join(corners, "key")
    f = f.groupBy("x", "y", "z", "dx", "dy", "dz").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "idx"))), lambda s: s.idx).alias("v"))
    f = tables.numbered(f, "z", "y", "x", "dx", "dy", "dz")
    return exports.obj_lines(verts, f.select("idx", "v"))


@register("merge_enclosed")
def merge_enclosed(spark, sf):
    return trees.merge_enclosed(fx.tree(spark, sf).withColumn("radius", F.col("radius") * 30))


@register("soma_sinks")
def soma_sinks(spark, sf):
    t = fx.tree(spark, sf).withColumn("radius", F.col("radius") * 20)
    return trees.soma_sinks(t, t.where("id % 211 = 1").select("id"))


@register("persistence_image", f"""WITH RECURSIVE {TREE}, {_SEG}, {_TAB}, g AS (SELECT i, j, sum(exp(-((birth - (i + 0.5) * 250) * (birth - (i + 0.5) * 250) + (death - (j + 0.5) * 250) * (death - (j + 0.5) * 250)) / 80000.0)) AS v FROM tab, range(8) a(i), range(8) b(j) GROUP BY 1, 2)
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(v / max(v) OVER (), 5) AS value FROM g""")
def persistence_image(spark, sf):
    t = tracing.segment_table(fx.tree(spark, sf))
    return trees.persistence_image(t, 8, 2000.0, 200.0).select("i", "j", F.round("value", 5).alias("value"))


@register("cluster_lines", f"WITH {SEEDS} SELECT (z - 1) || ',' || (z + 1) || ',' || (y - 1) || ',' || (y + 1) || ',' || (x - 1) || ',' || (x + 1) || ',1,' || z || ',' || y || ',' || x || ',' || seed_id AS line FROM s")
def cluster_lines(spark, sf):
    box = [e.alias(f"{a}{n}") for a in XYZ for n, e in (("min", F.col(a) - 1), ("max", F.col(a) + 1))]
    soma = F.array(F.struct("z", "y", "x", F.col("seed_id").alias("mass")))
    return exports.cluster_lines(fx.seeds(spark, sf).select(*box, soma.alias("somas")))


@register("marker_lines", f"WITH {SEEDS} SELECT 'marker_' || x || '_' || y || '_' || z || '_' || (seed_id + 5) AS name, x || ',' || y || ',' || z || ',' || radius AS line FROM s")
def marker_lines(spark, sf):
    return exports.marker_lines(fx.seeds(spark, sf).withColumn("volume", F.col("seed_id") + 5))


@register("apo_to_seeds", f"WITH {SEEDS} SELECT seed_id AS n, CAST(round(x * 0.4, 6) AS DOUBLE) AS x, CAST(round(y * 0.4, 6) AS DOUBLE) AS y, CAST(round(z * 0.4, 6) AS DOUBLE) AS z, CAST(seed_id * 7 + 1 AS DOUBLE) AS volume, round(cbrt(3.0 * (seed_id * 7 + 1) / (4 * pi())), 6) AS radius FROM s")
def apo_to_seeds(spark, sf):
    apo = fx.seeds(spark, sf).select(F.col("seed_id").alias("n"), *XYZ, (F.col("seed_id") * 7 + 1).alias("volsize"))
    s = exports.apo_to_seeds(apo, 0.4)
    return s.select("n", *(F.round(c, 6).alias(c) for c in XYZ), "volume", F.round("radius", 6).alias("radius"))


@register("name_match", f"WITH {SEEDS}, a AS (SELECT x, y, z FROM s WHERE seed_id % 2 = 0), b AS (SELECT x, y, z FROM s WHERE seed_id % 3 = 0) SELECT (SELECT count(*) FROM a JOIN b USING (x, y, z)) AS both_, (SELECT count(*) FROM a ANTI JOIN b USING (x, y, z)) AS only_a, (SELECT count(*) FROM b ANTI JOIN a USING (x, y, z)) AS only_b")
def name_match(spark, sf):
    """Two runs' files matched by the coordinates in their names."""
    s = fx.seeds(spark, sf)
    named = lambda k: s.where(f"seed_id % {k} = 0").select(coords.coords_in_name(F.concat_ws("-", F.lit("run"), *(F.col(c).cast("string") for c in XYZ))).alias("c"))
    a, b = named(2).withColumn("a", F.lit(1)), named(3).withColumn("b", F.lit(1))
    j = a.join(b, "c", "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both_"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


@register("standardise")
def standardise(spark, sf):
    """Resampling to edges of at most 20 and smoothing of the result's chain nodes."""
    parts = grid.materialise(trees.resample(fx.tree(spark, sf), 20.0))
    # the pieces of an edge form a chain from the node to its parent
    up = F.when(F.col("i") + 1 < F.col("n"), F.col("id") * 1000 + F.col("i") + 1)
    parent = fx.tree(spark, sf).select("id", "parent")
    chain = parts.join(parent, "id").select((F.col("id") * 1000 + F.col("i")).alias("id"), F.coalesce(up, F.col("parent") * 1000).alias("parent"), *XYZ, "radius")
    out = trees.smooth(chain, 1)
    return out.select("id", "parent", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")))


@register("scored_matches", f"WITH {SEEDS}, p AS (SELECT seed_id, x, y, z FROM s), q AS (SELECT seed_id, x + seed_id % 4 AS x, y, z FROM s) SELECT p.seed_id AS a, count(*) AS near FROM p JOIN q ON (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z) <= 36 GROUP BY 1")
def scored_matches(spark, sf):
    s = fx.seeds(spark, sf)
    p = s.select(F.col("seed_id").alias("a"), *XYZ)
    q = s.select(F.col("seed_id").alias("b"), (F.col("x") + F.col("seed_id") % 4).alias("x"), "y", "z")
    return matching.within(p, q, 6.0).groupBy("a").agg(F.count(F.lit(1)).alias("near"))


@register("quartiles", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def quartiles(spark, sf):
    q = lambda p: F.round(F.percentile("value", F.lit(p)), 6)
    return fx.read(spark, sf, "events").groupBy("event_type").agg(q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@register("trimmed_by_type", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT event_type, count(*) AS n FROM events, s WHERE abs(value - m) <= 1.5 * d GROUP BY 1")
def trimmed_by_type(spark, sf):
    return tables.trimmed(fx.read(spark, sf, "events"), "value", 1.5).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
