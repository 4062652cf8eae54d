"""Queries on signed distance fields, coverage, windows and synthetic images."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.functions import coords
from voxarbor.operators import grid, synthetic, trees

from . import fixtures as fx
from .fixtures import IMG, K6, KEY, SEEDS, mask_sql
from .forest import stamp_resampled  # noqa: F401  (its SQL is used below)
from .registry import ORACLES, register
from .volume import _BALLS, _erode_sql

XYZ = ["x", "y", "z"]

_FIELD = f"""{_BALLS}, field AS (SELECT bb.x, bb.y, bb.z,
    min(sqrt((bb.x-s.x)*(bb.x-s.x) + (bb.y-s.y)*(bb.y-s.y) + (bb.z-s.z)*(bb.z-s.z)) - s.radius) AS sdf
  FROM bb JOIN s USING (seed_id) GROUP BY 1, 2, 3)"""


@register("mask_sdf", f"""WITH {IMG}, {mask_sql(25)}, {K6}, {_erode_sql('m', 'e1')}, {_erode_sql('e1', 'e2')}, {_erode_sql('e2', 'e3')},
  d1 AS (SELECT DISTINCT m.x + dx AS x, m.y + dy AS y, m.z + dz AS z FROM m, k6),
  o1 AS (SELECT * FROM d1 EXCEPT SELECT * FROM m),
  d2 AS (SELECT DISTINCT o1.x + dx AS x, o1.y + dy AS y, o1.z + dz AS z FROM o1, k6),
  o2 AS (SELECT * FROM d2 EXCEPT SELECT * FROM m EXCEPT SELECT * FROM o1),
  u AS (SELECT *, 1.5 AS sdf FROM o2 UNION ALL SELECT *, 0.5 FROM o1
    UNION ALL SELECT *, -0.5 FROM (SELECT * FROM m EXCEPT SELECT * FROM e1)
    UNION ALL SELECT *, -1.5 FROM (SELECT * FROM e1 EXCEPT SELECT * FROM e2)
    UNION ALL SELECT *, -2.5 FROM (SELECT * FROM e2 EXCEPT SELECT * FROM e3) UNION ALL SELECT *, -3.5 FROM e3)
  SELECT x, y, z, CAST(sdf AS DOUBLE) AS sdf FROM u""")
def mask_sdf(spark, sf):
    return grid.signed_hops(fx.mask(spark, sf, 25), 2)


@register("interior_count", f"WITH {_FIELD} SELECT count(*) FILTER (sdf < 0) AS inside, count(*) AS voxels FROM field")
def interior_count(spark, sf):
    field = grid.ball_field(fx.seeds(spark, sf))
    return field.agg(F.count_if(F.col("sdf") < 0).alias("inside"), F.count(F.lit(1)).alias("voxels"))


@register("sdf_components", f"""WITH RECURSIVE {_FIELD}, {K6}, p AS (SELECT {KEY} AS id, x, y, z FROM field WHERE sdf < 0),
  e AS MATERIALIZED (SELECT a.id AS u, b.id AS v FROM p a, k6 JOIN p b ON b.x = a.x + dx AND b.y = a.y + dy AND b.z = a.z + dz),
  reach(u, v) AS (SELECT id, id FROM p UNION SELECT r.u, e.v FROM reach r JOIN e ON e.u = r.v),
  lab AS (SELECT u AS id, min(v) AS comp FROM reach GROUP BY u)
  SELECT x, y, z, comp FROM p JOIN lab USING (id)""")
def sdf_components(spark, sf):
    """Components of what is strictly inside the seeds' spheres."""
    return grid.label(grid.interior(grid.ball_field(fx.seeds(spark, sf))))


@register("tree_surface", f"""WITH st AS ({ORACLES['stamp_resampled']}), {K6}
  SELECT st.x, st.y, st.z, dx, dy, dz FROM st, k6 WHERE NOT EXISTS (
    SELECT 1 FROM st o WHERE o.x = st.x + dx AND o.y = st.y + dy AND o.z = st.z + dz)""")
def tree_surface(spark, sf):
    """The open faces around a tree's first thirty nodes, resampled and stamped as balls."""
    parts = trees.resample(fx.tree(spark, sf).where("id <= 30"), 1.0)
    n = parts.select(*(F.round(a).cast("int").alias(a) for a in XYZ)).distinct().withColumn("radius", F.lit(2))
    return grid.faces(grid.balls(n).select(*(F.col(f"v{a}").alias(a) for a in XYZ)).distinct())


@register("plane_keep", f"""WITH {IMG}, p AS (SELECT z, quantile_cont(v, 0.9) AS p FROM img GROUP BY z)
  SELECT x, y, z, v FROM img JOIN p USING (z) WHERE v >= p AND v > 0""")
def plane_keep(spark, sf):
    """Voxels at or above their plane's 90th percentile and above zero."""
    img = fx.image(spark, sf)
    p = img.groupBy("z").agg(F.percentile("v", F.lit(0.9)).alias("p"))
    return img.join(p, "z").where("v >= p AND v > 0").select(*XYZ, "v")


@register("coverage_prune")
def coverage_prune(spark, sf):
    """What coverage leaves of a dense mask's voxels, by their hops from the surface."""
    depth = grid.materialise(grid.depth_from_surface(fx.mask(spark, sf, 25)))
    return grid.coverage_prune(depth, fx.seeds(spark, sf))


@register("window_voxels", f"""WITH {IMG}, {SEEDS} SELECT s.seed_id AS "window", i.x - s.x + 5 AS x, i.y - s.y + 5 AS y, i.z - s.z + 3 AS z, v
  FROM s JOIN img i ON i.x BETWEEN s.x - 5 AND s.x + 5 AND i.y BETWEEN s.y - 5 AND s.y + 5 AND i.z BETWEEN s.z - 3 AND s.z + 3""")
def window_voxels(spark, sf):
    """The image in a window around each seed, in the window's own places."""
    s, half = fx.seeds(spark, sf), {"x": 5, "y": 5, "z": 3}
    bounds = [c for a, h in half.items() for c in ((F.col(a) - h).alias(f"min_{a}"), (F.col(a) + h).alias(f"max_{a}"))]
    held = grid.in_windows(fx.image(spark, sf), s.select(F.col("seed_id").alias("window"), *bounds), 16)
    return held.select("window", *((F.col(a) - F.col(f"min_{a}")).alias(a) for a in XYZ), "v")


@register("lattice_image", """WITH g AS (SELECT CAST(i % 24 AS INTEGER) AS x, CAST(i // 24 % 24 AS INTEGER) AS y, CAST(i // 576 AS INTEGER) AS z FROM range(13824) r(i))
  SELECT x, y, z,
    CASE WHEN CAST(x % 6 = 0 AS INTEGER) + CAST(y % 6 = 0 AS INTEGER) + CAST(z % 6 = 0 AS INTEGER) >= 2 THEN 1 ELSE 0 END AS lattice,
    CASE WHEN greatest(abs(x - 12), abs(y - 12), abs(z - 12)) % 3 = 2 AND NOT (y = 12 AND z = 12) THEN 0 ELSE 1 END AS barriers FROM g""")
def lattice_image(spark, sf):
    """Lines along the axes every six voxels, and nested closed walls with one gap in line."""
    side = 24
    x, y, z = coords.from_linear_id(F.col("id"), side, side)
    g = spark.range(side**3).select(x.alias("x"), y.alias("y"), z.alias("z"))
    return g.select(*XYZ, synthetic.lattice(6).alias("lattice"), synthetic.barriers(side, 3).alias("barriers"))


@register("random_walks")
def random_walks(spark, sf):
    """Images of one seeded random walk each, a twentieth of a cube of 16."""
    return synthetic.random_walks(fx.seeds(spark, sf).where("seed_id < 8").select("seed_id"), 16, 0.05)
