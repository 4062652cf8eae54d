"""Queries on marching, skeletons, segments and assignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxarbor.operators import grid, tracing, trees

from . import fixtures as fx
from .fixtures import BOX, IMG, SEEDS, TREE, mask_sql
from .registry import register

XYZ = ["x", "y", "z"]
_NB = "nb AS (SELECT id AS u, parent AS v FROM t WHERE parent IS NOT NULL UNION ALL SELECT parent, id FROM t WHERE parent IS NOT NULL)"
_LEN = """pl(id, length) AS (SELECT id, CAST(0 AS DOUBLE) FROM t WHERE parent IS NULL UNION ALL
  SELECT t.id, pl.length + sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y) + (t.z-p.z)*(t.z-p.z)) FROM pl JOIN t ON t.parent = pl.id JOIN t p ON p.id = t.parent)"""
_SEG = f"""{_LEN}, up(id, top) AS (SELECT id, id FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL) UNION ALL SELECT up.id, t.parent FROM up JOIN t ON t.id = up.top WHERE t.parent IS NOT NULL),
  seg AS (SELECT top AS id, id AS owner FROM (SELECT up.*, row_number() OVER (PARTITION BY top ORDER BY round(length, 9) DESC, up.id) AS r FROM up JOIN pl USING (id)) WHERE r = 1)"""
_TAB = """tab AS (SELECT s.owner, count(*) AS nodes, max(pl.length) AS birth, coalesce(max(CASE WHEN ps.owner <> s.owner THEN pp.length END), 0) AS death, max(CASE WHEN ps.owner <> s.owner THEN ps.owner END) AS parent_segment
  FROM seg s JOIN t USING (id) JOIN pl USING (id) LEFT JOIN seg ps ON ps.id = t.parent LEFT JOIN pl pp ON pp.id = t.parent GROUP BY 1)"""


@register("march_costs")
def march_costs(spark, sf):
    v = fx.image(spark, sf).where("v > 30")
    best = tracing.march(v, fx.seeds(spark, sf), F.lit(51.0) - F.col("v"))
    return best.select("id", F.round("cost", 6).alias("cost"), "parent")


@register("march_costs_26")
def march_costs_26(spark, sf):
    v = fx.image(spark, sf).where("v > 42")
    best = tracing.march(v, fx.seeds(spark, sf), F.lit(51.0) - F.col("v"), 26)
    return best.select("id", F.round("cost", 6).alias("cost"), "parent")


@register("shell_radius", f"""WITH {IMG}, {mask_sql(10)}, {SEEDS}, {BOX}, b AS (SELECT seed_id, s.x + dx AS x, s.y + dy AS y, s.z + dz AS z, CAST(ceil(sqrt(dx*dx + dy*dy + dz*dz)) AS INTEGER) AS shell FROM s, box WHERE dx*dx + dy*dy + dz*dz <= 9),
  h AS (SELECT seed_id, shell, count(*) AS n, count(*) - count(m.x) AS bg FROM b LEFT JOIN m USING (x, y, z) GROUP BY 1, 2), c AS (SELECT seed_id, shell, sum(bg) OVER (PARTITION BY seed_id ORDER BY shell) / sum(n) OVER (PARTITION BY seed_id ORDER BY shell) AS share FROM h)
  SELECT seed_id AS node, coalesce(greatest(min(CASE WHEN share > 0.6 AND shell > 0 THEN shell END) - 1, CASE WHEN min(CASE WHEN share > 0.6 AND shell > 0 THEN shell END) IS NOT NULL THEN 1 END), 3) AS radius FROM c GROUP BY 1""")
def shell_radius(spark, sf):
    return tracing.shell_radius(fx.mask(spark, sf, 10), fx.seeds(spark, sf).withColumnRenamed("seed_id", "node"), 3, 0.6)


@register("shell_radius_xy", f"""WITH {IMG}, {mask_sql(10)}, {SEEDS}, {BOX}, b AS (SELECT seed_id, s.x + dx AS x, s.y + dy AS y, s.z + dz AS z, CAST(ceil(sqrt(dx*dx + dy*dy + dz*dz)) AS INTEGER) AS shell FROM s, box WHERE dx*dx + dy*dy <= 9 AND dz = 0),
  h AS (SELECT seed_id, shell, count(*) AS n, count(*) - count(m.x) AS bg FROM b LEFT JOIN m USING (x, y, z) GROUP BY 1, 2), c AS (SELECT seed_id, shell, sum(bg) OVER (PARTITION BY seed_id ORDER BY shell) / sum(n) OVER (PARTITION BY seed_id ORDER BY shell) AS share FROM h)
  SELECT seed_id AS node, coalesce(greatest(min(CASE WHEN share > 0.6 AND shell > 0 THEN shell END) - 1, CASE WHEN min(CASE WHEN share > 0.6 AND shell > 0 THEN shell END) IS NOT NULL THEN 1 END), 3) AS radius FROM c GROUP BY 1""")
def shell_radius_xy(spark, sf):
    return tracing.shell_radius(fx.mask(spark, sf, 10), fx.seeds(spark, sf).withColumnRenamed("seed_id", "node"), 3, 0.6, plane=True)


@register("soma_units", f"""WITH RECURSIVE {TREE}, g AS (SELECT id FROM t WHERE id % 211 = 1), u(id, unit) AS (SELECT t.id, t.id FROM t WHERE id NOT IN (SELECT id FROM g) AND (parent IS NULL OR parent IN (SELECT id FROM g))
  UNION ALL SELECT t.id, u.unit FROM u JOIN t ON t.parent = u.id WHERE t.id NOT IN (SELECT id FROM g)),
  h AS (SELECT DISTINCT u.unit, g.id AS soma FROM u JOIN t ON t.id = u.id JOIN g ON g.id = t.parent UNION SELECT DISTINCT u.unit, g.id FROM g JOIN t ON t.id = g.id JOIN u ON u.id = t.parent)
  SELECT n.unit, n.nodes, coalesce((SELECT string_agg(CAST(soma AS VARCHAR), ',' ORDER BY soma) FROM h WHERE h.unit = n.unit), '') AS somas FROM (SELECT unit, count(*) AS nodes FROM u GROUP BY 1) n""")
def soma_units(spark, sf):
    t = fx.tree(spark, sf)
    u = tracing.soma_units(t, t.where("id % 211 = 1").select("id"))
    return u.withColumn("somas", F.concat_ws(",", F.transform("somas", lambda i: i.cast("string"))))


@register("trace_parents", f"WITH RECURSIVE {TREE}, {_NB}, r(id, level) AS (SELECT id, 0 FROM t WHERE id % 397 = 1 UNION SELECT v, level + 1 FROM r JOIN nb ON nb.u = r.id WHERE level < 60 AND v NOT IN (SELECT id FROM t WHERE id % 397 = 1)), l AS (SELECT id, min(level) AS level FROM r GROUP BY id) SELECT l.id, l.level, min(k.id) AS parent FROM l LEFT JOIN nb ON nb.u = l.id LEFT JOIN l k ON k.id = nb.v AND k.level = l.level - 1 GROUP BY 1, 2")
def trace_parents(spark, sf):
    t = fx.tree(spark, sf)
    return tracing.trace_parents(t, trees.undirected(t), t.where("id % 397 = 1").select("id"))


@register("skeleton_nodes")
def skeleton_nodes(spark, sf):
    nodes, _ = tracing.skeleton(fx.mask(spark, sf, 40), fx.seeds(spark, sf))
    return nodes.select("node", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")), "level")


@register("skeleton_edges")
def skeleton_edges(spark, sf):
    return tracing.skeleton(fx.mask(spark, sf, 40), fx.seeds(spark, sf))[1]


@register("segments", f"WITH RECURSIVE {TREE}, {_SEG} SELECT id, owner FROM seg")
def segments(spark, sf):
    return tracing.segments(fx.tree(spark, sf))


@register("persistence", f"WITH RECURSIVE {TREE}, {_SEG}, {_TAB} SELECT owner, nodes, round(birth, 6) AS birth, round(death, 6) AS death, parent_segment FROM tab")
def persistence(spark, sf):
    t = tracing.segment_table(fx.tree(spark, sf))
    return t.select("owner", "nodes", F.round("birth", 6).alias("birth"), F.round("death", 6).alias("death"), "parent_segment")


@register("persistence_filter", f"WITH RECURSIVE {TREE}, {_SEG}, {_TAB} SELECT owner, CASE WHEN birth - death < 200 OR nodes > 30 THEN 1 ELSE 2 END AS class FROM tab")
def persistence_filter(spark, sf):
    t = tracing.segment_table(fx.tree(spark, sf))
    return t.select("owner", F.when((F.col("birth") - F.col("death") < 200) | (F.col("nodes") > 30), 1).otherwise(2).alias("class"))


@register("prune_segments", f"WITH RECURSIVE {TREE}, {_SEG}, {_TAB} SELECT id, t.parent FROM t JOIN seg USING (id) JOIN tab USING (owner) WHERE birth - death >= 150")
def prune_segments(spark, sf):
    return tracing.prune_segments(fx.tree(spark, sf), 150.0).select("id", "parent")




def _smooth_sql() -> str:
    cols, outs = [], []
    for c in ("x", "y", "z", "radius"):
        cols += [f"lag({c}, {k}) OVER w AS {c}_{k + 2}" for k in range(-2, 3)]
        weights = [1, 2, 3, 2, 1]
        top = " + ".join(f"coalesce({c}_{i} * {f}, 0)" for i, f in enumerate(weights))
        bottom = " + ".join(f"CASE WHEN {c}_{i} IS NULL THEN 0 ELSE {f} END" for i, f in enumerate(weights))
        outs.append(f"round(({top}) / ({bottom}), 6) AS {c}")
    return f"""WITH RECURSIVE {TREE}, {_SEG}, dp(id, depth) AS (SELECT id, 0 FROM t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1 FROM dp JOIN t ON t.parent = dp.id),
      q AS (SELECT id, {', '.join(cols)} FROM t JOIN seg USING (id) JOIN dp USING (id) WINDOW w AS (PARTITION BY owner ORDER BY depth)) SELECT id, {', '.join(outs)} FROM q"""


@register("smooth_curves", _smooth_sql())
def smooth_curves(spark, sf):
    return tracing.smooth_curve(fx.tree(spark, sf), 5).select("id", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")))


@register("split_multifurcations")
def split_multifurcations(spark, sf):
    t = fx.tree(spark, sf)
    bushy = t.withColumn("parent", F.when(F.col("id") > 6, F.floor((F.col("id") + 3) / 5)).otherwise(F.col("parent")))
    return tracing.split_multifurcations(bushy)


@register("merge_in_balls", f"""WITH {TREE}, {SEEDS}, k AS (SELECT t.id, min(s.seed_id) AS seed FROM t JOIN s ON (t.x-s.x)*(t.x-s.x) + (t.y-s.y)*(t.y-s.y) + (t.z-s.z)*(t.z-s.z) <= 225 GROUP BY 1),
  i AS (SELECT t.id, coalesce(-seed - 1, t.id) AS into_ FROM t LEFT JOIN k USING (id)) SELECT DISTINCT least(a.into_, b.into_) AS src, greatest(a.into_, b.into_) AS dst FROM t JOIN i a ON a.id = t.id JOIN i b ON b.id = t.parent WHERE a.into_ <> b.into_""")
def merge_in_balls(spark, sf):
    return tracing.merge_in_balls(fx.tree(spark, sf), fx.seeds(spark, sf), 15.0)[1]


@register("mean_shift")
def mean_shift(spark, sf):
    return tracing.mean_shift(fx.tree(spark, sf), 15.0)


@register("cover_prune")
def cover_prune(spark, sf):
    t = fx.tree(spark, sf).withColumn("tree", F.col("id") % 50)
    return tracing.cover_prune(t, "tree", 12.0)


@register("mean_shift_radii")
def mean_shift_radii(spark, sf):
    """Positions and radii averaged in balls of six radii; the root stays."""
    out = tracing.mean_shift(fx.tree(spark, sf), 21.0, factor=6.0, fixed=F.col("type") == 1)
    return out.withColumn("radius", F.round("radius", 6))


@register("cover_groups")
def cover_groups(spark, sf):
    """Groups of nodes under one ball, the root's first, at their mean place."""
    t = fx.tree(spark, sf).withColumn("tree", F.col("id") % 50)
    soma = F.col("type") == 1
    groups = tracing.cover_groups(t, tracing.cover_prune(t, "tree", 12.0, soma), soma)
    return groups.select("id", "members", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")))


@register("assign_somas")
def assign_somas(spark, sf):
    t = fx.tree(spark, sf)
    out = tracing.assign_somas(t, t.where("id % 211 = 1").select("id"), F.log(F.lit(1.0) + trees.edge_length()))
    return out.select("id", "soma", F.round("cost", 6).alias("cost"))


@register("erode_to_centre")
def erode_to_centre(spark, sf):
    """What is left of the mask before an erosion empties it."""
    now = fx.mask(spark, sf, 3)
    while not (nxt := grid.materialise(grid.erode(now))).isEmpty():
        now = nxt
    return now


@register("axis_flips", f"WITH {IMG} SELECT 63 - x AS x, y, z, v, CAST(least(v * 2 + 3, 255) AS INTEGER) AS linear, y AS rx, 63 - x AS ry FROM img")
def axis_flips(spark, sf):
    x, y, v = F.col("x"), F.col("y"), F.col("v")
    return fx.image(spark, sf).select((63 - x).alias("x"), "y", "z", "v", F.least(v * 2 + 3, F.lit(255)).cast("int").alias("linear"), y.alias("rx"), (63 - x).alias("ry"))


def _drawn_sql(stream: int) -> str:
    return f"(CAST('0x' || substr(md5({stream} || '-' || x || '-' || y || '-' || z), 1, 8) AS BIGINT) + 1) / 4294967297.0::DOUBLE"


@register("noisy_image", f"""WITH {IMG} SELECT x, y, z,
  round(greatest(v + 2.0::DOUBLE * sqrt(-2 * ln({_drawn_sql(1)})) * cos(2 * pi() * {_drawn_sql(2)}), 0.0), 4) AS v FROM img""")
def noisy_image(spark, sf):
    """Gaussian noise seeded by position, so that reruns and repartitioning agree."""

    def drawn(stream: int):
        place = F.concat_ws("-", F.lit(str(stream)), *(F.col(a).cast("string") for a in XYZ))
        return (F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)

    normal = F.sqrt(-2 * F.log(drawn(1))) * F.cos(2 * F.pi() * drawn(2))
    return fx.image(spark, sf).select(*XYZ, F.round(F.greatest(F.col("v") + 2.0 * normal, F.lit(0.0)), 4).alias("v"))


@register("segment_forest")
def segment_forest(spark, sf):
    """Random forest of junk and true segments on length and size; evaluated on held-out rows."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    t = tracing.segment_table(fx.tree(spark, sf))
    rows = t.select("owner", (F.col("birth") - F.col("death")).alias("length"), F.col("nodes").cast("double").alias("nodes"), ((F.col("birth") - F.col("death") >= 150).cast("double")).alias("label"))
    rows = VectorAssembler(inputCols=["length", "nodes"], outputCol="features").transform(rows)
    held = F.pmod(F.xxhash64("owner", F.lit(42)), F.lit(5)) == 0
    model = RandomForestClassifier(seed=42, numTrees=20).fit(rows.where(~held))
    return model.transform(rows.where(held)).select("owner", "label", "prediction")
