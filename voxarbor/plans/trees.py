"""Queries on rooted trees and graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxarbor.operators import graph, trees

from . import fixtures as fx
from .fixtures import TREE
from .registry import register

XYZ = ["x", "y", "z"]
_D = "sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y) + (t.z-p.z)*(t.z-p.z))"
_UP = """w(id, cur, hops, length) AS (SELECT id, id, 0, CAST(0 AS DOUBLE) FROM t UNION ALL
  SELECT w.id, t.parent, hops + 1, length + sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y) + (t.z-p.z)*(t.z-p.z)) FROM w JOIN t ON t.id = w.cur JOIN t p ON p.id = t.parent)"""
_KIDS = "c AS (SELECT t.id, t.parent, count(k.id) AS children FROM t LEFT JOIN t k ON k.parent = t.id GROUP BY 1, 2)"
_TOPO = """topo AS (SELECT id FROM c WHERE children <> 1 OR parent IS NULL),
  walk(id, cur, hops, length) AS (SELECT topo.id, t.parent, 1, sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y) + (t.z-p.z)*(t.z-p.z)) FROM topo JOIN t USING (id) JOIN t p ON p.id = t.parent
    UNION ALL SELECT walk.id, t.parent, hops + 1, length + sqrt((t.x-p.x)*(t.x-p.x) + (t.y-p.y)*(t.y-p.y) + (t.z-p.z)*(t.z-p.z)) FROM walk JOIN t ON t.id = walk.cur JOIN t p ON p.id = t.parent WHERE walk.cur NOT IN (SELECT id FROM topo)),
  edge AS (SELECT id, cur AS top, hops, length FROM walk WHERE cur IN (SELECT id FROM topo))"""
_NODES = """nn(neurite, id, pos) AS (SELECT id, id, 0 FROM topo WHERE id <> 1 UNION ALL SELECT neurite, t.parent, pos + 1 FROM nn JOIN t ON t.id = nn.id WHERE t.parent NOT IN (SELECT id FROM topo))"""


@register("node_degrees", f"WITH {TREE}, {_KIDS} SELECT id, children, children + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS degree FROM c")
def node_degrees(spark, sf):
    return trees.with_children(fx.tree(spark, sf)).select("id", "children", "degree")


@register("tree_counts", f"WITH {TREE}, {_KIDS} SELECT count(*) FILTER (children = 0) AS leaves, count(*) FILTER (children > 1 AND parent IS NOT NULL) AS furcations, count(*) FILTER (parent IS NULL) AS roots FROM c")
def tree_counts(spark, sf):
    return trees.with_children(fx.tree(spark, sf)).agg(F.count_if(F.col("children") == 0).alias("leaves"), F.count_if((F.col("children") > 1) & F.col("parent").isNotNull()).alias("furcations"), F.count_if(F.col("parent").isNull()).alias("roots"))


@register("branch_and_leaf_ids", f"WITH {TREE}, {_KIDS}, d AS (SELECT id, children + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS degree FROM c) SELECT id, CASE WHEN degree = 1 THEN 'leaf' ELSE 'branch' END AS kind FROM d WHERE degree = 1 OR (degree > 2 AND id <> 1)")
def branch_and_leaf_ids(spark, sf):
    d = trees.with_children(fx.tree(spark, sf))
    return d.where("degree = 1 OR (degree > 2 AND id <> 1)").select("id", F.when(F.col("degree") == 1, "leaf").otherwise("branch").alias("kind"))


@register("child_lists", f"WITH {TREE} SELECT parent AS id, array_to_string(list_sort(list(id)), ',') AS child_ids FROM t WHERE parent IS NOT NULL GROUP BY 1")
def child_lists(spark, sf):
    return trees.child_lists(fx.tree(spark, sf)).select("id", F.concat_ws(",", F.transform("child_ids", lambda i: i.cast("string"))).alias("child_ids"))


@register("max_bifurcation", f"WITH {TREE}, {_KIDS} SELECT coalesce(max(CAST(floor(t.radius) AS INTEGER)), 0) AS radius FROM c JOIN t USING (id) WHERE c.id <> 1 AND children = 2")
def max_bifurcation(spark, sf):
    d = trees.with_children(fx.tree(spark, sf)).where("degree = 3 AND id <> 1")
    return d.agg(F.coalesce(F.max(F.floor("radius").cast("int")), F.lit(0)).alias("radius"))


@register("duplicate_positions", f"WITH {TREE} SELECT CAST(floor(x / 20) AS BIGINT) AS x, CAST(floor(y / 20) AS BIGINT) AS y, CAST(floor(z / 20) AS BIGINT) AS z, count(*) AS n, min(id) AS first_id FROM t GROUP BY 1, 2, 3 HAVING count(*) > 1")
def duplicate_positions(spark, sf):
    return fx.tree(spark, sf).groupBy(*(F.floor(F.col(a) / 20).alias(a) for a in XYZ)).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")).where("n > 1")


@register("parent_offsets", f"WITH {TREE} SELECT t.id, t.parent, p.x - t.x AS dx, p.y - t.y AS dy, p.z - t.z AS dz, coalesce(t.parent < t.id, FALSE) AS listed_above FROM t LEFT JOIN t p ON p.id = t.parent")
def parent_offsets(spark, sf):
    t = trees.with_parent(fx.tree(spark, sf))
    return t.select("id", "parent", *((F.col(f"p_{a}") - F.col(a)).alias(f"d{a}") for a in XYZ), F.coalesce(F.col("parent") < F.col("id"), F.lit(False)).alias("listed_above"))


@register("outside_parents", f"WITH {TREE}, k AS (SELECT * FROM t WHERE id % 7 <> 0) SELECT id, parent FROM k WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM k)")
def outside_parents(spark, sf):
    k = fx.tree(spark, sf).where("id % 7 <> 0")
    return k.where("parent IS NOT NULL").join(k.select(F.col("id").alias("p")), F.col("parent") == F.col("p"), "left_anti").select("id", "parent")


@register("tree_paths", f"WITH RECURSIVE {TREE}, {_UP} SELECT id, cur AS root, CAST(hops AS BIGINT) AS depth, round(length, 6) AS length FROM w WHERE cur = 1")
def tree_paths(spark, sf):
    return trees.roots(fx.tree(spark, sf)).select("id", "root", "depth", F.round("length", 6).alias("length"))


@register("branch_order", f"WITH RECURSIVE {TREE}, {_KIDS}, b AS (SELECT id, CASE WHEN children > 1 AND parent IS NOT NULL THEN 1 ELSE 0 END AS o FROM c), r(id, o) AS (SELECT 1, 0 UNION ALL SELECT t.id, r.o + b.o FROM r JOIN t ON t.parent = r.id JOIN b ON b.id = r.id) SELECT CAST(id AS BIGINT) AS id, CAST(o AS BIGINT) AS branch_order FROM r")
def branch_order(spark, sf):
    return trees.branch_orders(fx.tree(spark, sf))


@register("prune_branch_order", f"WITH RECURSIVE {TREE}, {_KIDS}, b AS (SELECT id, CASE WHEN children > 1 AND parent IS NOT NULL THEN 1 ELSE 0 END AS o FROM c), r(id, o) AS (SELECT 1, 0 UNION ALL SELECT t.id, r.o + b.o FROM r JOIN t ON t.parent = r.id JOIN b ON b.id = r.id) SELECT t.id, t.parent FROM r JOIN t USING (id) WHERE o <= 3")
def prune_branch_order(spark, sf):
    t = fx.tree(spark, sf)
    return t.join(trees.branch_orders(t).where("branch_order <= 3"), "id").select("id", "parent")


@register("topology_edges", f"WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO} SELECT id, top, CAST(hops AS BIGINT) AS hops, round(length, 6) AS length FROM edge")
def topology_edges(spark, sf):
    return trees.topology(fx.tree(spark, sf)).select("id", "top", "hops", F.round("length", 6).alias("length"))


@register("neurite_nodes", f"WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO}, {_NODES} SELECT neurite, id, CAST(pos AS BIGINT) AS pos FROM nn")
def neurite_nodes(spark, sf):
    return trees.neurites(fx.tree(spark, sf))


_GOF = f"""gof AS (SELECT neurite, avg(acos(greatest(least(((t.x-p.x)*(t.x-50)+(t.y-p.y)*(t.y-50)+(t.z-p.z)*(t.z-50)) / nullif({_D} * sqrt((t.x-50)*(t.x-50)+(t.y-50)*(t.y-50)+(t.z-50)*(t.z-50)), 0), 1.0), -1.0))) AS angle,
  sum({_D}) AS length, avg(t.radius) AS radius, count(*) AS nodes FROM nn JOIN t ON t.id = nn.id JOIN t p ON p.id = t.parent GROUP BY 1)"""


@register("goodness_of_fit", f"WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO}, {_NODES}, {_GOF} SELECT neurite, round(angle, 6) AS angle, round(length, 6) AS length, round(radius, 6) AS radius, nodes FROM gof")
def goodness_of_fit(spark, sf):
    g = trees.goodness_of_fit(fx.tree(spark, sf), (50.0, 50.0, 50.0))
    return g.select("neurite", *(F.round(c, 6).alias(c) for c in ("angle", "length", "radius")), "nodes")


@register("fit_probability", f"""WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO}, {_NODES}, {_GOF}, s AS (SELECT neurite, angle / pi() AS u, length FROM gof)
  SELECT neurite, round(1 - (0.5 * u + 0.25 * u * u + 0.25 * u * u * u), 6) AS p, round((1 - (1 - (0.5 * u + 0.25 * u * u + 0.25 * u * u * u)) * ln(2)) * ln(1 + length), 6) AS cost FROM s""")
def fit_probability(spark, sf):
    """Tail probability of a polynomial distribution of the scaled angle, and the cost."""
    g = trees.goodness_of_fit(fx.tree(spark, sf), (50.0, 50.0, 50.0)).withColumn("u", F.col("angle") / math.pi)
    u = F.col("u")
    p = F.lit(1.0) - (0.5 * u + 0.25 * u * u + 0.25 * u * u * u)
    return g.select("neurite", F.round(p, 6).alias("p"), F.round((F.lit(1.0) - p * math.log(2)) * F.log(F.lit(1.0) + F.col("length")), 6).alias("cost"))


@register("leaf_branches", f"WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO} SELECT edge.id AS leaf, top, CAST(hops AS BIGINT) AS hops, round(length, 6) AS length FROM edge JOIN c USING (id) WHERE children = 0")
def leaf_branches(spark, sf):
    return trees.leaf_branches(fx.tree(spark, sf)).select("leaf", "top", "hops", F.round("length", 6).alias("length"))


@register("prune_short_branches", f"WITH RECURSIVE {TREE}, {_KIDS}, {_TOPO}, {_NODES}, short AS (SELECT edge.id FROM edge JOIN c USING (id) JOIN c f ON f.id = edge.top WHERE c.children = 0 AND f.children > 1 AND length < 150) SELECT t.id, t.parent FROM t WHERE id NOT IN (SELECT nn.id FROM nn WHERE neurite IN (SELECT id FROM short))")
def prune_short_branches(spark, sf):
    return trees.prune_short(fx.tree(spark, sf), 150.0).select("id", "parent")


@register("resample_edges", f"""WITH {TREE}, e AS (SELECT t.*, p.x AS px, p.y AS py, p.z AS pz, p.radius AS pr, CASE WHEN {_D} > 20 THEN CAST(pow(2, ceil(round(log2({_D} / 20), 9))) AS INTEGER) ELSE 1 END AS n FROM t LEFT JOIN t p ON p.id = t.parent)
  SELECT id, CAST(i AS INTEGER) AS i, n, round(CASE WHEN i = 0 THEN x ELSE x + (px - x) * i / n END, 6) AS x, round(CASE WHEN i = 0 THEN y ELSE y + (py - y) * i / n END, 6) AS y,
  round(CASE WHEN i = 0 THEN z ELSE z + (pz - z) * i / n END, 6) AS z, round(CASE WHEN i = 0 THEN radius ELSE radius + (pr - radius) * i / n END, 6) AS radius FROM e, range(64) r(i) WHERE i < n""")
def resample_edges(spark, sf):
    return trees.resample(fx.tree(spark, sf), 20.0).select("id", "i", "n", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")))


_NB = "nb AS (SELECT id AS u, parent AS v FROM t WHERE parent IS NOT NULL UNION ALL SELECT parent, id FROM t WHERE parent IS NOT NULL)"


@register("smooth_tree", f"""WITH {TREE}, {_NB}, m AS (SELECT u, count(*) AS k, avg(x) AS x, avg(y) AS y, avg(z) AS z, avg(radius) AS radius FROM nb JOIN t ON t.id = v GROUP BY u)
  SELECT id, round(CASE WHEN k = 2 THEN m.x ELSE t.x END, 6) AS x, round(CASE WHEN k = 2 THEN m.y ELSE t.y END, 6) AS y, round(CASE WHEN k = 2 THEN m.z ELSE t.z END, 6) AS z, round(CASE WHEN k = 2 THEN m.radius ELSE t.radius END, 6) AS radius FROM t LEFT JOIN m ON m.u = t.id""")
def smooth_tree(spark, sf):
    return trees.smooth(fx.tree(spark, sf)).select("id", *(F.round(c, 6).alias(c) for c in (*XYZ, "radius")))


@register("repair_radii", f"WITH {TREE}, {_NB}, m AS (SELECT u, avg(radius) AS r FROM nb JOIN t ON t.id = v GROUP BY u) SELECT id, round(CASE WHEN radius < 1.2 THEN coalesce(r, radius) ELSE radius END, 6) AS radius FROM t LEFT JOIN m ON m.u = t.id")
def repair_radii(spark, sf):
    return trees.repair_radii(fx.tree(spark, sf), 1.2).select("id", F.round("radius", 6).alias("radius"))


@register("enclosed_nodes", f"WITH {TREE}, {_NB}, b AS (SELECT id, x, y, z, radius * 30 AS radius FROM t) SELECT u AS src, v AS dst FROM nb JOIN b t ON t.id = u JOIN b p ON p.id = v WHERE t.radius >= p.radius + {_D}")
def enclosed_nodes(spark, sf):
    return trees.enclosed(fx.tree(spark, sf).withColumn("radius", F.col("radius") * 30))


@register("spurious_leaves", f"WITH {TREE}, {_KIDS}, d AS (SELECT id, parent, children + CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS degree FROM c) SELECT d.id FROM d JOIN d p ON p.id = d.parent WHERE d.degree = 1 AND p.degree > 2")
def spurious_leaves(spark, sf):
    return trees.with_parent(trees.with_children(fx.tree(spark, sf)), "degree").where("degree = 1 AND p_degree > 2").select("id")


@register("adjust_parents", f"WITH RECURSIVE {TREE}, up(id, cur) AS (SELECT id, parent FROM t WHERE id % 3 <> 0 UNION ALL SELECT up.id, t.parent FROM up JOIN t ON t.id = up.cur WHERE up.cur % 3 = 0) SELECT id, cur AS parent FROM up WHERE cur IS NULL OR cur % 3 <> 0")
def adjust_parents(spark, sf):
    return trees.reattach(fx.tree(spark, sf), F.col("id") % 3 != 0)


@register("remove_node", f"WITH {TREE}, n AS (SELECT parent FROM t WHERE id = 40) SELECT id, CASE WHEN parent = 40 THEN (SELECT parent FROM n) ELSE parent END AS parent FROM t WHERE id <> 40")
def remove_node(spark, sf):
    return trees.reattach(fx.tree(spark, sf), F.col("id") != 40)


@register("split_at_node", f"WITH RECURSIVE {TREE}, r(id, part) AS (SELECT id, id FROM t WHERE parent = 1 UNION ALL SELECT t.id, r.part FROM r JOIN t ON t.parent = r.id) SELECT id, part FROM r")
def split_at_node(spark, sf):
    return trees.subtrees_without(fx.tree(spark, sf), 1)


@register("graph_components", f"WITH RECURSIVE {TREE}, e AS (SELECT id, parent FROM t WHERE id % 11 <> 0), r(id, part) AS (SELECT t.id, t.id FROM t WHERE parent IS NULL OR id % 11 = 0 UNION ALL SELECT e.id, r.part FROM r JOIN e ON e.parent = r.id) SELECT id, part AS comp FROM r")
def graph_components(spark, sf):
    t = fx.tree(spark, sf)
    return graph.components(t.select("id"), t.where("parent IS NOT NULL AND id % 11 <> 0").select(F.col("id").alias("src"), F.col("parent").alias("dst")))


@register("standard_ids", f"""WITH RECURSIVE {TREE}, r(id, tree) AS (SELECT id, id FROM t WHERE parent IS NULL OR id % 50 = 0 UNION ALL SELECT t.id, r.tree FROM r JOIN t ON t.parent = r.id AND t.id % 50 <> 0),
  n AS (SELECT r.id, r.tree, CASE WHEN r.id = r.tree THEN NULL ELSE t.parent END AS parent, row_number() OVER (PARTITION BY tree ORDER BY r.id <> r.tree, r.id) AS new FROM r JOIN t USING (id))
  SELECT n.tree, n.id AS old, CAST(n.new AS INTEGER) AS id, CAST(p.new AS INTEGER) AS parent FROM n LEFT JOIN n p ON p.id = n.parent""")
def standard_ids(spark, sf):
    cut = fx.tree(spark, sf).withColumn("parent", F.when(F.col("id") % 50 != 0, F.col("parent")))
    named = cut.join(trees.roots(cut).select("id", F.col("root").alias("tree")), "id")
    return trees.standard_ids(named.select("tree", "id", "parent"))


@register("depth_first_order", f"WITH RECURSIVE {TREE}, r(id, path) AS (SELECT id, [id] FROM t WHERE parent IS NULL UNION ALL SELECT t.id, list_append(path, t.id) FROM r JOIN t ON t.parent = r.id) SELECT id, row_number() OVER (ORDER BY path) - 1 AS position FROM r")
def depth_first_order(spark, sf):
    return trees.depth_first(fx.tree(spark, sf))


@register("multi_source_levels", f"WITH RECURSIVE {TREE}, {_NB}, r(id, level) AS (SELECT id, 0 FROM t WHERE id % 97 = 0 UNION SELECT v, level + 1 FROM r JOIN nb ON nb.u = r.id WHERE level < 64) SELECT id, min(level) AS level FROM r GROUP BY id")
def multi_source_levels(spark, sf):
    t = fx.tree(spark, sf)
    return graph.levels(t.where("id % 97 = 0").select("id"), trees.undirected(t))


@register("tree_affine", f"""WITH {TREE} SELECT id + 1000 AS id, parent + 1000 AS parent, CASE WHEN parent IS NULL THEN 1 ELSE 3 END AS type, round((x + 5) * 2, 6) AS x, round((y - 3) * 0.5, 6) AS y, round(z * 1.5, 6) AS z, round(radius * 0.4, 5) AS radius,
  round(x * cos(0.5) - y * sin(0.5), 6) AS rx, round(x * sin(0.5) + y * cos(0.5), 6) AS ry FROM t""")
def tree_affine(spark, sf):
    x, y = F.col("x"), F.col("y")
    return fx.tree(spark, sf).select((F.col("id") + 1000).alias("id"), (F.col("parent") + 1000).alias("parent"), F.when(F.col("parent").isNull(), 1).otherwise(3).alias("type"),
        F.round((x + 5) * 2, 6).alias("x"), F.round((y - 3) * 0.5, 6).alias("y"), F.round(F.col("z") * 1.5, 6).alias("z"), F.round(F.col("radius") * 0.4, 5).alias("radius"),
        F.round(x * math.cos(0.5) - y * math.sin(0.5), 6).alias("rx"), F.round(x * math.sin(0.5) + y * math.cos(0.5), 6).alias("ry"))


@register("scale_neurite_radii", f"WITH {TREE} SELECT id, CASE WHEN type = 1 THEN radius ELSE round(radius * 0.4, 6) END AS radius FROM t")
def scale_neurite_radii(spark, sf):
    return fx.tree(spark, sf).select("id", F.when(F.col("type") == 1, F.col("radius")).otherwise(F.round(F.col("radius") * 0.4, 6)).alias("radius"))


@register("window_to_global", f"WITH {TREE}, g AS (SELECT id, (x + 100) * 0.4 AS x, (y + 200) * 0.4 AS y, (z + 50) * 1.0 AS z, CASE WHEN id = 1 THEN greatest(radius, 5.0) ELSE radius END AS radius FROM t) SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, radius, count(*) OVER (PARTITION BY round(x, 6), round(y, 6), round(z, 6)) - 1 AS same FROM g")
def window_to_global(spark, sf):
    from pyspark.sql import Window

    g = fx.tree(spark, sf).select("id", F.round((F.col("x") + 100) * 0.4, 6).alias("x"), F.round((F.col("y") + 200) * 0.4, 6).alias("y"), F.round((F.col("z") + 50) * 1.0, 6).alias("z"),
                                  F.when(F.col("id") == 1, F.greatest("radius", F.lit(5.0))).otherwise(F.col("radius")).alias("radius"))
    return g.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy(*XYZ)) - 1)


@register("same_neighbour_lists", f"WITH {TREE}, {_NB}, l AS (SELECT u AS id, array_to_string(list_sort(list(v)), ',') AS nbrs FROM nb GROUP BY u) SELECT x, y, z, nbrs, count(*) AS n, min(id) AS first_id FROM t JOIN l USING (id) GROUP BY 1, 2, 3, 4")
def same_neighbour_lists(spark, sf):
    t = fx.tree(spark, sf)
    nb = trees.undirected(t).groupBy(F.col("src").alias("id")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("dst")), lambda i: i.cast("string"))).alias("nbrs"))
    return t.join(nb, "id").groupBy(*XYZ, "nbrs").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@register("prune_flags", f"WITH {TREE} SELECT t.id, coalesce((p.x - t.x) + (p.y - t.y) + (p.z - t.z) < 60, FALSE) OR t.radius < 2 AS tombstone FROM t LEFT JOIN t p ON p.id = t.parent")
def prune_flags(spark, sf):
    t = trees.with_parent(fx.tree(spark, sf))
    off = sum(F.col(f"p_{a}") - F.col(a) for a in XYZ)
    return t.select("id", (F.coalesce(off < 60, F.lit(False)) | (F.col("radius") < 2)).alias("tombstone"))
