"""Queries on points, seeds, markers, names, run logs and scores."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxarbor.functions import coords
from voxarbor.operators import grid, matching, tables, trees
from voxarbor.sources import swc

from . import fixtures as fx
from .fixtures import AUTO, BOX, IMG, PROOF, SEEDS, TREE, mask_sql
from .registry import register

XYZ = ["x", "y", "z"]
_D2 = "CAST((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS DOUBLE)"


@register("ball_search", f"WITH {PROOF}, {AUTO} SELECT a, b, {_D2} AS d2 FROM a JOIN b ON {_D2} <= 900")
def ball_search(spark, sf):
    return matching.within(fx.proof(spark, sf), fx.auto(spark, sf), 30.0)


@register("nearest_point", f"WITH {PROOF}, {AUTO}, j AS (SELECT a, b, {_D2} AS d2 FROM a JOIN b ON {_D2} <= 1600) SELECT a, b, d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM j) WHERE r = 1")
def nearest_point(spark, sf):
    return matching.nearest(fx.proof(spark, sf), fx.auto(spark, sf), 40.0)


@register("mutual_nearest", f"""WITH {PROOF}, {AUTO}, j AS (SELECT a, b, {_D2} AS d2 FROM a JOIN b ON {_D2} <= 1600), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM j) SELECT a, b, d2 FROM r WHERE ra = 1 AND rb = 1""")
def mutual_nearest(spark, sf):
    return matching.mutual_nearest(fx.proof(spark, sf), fx.auto(spark, sf), 40.0)


@register("scaled_ball_search", f"WITH {PROOF}, {AUTO} SELECT a, b, CAST((a.x-b.x)*(a.x-b.x)*0.25 + (a.y-b.y)*(a.y-b.y)*0.25 + (a.z-b.z)*(a.z-b.z) AS DOUBLE) AS d2 FROM a JOIN b ON (a.x-b.x)*(a.x-b.x)*0.25 + (a.y-b.y)*(a.y-b.y)*0.25 + (a.z-b.z)*(a.z-b.z) <= 225")
def scaled_ball_search(spark, sf):
    return matching.within(fx.proof(spark, sf), fx.auto(spark, sf), 15.0, (0.5, 0.5, 1.0))


@register("soma_precision_recall", f"""WITH {PROOF}, {AUTO}, j AS (SELECT a, b FROM a JOIN b ON {_D2} <= 400)
  SELECT (SELECT count(DISTINCT b) FROM j) AS tp, (SELECT count(*) FROM b) - (SELECT count(DISTINCT b) FROM j) AS fp, (SELECT count(*) FROM a) - (SELECT count(DISTINCT a) FROM j) AS fn,
  round((SELECT count(DISTINCT b) FROM j) / (SELECT count(*) FROM b), 6) AS precision_, round((SELECT count(DISTINCT a) FROM j) / (SELECT count(*) FROM a), 6) AS recall""")
def soma_precision_recall(spark, sf):
    a, b = fx.proof(spark, sf), fx.auto(spark, sf)
    j = matching.within(a, b, 20.0)
    c = j.agg(F.countDistinct("b").alias("tp"), F.countDistinct("a").alias("hit")).crossJoin(a.agg(F.count(F.lit(1)).alias("na"))).crossJoin(b.agg(F.count(F.lit(1)).alias("nb")))
    return c.select("tp", (F.col("nb") - F.col("tp")).alias("fp"), (F.col("na") - F.col("hit")).alias("fn"), F.round(F.col("tp") / F.col("nb"), 6).alias("precision_"), F.round(F.col("hit") / F.col("na"), 6).alias("recall"))


_KIDS = "c AS (SELECT t.id, count(k.id) + CASE WHEN t.parent IS NULL THEN 0 ELSE 1 END AS degree FROM t LEFT JOIN t k ON k.parent = t.id GROUP BY t.id, t.parent)"


@register("highest_valence_in_ball", f"""WITH {TREE}, {_KIDS}, {PROOF}, j AS (SELECT a.a, t.id AS b, degree, (a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y) + (a.z-t.z)*(a.z-t.z) AS d2 FROM a, t JOIN c USING (id) WHERE (a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y) + (a.z-t.z)*(a.z-t.z) <= 400 AND degree > 0)
  SELECT a, b, degree FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY degree DESC, b) AS r FROM j) WHERE r = 1""")
def highest_valence_in_ball(spark, sf):
    t = trees.with_children(fx.tree(spark, sf))
    pairs = matching.within(fx.proof(spark, sf), t.select(F.col("id").alias("b"), *XYZ), 20.0)
    pairs = pairs.join(t.select(F.col("id").alias("b"), "degree"), "b").where("degree > 0")
    return matching.best(pairs, F.desc("degree"), "b").select("a", "b", "degree")


@register("completeness", f"WITH {TREE}, o AS (SELECT id, x, y, z FROM t WHERE id % 3 = 0) SELECT count(*) AS nodes, count(*) FILTER (EXISTS (SELECT 1 FROM o WHERE (t.x-o.x)*(t.x-o.x) + (t.y-o.y)*(t.y-o.y) + (t.z-o.z)*(t.z-o.z) <= 64)) AS matched FROM t")
def completeness(spark, sf):
    t = fx.tree(spark, sf)
    hit = matching.reached(t.select(F.col("id").alias("a"), *XYZ), t.where("id % 3 = 0").select(F.col("id").alias("b"), *XYZ), 8.0)
    return t.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(hit.agg(F.count(F.lit(1)).alias("matched")))


@register("branch_match", f"""WITH {TREE}, u AS (SELECT t.id, t.x, t.y, t.z, p.x - t.x AS dx, p.y - t.y AS dy, p.z - t.z AS dz FROM t JOIN t p ON p.id = t.parent), k AS (SELECT u.* FROM u JOIN (SELECT parent AS id FROM t WHERE parent IS NOT NULL GROUP BY 1 HAVING count(*) > 1) b USING (id)),
  j AS (SELECT m.id AS a, n.id AS b, m.dx*n.dx + m.dy*n.dy + m.dz*n.dz AS dot, row_number() OVER (PARTITION BY m.id ORDER BY n.id) AS r FROM k m JOIN k n ON (m.x-n.x)*(m.x-n.x) + (m.y-n.y)*(m.y-n.y) + (m.z-n.z)*(m.z-n.z) <= 625 AND n.id <> m.id)
  SELECT a, b, dot >= 0 AS same_direction FROM j WHERE r = 1""")
def branch_match(spark, sf):
    t = fx.tree(spark, sf)
    k = trees.with_parent(trees.with_children(t)).where("parent IS NOT NULL AND children > 1")
    k = k.select("id", *XYZ, *((F.col(f"p_{a}") - F.col(a)).alias(f"d{a}") for a in XYZ))
    pairs = matching.within(k.select(F.col("id").alias("a"), *XYZ), k.select(F.col("id").alias("b"), *XYZ), 25.0).where("a <> b")
    first = matching.best(pairs, "b")
    da = k.select(F.col("id").alias("a"), *(F.col(f"d{x}").alias(f"a{x}") for x in XYZ))
    db = k.select(F.col("id").alias("b"), *(F.col(f"d{x}").alias(f"b{x}") for x in XYZ))
    dot = sum(F.col(f"a{x}") * F.col(f"b{x}") for x in XYZ)
    return first.join(da, "a").join(db, "b").select("a", "b", (dot >= 0).alias("same_direction"))


@register("leaf_match", f"WITH {TREE}, l AS (SELECT * FROM t WHERE id NOT IN (SELECT parent FROM t WHERE parent IS NOT NULL)), o AS (SELECT * FROM l WHERE id % 2 = 0) SELECT id, EXISTS (SELECT 1 FROM o WHERE o.id <> l.id AND (l.x-o.x)*(l.x-o.x) + (l.y-o.y)*(l.y-o.y) + (l.z-o.z)*(l.z-o.z) <= 400) AS matched FROM l")
def leaf_match(spark, sf):
    leaves = trees.with_children(fx.tree(spark, sf)).where("children = 0")
    pairs = matching.within(leaves.select(F.col("id").alias("a"), *XYZ), leaves.where("id % 2 = 0").select(F.col("id").alias("b"), *XYZ), 20.0)
    hit = pairs.where("a <> b").select(F.col("a").alias("id"), F.lit(True).alias("hit")).distinct()
    return leaves.join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("matched"))


@register("skeleton_in_mask", f"WITH {IMG}, {mask_sql(25)}, {TREE} SELECT count(*) AS nodes, count(m.x) AS inside, round(count(m.x) / count(*), 6) AS fraction FROM t LEFT JOIN m ON m.x = CAST(t.x AS INTEGER) AND m.y = CAST(t.y AS INTEGER) AND m.z = CAST(t.z AS INTEGER)")
def skeleton_in_mask(spark, sf):
    t = fx.tree(spark, sf).select(*(F.round(a).cast("int").alias(a) for a in XYZ))
    j = t.join(fx.mask(spark, sf, 25).withColumn("on", F.lit(1)), XYZ, "left")
    return j.agg(F.count(F.lit(1)).alias("nodes"), F.count("on").alias("inside"), F.round(F.count("on") / F.count(F.lit(1)), 6).alias("fraction"))


@register("stamp_tree", f"WITH {TREE}, {BOX} SELECT DISTINCT CAST(x AS INTEGER) + dx AS x, CAST(y AS INTEGER) + dy AS y, CAST(z AS INTEGER) + dz AS z FROM t, box WHERE dx*dx + dy*dy + dz*dz <= radius * radius")
def stamp_tree(spark, sf):
    n = fx.tree(spark, sf).select(*(F.round(a).cast("int").alias(a) for a in XYZ), "radius")
    return grid.balls(n).select(*(F.col(f"v{a}").alias(a) for a in XYZ)).distinct()


@register("reached_somas", f"""WITH {TREE}, {PROOF}, j AS (SELECT a.a, t.id AS b, t.radius, (a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y) + (a.z-t.z)*(a.z-t.z) AS d2 FROM a JOIN t ON (a.x-t.x)*(a.x-t.x) + (a.y-t.y)*(a.y-t.y) + (a.z-t.z)*(a.z-t.z) <= 400)
  SELECT a, b, sqrt(d2) <= radius + cbrt(3 * 900 / (4 * pi())) AS reached FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM j) WHERE r = 1""")
def reached_somas(spark, sf):
    t = fx.tree(spark, sf)
    near = matching.nearest(fx.proof(spark, sf), t.select(F.col("id").alias("b"), *XYZ), 20.0)
    tol = (3 * 900 / (4 * math.pi)) ** (1 / 3)
    return near.join(t.select(F.col("id").alias("b"), "radius"), "b").select("a", "b", (F.sqrt("d2") <= F.col("radius") + tol).alias("reached"))


@register("soma_radius_override", f"WITH {TREE}, {SEEDS} SELECT t.id, CAST(coalesce(s.radius, t.radius) AS DOUBLE) AS radius FROM t LEFT JOIN s ON s.seed_id = t.id")
def soma_radius_override(spark, sf):
    s = fx.seeds(spark, sf).select(F.col("seed_id").alias("id"), F.col("radius").cast("double").alias("r"))
    return fx.tree(spark, sf).join(s, "id", "left").select("id", F.coalesce("r", "radius").alias("radius"))


@register("three_way_match", f"WITH {PROOF}, {AUTO}, j AS (SELECT a, min(b) AS b FROM a JOIN b ON {_D2} <= 400 GROUP BY a) SELECT a.a, j.b, o.seed_id IS NOT NULL AS has_offset FROM a LEFT JOIN j ON j.a = a.a LEFT JOIN (SELECT s_suppkey AS seed_id FROM supplier WHERE s_suppkey % 2 = 0) o ON o.seed_id = a.a")
def three_way_match(spark, sf):
    a = fx.proof(spark, sf)
    j = matching.within(a, fx.auto(spark, sf), 20.0).groupBy("a").agg(F.min("b").alias("b"))
    o = fx.seeds(spark, sf).where("seed_id % 2 = 0").select(F.col("seed_id").alias("a"), F.lit(True).alias("o"))
    return a.join(j, "a", "left").join(o, "a", "left").select("a", "b", F.col("o").isNotNull().alias("has_offset"))


@register("seed_volume_radius", f"WITH {SEEDS} SELECT seed_id, CAST(floor(4.0 / 3 * pi() * radius * radius * radius) AS BIGINT) AS volume, round(cbrt(3.0 * (seed_id * 100 + 1) / (4 * pi())), 6) AS radius_of, seed_id % 3 + 1 BETWEEN 2 AND 3 AS kept FROM s")
def seed_volume_radius(spark, sf):
    r = F.col("radius").cast("double")
    return fx.seeds(spark, sf).select("seed_id", coords.radius_to_volume(r).alias("volume"), F.round(coords.volume_to_radius(F.col("seed_id") * 100 + 1), 6).alias("radius_of"), r.between(2.0, 3.0).alias("kept"))


@register("marker_names", f"WITH {SEEDS}, n AS (SELECT seed_id, 'marker_' || x || '_' || y || '_' || z || '_' || (seed_id * 10 + 33) AS name FROM s) SELECT seed_id, name, CAST(split_part(name, '_', 5) AS BIGINT) AS volume, round(cbrt(3.0 * CAST(split_part(name, '_', 5) AS BIGINT) / (4 * pi())), 6) AS radius FROM n")
def marker_names(spark, sf):
    s = fx.seeds(spark, sf)
    named = s.select("seed_id", swc.marker_name(*(F.col(a) for a in XYZ), F.col("seed_id") * 10 + 33).alias("name"))
    volume = swc.marker_volume(F.col("name"))
    return named.select("seed_id", "name", volume.alias("volume"), F.round(coords.volume_to_radius(volume), 6).alias("radius"))


@register("tree_names", f"WITH {SEEDS}, n AS (SELECT seed_id, '[' || x || ',' || y || ',' || z || ']-r=' || radius || '-µm' AS name FROM s) SELECT seed_id, name, CAST(regexp_extract(name, '\\[(\\d+),', 1) AS INTEGER) AS x, CAST(regexp_extract(name, ',(\\d+)\\]', 1) AS INTEGER) AS z FROM n")
def tree_names(spark, sf):
    n = fx.seeds(spark, sf).select("seed_id", coords.tree_file_name(*(F.col(a) for a in XYZ), F.col("radius")).alias("name"))
    c = coords.coords_in_name(F.col("name"))
    return n.select("seed_id", "name", c.x.alias("x"), c.z.alias("z"))


@register("swc_lines", f"WITH {TREE} SELECT id, id || ' ' || type || ' ' || printf('%.3f', x * 0.5) || ' ' || printf('%.3f', y * 0.5) || ' ' || printf('%.3f', z * 1.0) || ' ' || printf('%.3f', radius * 0.5) || ' ' || coalesce(parent, -1) AS line FROM t")
def swc_lines(spark, sf):
    return swc.lines(fx.tree(spark, sf), (0.5, 0.5, 1.0)).select("id", "line")


@register("swc_parse", f"WITH {TREE} SELECT id, type, x, y, z, radius, parent FROM t")
def swc_parse(spark, sf):
    text = swc.lines(fx.tree(spark, sf), (0.5, 0.5, 1.0)).select(F.col("line").alias("value"))
    return swc.parse(text, (0.5, 0.5, 1.0)).select("id", "type", *XYZ, "radius", "parent")


@register("eswc_lines", f"WITH {TREE} SELECT id, id || ' ' || type || ' ' || printf('%.3f', x) || ' ' || printf('%.3f', y) || ' ' || printf('%.3f', z) || ' ' || printf('%.3f', radius) || ' ' || coalesce(parent, 0) || ' 0 0 0 0 1' AS line FROM t")
def eswc_lines(spark, sf):
    return swc.lines(fx.tree(spark, sf), extended=True).select("id", "line")


@register("swc_validation", f"WITH {TREE} SELECT count(*) AS nodes, count(*) FILTER (parent IS NULL) AS roots, min(id) = 1 AND max(id) = count(*) AS consecutive, arg_min(parent IS NULL, id) AS root_first FROM t")
def swc_validation(spark, sf):
    return swc.validate(fx.tree(spark, sf))


@register("apo_lines", f"WITH {SEEDS} SELECT seed_id, x || ',' || y || ',' || z || ',' || radius || ',' || (radius * radius * radius) AS line FROM s")
def apo_lines(spark, sf):
    return fx.seeds(spark, sf).select("seed_id", F.concat_ws(",", *(F.col(a).cast("string") for a in (*XYZ, "radius")), (F.col("radius") * F.col("radius") * F.col("radius")).cast("string")).alias("line"))


@register("cluster_parse", f"WITH {SEEDS} SELECT z - 1 AS zmin, z + 1 AS zmax, y - 1 AS ymin, y + 1 AS ymax, x - 1 AS xmin, x + 1 AS xmax, k, CAST(z + k AS INTEGER) AS z, y, x, CAST(seed_id * 10 + k AS INTEGER) AS mass FROM s, (VALUES (0), (1)) r(k) WHERE k < seed_id % 3")
def cluster_parse(spark, sf):
    s = fx.seeds(spark, sf)
    n = F.col("seed_id") % 3
    soma = lambda k: F.concat_ws(",", (F.col("z") + k).cast("string"), F.col("y").cast("string"), F.col("x").cast("string"), (F.col("seed_id") * 10 + k).cast("string"))
    box = [x.cast("string") for a in ("z", "y", "x") for x in (F.col(a) - 1, F.col(a) + 1)]
    line = F.concat_ws(",", *box, n.cast("string"), F.when(n > 0, soma(0)), F.when(n > 1, soma(1)))
    return tables.clusters_of(s.select(line.alias("line")))


@register("merge_annotations", f"WITH {SEEDS}, u AS (SELECT x, y, z FROM s WHERE seed_id % 2 = 0 UNION SELECT x, y, z FROM s WHERE seed_id % 3 = 0) SELECT x, y, z, row_number() OVER (ORDER BY x, y, z) - 1 AS idx FROM u")
def merge_annotations(spark, sf):
    s = fx.seeds(spark, sf)
    u = s.where("seed_id % 2 = 0").select(*XYZ).unionByName(s.where("seed_id % 3 = 0").select(*XYZ)).distinct()
    return tables.numbered(u, *XYZ)


@register("box_algebra", f"WITH {SEEDS} SELECT z % 4 AS grp, min(x) AS min_x, max(x + radius) AS max_x, min(y) AS min_y, max(y + radius) AS max_y, greatest(max(x), 8) AS clip_lo, least(max(x + radius), 40) AS clip_hi, CAST((max(x + radius) - min(x)) * (max(y + radius) - min(y)) AS BIGINT) AS area FROM s GROUP BY 1")
def box_algebra(spark, sf):
    r = F.col("radius")
    b = fx.seeds(spark, sf).groupBy((F.col("z") % 4).alias("grp")).agg(F.min("x").alias("min_x"), F.max(F.col("x") + r).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + r).alias("max_y"), F.max("x").alias("_x"))
    return b.select("grp", "min_x", "max_x", "min_y", "max_y", F.greatest("_x", F.lit(8)).alias("clip_lo"), F.least("max_x", F.lit(40)).alias("clip_hi"), ((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y"))).cast("long").alias("area"))


@register("run_log_pivot", "SELECT user_id AS run, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'view'), 4) AS view_, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1")
def run_log_pivot(spark, sf):
    p = fx.runlog(spark, sf).groupBy("run").pivot("key", ["click", "view", "purchase"]).agg(F.sum("value"))
    return p.select("run", F.round("click", 4).alias("click"), F.round("view", 4).alias("view_"), F.round("purchase", 4).alias("purchase"))


@register("throughput", "SELECT user_id AS run, round(count(*) * 86400 / 1000 / (1 + sum(value)), 4) AS kilo_per_day FROM events GROUP BY 1")
def throughput(spark, sf):
    return fx.runlog(spark, sf).groupBy("run").agg(F.round(F.count(F.lit(1)) * 86400 / 1000 / (1 + F.sum("value")), 4).alias("kilo_per_day"))


@register("linear_trend", "SELECT l_returnflag AS grp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def linear_trend(spark, sf):
    li = fx.read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"))
    return li.agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@register("radius_factor", f"WITH {TREE}, b AS (SELECT id, radius * 1.5 + id % 2 AS r2 FROM t) SELECT round(avg(r2) / avg(radius), 6) AS mean_ratio, round(median(r2) / median(radius), 6) AS median_ratio FROM t JOIN b USING (id)")
def radius_factor(spark, sf):
    t = fx.tree(spark, sf).withColumn("r2", F.col("radius") * 1.5 + F.col("id") % 2)
    return t.agg(F.round(F.avg("r2") / F.avg("radius"), 6).alias("mean_ratio"), F.round(F.median("r2") / F.median("radius"), 6).alias("median_ratio"))


@register("trimmed_scores", "WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM events, s WHERE abs(value - m) <= 2 * d")
def trimmed_scores(spark, sf):
    return tables.trimmed(fx.runlog(spark, sf), "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@register("two_sample_t", """WITH s AS (SELECT count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_returnflag <> 'R') AS m, avg(l_quantity) FILTER (l_returnflag = 'R') AS ma, avg(l_quantity) FILTER (l_returnflag <> 'R') AS mb,
  var_samp(l_quantity) FILTER (l_returnflag = 'R') AS va, var_samp(l_quantity) FILTER (l_returnflag <> 'R') AS vb FROM lineitem)
  SELECT round((ma - mb) / sqrt(((n - 1) * va + (m - 1) * vb) / (n + m - 2) * (1.0 / n + 1.0 / m)), 5) AS t, CAST(n + m - 2 AS DOUBLE) AS df, greatest(va, vb) / least(va, vb) < 4 AS equal_variance FROM s""")
def two_sample_t(spark, sf):
    t = tables.t_statistic(fx.read(spark, sf, "lineitem"), "l_quantity", F.col("l_returnflag") == "R")
    return t.select(F.round("t", 5).alias("t"), "df", "equal_variance")


@register("class_scores", """WITH c AS (SELECT label AS t, CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS g FROM embeddings), k AS (SELECT DISTINCT t AS class FROM c UNION SELECT DISTINCT g FROM c)
  SELECT class, round(count(*) FILTER (t = class AND g = class) / count(*) FILTER (t = class OR g = class), 6) AS iou, round(coalesce(count(*) FILTER (t = class AND g = class) / nullif(count(*) FILTER (g = class), 0), 0), 6) AS precision_,
  round(coalesce(count(*) FILTER (t = class AND g = class) / nullif(count(*) FILTER (t = class), 0), 0), 6) AS recall FROM k, c GROUP BY class""")
def class_scores(spark, sf):
    e = fx.read(spark, sf, "embeddings").select(F.col("label").alias("t"), F.when(F.col("vec_id") % 5 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("g"))
    return tables.class_scores(e, "t", "g").select("class", *(F.round(c, 6).alias(c) for c in ("iou", "precision_", "recall")))


@register("class_weights", "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, n, round(exp(n / sum(n) OVER ()), 6) AS weight FROM c")
def class_weights(spark, sf):
    c = fx.read(spark, sf, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", "n", F.round(F.exp(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))), 6).alias("weight"))


@register("label_colours", "SELECT vec_id, CAST(label * 65536 + (label * 20) * 256 + (255 - label) AS INTEGER) AS rgb, label AS class FROM embeddings")
def label_colours(spark, sf):
    l = F.col("label")
    rgb = F.shiftleft(l, 16) + F.shiftleft(l * 20, 8) + (F.lit(255) - l)
    coded = fx.read(spark, sf, "embeddings").select("vec_id", rgb.alias("rgb"))
    return coded.withColumn("class", F.shiftright("rgb", 16))


@register("elapsed_times", "SELECT o_orderkey, (s // 86400) || ':' || (s % 86400 // 3600) || ':' || (s % 3600 // 60) || ':' || (s % 60) AS text, s AS seconds FROM (SELECT o_orderkey, o_orderkey * 977 AS s FROM orders)")
def elapsed_times(spark, sf):
    o = fx.read(spark, sf, "orders").select("o_orderkey", coords.elapsed_text(F.col("o_orderkey") * 977).alias("text"))
    return o.withColumn("seconds", coords.elapsed_seconds(F.col("text")))


@register("substantial_files", f"WITH {TREE} SELECT id % 40 AS file, count(*) AS lines FROM t WHERE id % 40 < 10 OR id < 200 GROUP BY 1 HAVING count(*) > 3")
def substantial_files(spark, sf):
    t = fx.tree(spark, sf).where("id % 40 < 10 OR id < 200")
    return t.groupBy((F.col("id") % 40).alias("file")).agg(F.count(F.lit(1)).alias("lines")).where("lines > 3")


@register("compare_trees", f"WITH {TREE}, a AS (SELECT CAST(x AS BIGINT) + 128 * CAST(y AS BIGINT) AS vid FROM t WHERE id % 5 <> 0), b AS (SELECT CAST(x AS BIGINT) + 128 * CAST(y AS BIGINT) AS vid FROM t WHERE id % 7 <> 0), da AS (SELECT DISTINCT vid FROM a), db AS (SELECT DISTINCT vid FROM b) SELECT (SELECT count(*) FROM da JOIN db USING (vid)) AS matches, (SELECT count(*) FROM da ANTI JOIN db USING (vid)) AS missed, (SELECT count(*) FROM db ANTI JOIN da USING (vid)) AS spurious, (SELECT count(*) FROM b) - (SELECT count(*) FROM db) AS duplicates")
def compare_trees(spark, sf):
    t = fx.tree(spark, sf).withColumn("vid", F.col("x").cast("long") + 128 * F.col("y").cast("long"))
    a = t.where("id % 5 <> 0").groupBy("vid").agg(F.lit(1).alias("na"))
    b = t.where("id % 7 <> 0").groupBy("vid").agg(F.count(F.lit(1)).alias("nb"))
    na, nb = F.col("na").isNotNull(), F.col("nb").isNotNull()
    j = a.join(b, "vid", "full")
    return j.agg(F.count_if(na & nb).alias("matches"), F.count_if(na & ~nb).alias("missed"), F.count_if(nb & ~na).alias("spurious"), F.sum(F.when(nb, F.col("nb") - 1).otherwise(0)).alias("duplicates"))


@register("cut_subvolumes", f"WITH {IMG}, {SEEDS}, b AS (SELECT seed_id, least(greatest(x - 8, 0), 48) AS x0, least(greatest(y - 8, 0), 48) AS y0, z FROM s) SELECT seed_id, i.x - x0 AS x, i.y - y0 AS y, i.z, i.v FROM b JOIN img i ON i.z = b.z AND i.x >= x0 AND i.x < x0 + 16 AND i.y >= y0 AND i.y < y0 + 16")
def cut_subvolumes(spark, sf):
    """The image is the build side: the seeds' cells, 256 a seed, would be planned as a broadcast."""
    s = fx.seeds(spark, sf)
    low = lambda a: F.least(F.greatest(F.col(a) - 8, F.lit(0)), F.lit(48))
    side = F.sequence(F.lit(0), F.lit(15))
    cells = s.select("seed_id", "z", low("x").alias("x0"), low("y").alias("y0"), F.explode(side).alias("i")).withColumn("j", F.explode(side))
    cells = cells.select("seed_id", "z", (F.col("x0") + F.col("i")).alias("x"), (F.col("y0") + F.col("j")).alias("y"), "i", "j")
    return cells.join(fx.image(spark, sf).hint("shuffle_hash"), XYZ).select("seed_id", F.col("i").alias("x"), F.col("j").alias("y"), "z", "v")


@register("seeds_in_box", f"WITH {SEEDS}, q(box, x0, x1, y0, y1) AS (VALUES (1, 0, 20, 0, 30), (2, 10, 50, 20, 64), (3, 60, 64, 0, 64)) SELECT seed_id, count(*) AS boxes FROM s JOIN q ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1")
def seeds_in_box(spark, sf):
    """Half-open boxes, a fixed list of three: one predicate each, no join."""
    boxes = ((0, 20, 0, 30), (10, 50, 20, 64), (60, 64, 0, 64))
    hits = sum(((F.col("x") >= a) & (F.col("x") < b) & (F.col("y") >= c) & (F.col("y") < d)).cast("long") for a, b, c, d in boxes)
    return fx.seeds(spark, sf).select("seed_id", hits.alias("boxes")).where("boxes > 0")
