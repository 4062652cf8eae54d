"""SWC, ESWC and marker files as text columns: lines, parsing, validation, directories.

Coordinates are voxels inside and micrometres in files: positions scale by each axis'
voxel edge, radii by the smallest edge.  A root has parent -1 in SWC and 0 in ESWC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("id", "type", "x", "y", "z", "radius", "parent")


def lines(tree: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), extended: bool = False) -> DataFrame:
    """Adds the file line of every node."""
    at = [F.col(a) * F.lit(float(s)) for a, s in zip("xyz", voxel, strict=True)]
    line = F.format_string("%d %d %.3f %.3f %.3f %.3f %d", "id", "type", *at, F.col("radius") * F.lit(float(min(voxel))), F.coalesce("parent", F.lit(0 if extended else -1)))
    return tree.withColumn("line", F.concat(line, F.lit(" 0 0 0 0 1")) if extended else line)


def parse(text: DataFrame, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), key: str | None = None) -> DataFrame:
    """Lines (column value) as nodes.  Fields are split by blanks or commas, comments and
    blank lines skipped; parent -1, 0 or the node itself means a root."""
    f = F.split(F.trim("value"), r"[\s,]+")
    rows = text.where(~F.trim("value").rlike(r"^(#|$)")).withColumn("f", f)
    n = [F.col("f")[i] for i in range(7)]
    parent = n[6].cast("double").cast("long")
    node = n[0].cast("double").cast("long")
    cols = [node.alias("id"), n[1].cast("double").cast("int").alias("type"), *((n[2 + i].cast("double") / F.lit(float(s))).alias(a) for i, (a, s) in enumerate(zip("xyz", voxel, strict=True))),
            (n[5].cast("double") / F.lit(float(min(voxel)))).alias("radius"), F.when((parent > 0) & (parent != node), parent).alias("parent")]
    return rows.select(*([key] if key else []), *cols)


def validate(tree: DataFrame, *key: str) -> DataFrame:
    """Per tree: node count, root count, whether ids are 1..n and whether the first is a root."""
    ids = F.col("id")
    return tree.groupBy(*key).agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"),
                                  ((F.min(ids) == 1) & (F.max(ids) == F.count(F.lit(1)))).alias("consecutive"), F.min_by(F.col("parent").isNull(), ids).alias("root_first"))


def read(spark: SparkSession, path: str, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """All trees of a file or folder, keyed by file name."""
    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.swc").text(path).select("value", F.col("_metadata.file_name").alias("tree"))
    return parse(text, voxel, "tree")


def write(tree: DataFrame, path: str, key: str = "tree", voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), extended: bool = False) -> None:
    """One folder per tree; a tree's lines are in order within its file."""
    out = lines(tree, voxel, extended).repartition(key).sortWithinPartitions(key, F.col("parent").isNotNull(), "id")
    out.select(key, F.col("line").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def marker_name(x: Column, y: Column, z: Column, volume: Column) -> Column:
    return F.concat_ws("_", F.lit("marker"), *(c.cast("string") for c in (x, y, z, volume)))


def marker_volume(name: Column) -> Column:
    return F.regexp_extract(name, r"marker_-?\d+_-?\d+_-?\d+_(\d+)", 1).cast("long")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """Seeds of a folder of marker files `x,y,z,radius`; radius 0 comes from the volume in the
    file name."""
    text = spark.read.option("pathGlobFilter", "*marker*").text(path).where("value NOT LIKE '#%' AND trim(value) <> ''")
    f = F.split("value", ",")
    volume = marker_volume(F.col("_metadata.file_name"))
    r = F.coalesce(F.nullif(f[3].cast("double"), F.lit(0.0)), F.cbrt(3.0 * volume / (4 * F.pi())))
    return text.select(F.col("_metadata.file_name").alias("name"), *(f[i].cast("double").alias(a) for i, a in enumerate("xyz")), r.alias("radius"))
