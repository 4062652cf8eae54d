"""Sinks and sidecars: volumes with metadata, meshes, graphs, markers, clusters, histograms."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .swc import marker_name


def write_volume(voxels: DataFrame, path: str, meta: dict[str, str] | None = None, slab: int = 64) -> None:
    """Voxels as Parquet in z-slabs, so that a region read prunes folders; metadata beside."""
    voxels.withColumn("slab", F.floor(F.col("z") / slab).cast("int")).write.mode("overwrite").partitionBy("slab").parquet(f"{path}/voxels")
    rows = [("slab", str(slab)), *(meta or {}).items()]
    voxels.sparkSession.createDataFrame(rows, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_volume(spark: SparkSession, path: str, z: tuple[int, int] | None = None) -> DataFrame:
    """Voxels of z in [low, high); only the slabs in reach are read."""
    v = spark.read.parquet(f"{path}/voxels")
    if z is not None:
        slab = int(read_meta(spark, path).get("slab", "64"))
        v = v.where((F.col("slab") >= z[0] // slab) & (F.col("slab") <= (z[1] - 1) // slab) & (F.col("z") >= z[0]) & (F.col("z") < z[1]))
    return v.drop("slab")


def read_meta(spark: SparkSession, path: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}


def obj_lines(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(part, idx, line) of an OBJ file: vertices (idx from 0, x, y, z), then faces (idx, v: ids)."""
    v = vertices.select(F.lit(0).alias("part"), "idx", F.format_string("v %.3f %.3f %.3f", *(F.col(a).cast("double") for a in "xyz")).alias("line"))
    f = faces.select(F.lit(1).alias("part"), "idx", F.concat(F.lit("f "), F.concat_ws(" ", F.transform("v", lambda i: (i + 1).cast("string")))).alias("line"))
    return v.unionByName(f)


def marker_lines(seeds: DataFrame) -> DataFrame:
    """(name, line) of marker files; names hold whole positions and the volume."""
    whole = [F.col(a).cast("long") for a in "xyz"]
    return seeds.select(marker_name(*whole, F.col("volume")).alias("name"), F.concat_ws(",", *(F.col(a).cast("string") for a in (*"xyz", "radius"))).alias("line"))


def cluster_lines(clusters: DataFrame) -> DataFrame:
    """Cluster rows with their somas (array of structs z, y, x, mass) as one CSV line each."""
    box = [F.col(c).cast("string") for c in ("zmin", "zmax", "ymin", "ymax", "xmin", "xmax")]
    soma = F.transform("somas", lambda s: F.concat_ws(",", *(s[c].cast("string") for c in ("z", "y", "x", "mass"))))
    return clusters.select(F.concat_ws(",", *box, F.size("somas").cast("string"), soma).alias("line"))


def histogram_lines(histogram: DataFrame) -> DataFrame:
    return histogram.select("bin", F.concat_ws(",", *(F.col(c).cast("string") for c in ("bin", "n", "pct", "cum_pct"))).alias("line"))


def ano_lines(name: str) -> list[str]:
    return [f"APOFILE={name}.apo", f"SWCFILE={name}.swc"]


def write_lines(lines: DataFrame, path: str, *order: str) -> None:
    lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def next_run(taken: list[str], stem: str) -> str:
    """stem-N with the smallest N after those taken."""
    used = [int(m[1]) for t in taken if (m := re.fullmatch(rf"{re.escape(stem)}-(\d+)", t))]
    return f"{stem}-{max(used, default=-1) + 1}"


def conversion_name(stem: str, fg_percent: float | None = None, z_offset: int | None = None) -> str:
    out = stem
    if fg_percent is not None:
        out += f"-fgpct-{fg_percent:.3f}"
    return out if z_offset is None else f"{out}-zoff{z_offset}"


def apo_to_seeds(apo: DataFrame, edge: float) -> DataFrame:
    """`n,x,y,z,volsize` rows of an annotation as seeds in micrometres with their volume."""
    return apo.select("n", *((F.col(a) * F.lit(edge)).alias(a) for a in "xyz"), F.col("volsize").cast("double").alias("volume"), F.cbrt(3.0 * F.col("volsize") / (4 * F.pi())).alias("radius"))


def clamp_byte(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0)), F.lit(255)).cast("int")
