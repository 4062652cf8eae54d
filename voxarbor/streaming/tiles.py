"""Per-tile thresholds and histograms of planes that arrive as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def planes(spark: SparkSession, path: str, schema: str = "x int, y int, z int, v int") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def tile_counts(voxels: DataFrame, depth: int = 8, width: int = 8) -> DataFrame:
    """Running counts per tile of `depth` planes and bin of `width` values; mergeable, so
    thresholds and histograms follow from them."""
    return voxels.groupBy(F.floor(F.col("z") / depth).cast("int").alias("tile"), F.floor(F.col("v") / width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def event_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Windowed counts and sums by type with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def start(counts: DataFrame, table: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Write running counts to a memory table; checkpoint names a shared folder."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
