"""Streaming queries, run to the end of what is there and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from voxarbor.functions.storage import shared_dir
from voxarbor.streaming import tiles

from . import fixtures as fx
from .registry import register


def _drain(spark, counts, mode="complete"):
    name = f"stream_{uuid.uuid4().hex}"
    tiles.start(counts, name, f"{shared_dir(spark)}/stream", mode).awaitTermination()
    return spark.table(name)


@register("stream_tile_counts", "SELECT CAST(floor((l_orderkey % 32) / 8) AS INTEGER) AS tile, CAST(floor(CAST(l_quantity AS INTEGER) / 8) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2")
def stream_tile_counts(spark, sf):
    """Voxel rows as they arrive (not reduced to one per cell)."""
    schema = fx.read(spark, sf, "lineitem").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf}/lineite*.parquet")
    v = rows.select((F.col("l_partkey") % 64).cast("int").alias("x"), (F.col("l_suppkey") % 64).cast("int").alias("y"), (F.col("l_orderkey") % 32).cast("int").alias("z"), F.col("l_quantity").cast("int").alias("v"))
    return _drain(spark, tiles.tile_counts(v))


@register("stream_event_windows", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_event_windows(spark, sf):
    schema = fx.read(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/event*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drain(spark, tiles.event_windows(events))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", F.round("total", 4).alias("total"))
