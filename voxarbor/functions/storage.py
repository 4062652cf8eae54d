"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir.  Where the session names none, one below
    /tmp is set if driver and executors are one process (local mode); on a cluster that
    would be another folder on each machine, so the setting is asked for."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/voxarbor"
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/voxarbor-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame and read it back: lineage ends there, and fixpoint loops stay flat."""
    at = shared_dir(df.sparkSession)
    df.write.parquet(f"{at}/t")
    read = df.sparkSession.read.schema(df.schema).parquet(f"{at}/t")
    read.written_at = at
    return read


def release(*frames: DataFrame) -> None:
    """Delete the tables that materialise() wrote for these frames; nothing may read them
    afterwards, a lazy frame built on them included."""
    for df in frames:
        at = getattr(df, "written_at", None)
        if at is None:
            continue
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
        df.written_at = None
