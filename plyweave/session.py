"""Cutting the lineage of frames that later steps use several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the master is local, a temporary folder."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plyweave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: plans built on it start from there, read the columns they need, and survive lost executors."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def steady_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that a run of very long texts stays small in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
