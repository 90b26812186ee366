"""What the operators of this subpackage share: cutting lineage and small lookup tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is missing, and the master is local, a temporary folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="plyweave-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Paths that :func:`cut` wrote since each :func:`settled` that is running began.
_written: list[list[str]] = []


def cut(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there.

    Unlike a local checkpoint it survives the loss of any executor.
    """
    path = scratch(df.sparkSession, label)
    for paths in _written[-1:]:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`cut` that no later plan reads."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settled(spark: SparkSession, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The frame that ``make`` returns, written and read back; what was written on the way to it is deleted."""
    _written.append([])
    try:
        out = make()
    finally:
        paths = _written.pop()
    out = cut(out, label)
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return out


def steady_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, so that a run of very long texts stays small in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table from the driver; callers state the bound on ``rows``."""
    return F.broadcast(spark.createDataFrame(rows, schema))
