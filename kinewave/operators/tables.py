"""Tables in the folder that driver and executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session (tests) that names none gets a folder of its own, a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows, written once and read back."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # shuffle files of the job go when it has ended
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(rows.schema).parquet(path)
    out._stored_at = path
    return out


def discarded(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """new, once the files of `old`, a table of stored() that nothing reads any more, are removed."""
    if old is not None:
        path = old.sparkSession._jvm.org.apache.hadoop.fs.Path(old._stored_at)
        path.getFileSystem(old.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    return new


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a column of arrays of one length; nulls in them are NaN."""
    flat = column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded by bytes, as a row may be a packed shard; plans read this when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
