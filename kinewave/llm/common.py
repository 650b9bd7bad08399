"""Shared helpers of the corpus operators: shared folder, written tables, Arrow batches, text cleaning."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets one only if it is local (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, name: str, *done: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    The job's shuffle files are removed when the write has ended, and the tables `done` (of earlier calls) as well, so that
    later steps do not pile up on disk.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    discard(*done)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write df to the shared folder in buckets of a column: groups and cogroups by it need no exchange of this side.

    The table is known to the catalog only until it is read here; its files are those of written().
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.repartition(buckets, column).write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(table)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # an external table: its files stay
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables that written() gave, once nothing reads them any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bound an Arrow batch by bytes, as a row here may be a whole text or a packed shard.

    Plans read this when they run, so all operators set the same bound, and none counts on a number of rows.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Classes that hold this part of all rows, or more, count as hot: as many of them as this says can exist, so they are broadcast.
HOT = 1000


def joined_back(rows: DataFrame, classes: DataFrame, key: str) -> DataFrame:
    """rows with what `classes` (key, copies, ...: one row a key, copies the rows that have it) says of their key.

    Classes with a thousandth of all rows or more come by broadcast: there are a thousand at most. Their rows pass the
    shuffled join under salts that match nothing, so no task gets more than a thousandth of all rows for one key. Rows
    are read once; those whose key is null or unknown get nulls.
    """
    total = classes.agg(F.sum("copies")).first()[0] or 0
    told = [c for c in classes.columns if c not in (key, "copies")]
    classes = classes.withColumn("_told", F.struct(*told))
    hot, rest = (classes.where(f"copies * {HOT} {sign} {total}") for sign in (">=", "<"))
    out = rows.join(F.broadcast(hot.select(key, F.col("_told").alias("_hot"))), key, "left")
    spread = F.col("_hot").isNull() & F.col(key).isNotNull()
    out = out.withColumn("_salt", F.when(spread, 0).otherwise(1 + F.monotonically_increasing_id() % 100_000))
    out = out.join(rest.select(key, "_told", F.lit(0).cast("long").alias("_salt")), [key, "_salt"], "left")
    return out.select(*rows.columns, F.coalesce("_hot", "_told").alias("_told")).select(*rows.columns, *[F.col(f"_told.{c}") for c in told])


def text_of(column: str = "text") -> Column:
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """mapInArrow over columns: make() runs once a task and returns a function from a dict of lists to one."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(each(batch.to_pydict()), schema=arrow)

    return df.mapInArrow(run, schema)


def safe_cuts(text: str, limit: int, good: Callable[[str, int], bool]) -> list[int]:
    """Ascending positions where text may be cut, about every `limit` characters; good(text, i) allows a cut before i.

    Where no position is good, the stretch stays whole.
    """
    cuts, i, n = [], limit, len(text)
    while i < n:
        if good(text, i):
            cuts.append(i)
            i += limit
        else:
            i += 1
    return cuts
