"""What both vector searches share: valid vectors, distinct vectors with their smallest ids, shards and query blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

QUERY_BLOCK = 1024


def valid(vectors: DataFrame, allow_zero: bool) -> DataFrame:
    """vec_id, v (array of double): rows without null or non-finite components, empty vectors and null ids."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return rows if allow_zero else rows.where(F.exists("v", lambda x: x != 0))


def distinct(rows: DataFrame, keep: int) -> DataFrame:
    """v, dim, ids: each vector once, with its `keep` smallest ids in order.

    No answer of fewer than `keep` neighbours can hold a further id, as equal vectors score alike and ties go to smaller
    ids. Rows beyond are left out before the shuffle (a rank limit), so that a common vector gathers nowhere.
    """
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("r", rank).where(F.col("r") <= keep)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("v"))


def sharded(classes: DataFrame, size: int) -> DataFrame:
    """classes with a shard, as many as hold each about `size` vectors; vectors of another length go to other shards."""
    n = classes.count()
    return classes.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "v"), F.lit(n // size + 1)).cast("int"))


def query_blocks(rows: DataFrame, every: int) -> DataFrame:
    """dim, block, qids, qs (binary): rows whose id is divisible by `every`, packed."""
    queries = rows.where(F.col("vec_id") % every == 0).select("vec_id", "v", F.size("v").alias("dim"))
    blocks = queries.count() // QUERY_BLOCK + 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(blocks)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        vectors = np.array(table["v"].to_pylist(), np.float64)
        return pa.table(
            {
                "dim": pa.array([vectors.shape[1]], pa.int32()),
                "block": pa.array([table["block"][0].as_py()], pa.int32()),
                "qids": [np.array(table["vec_id"].to_pylist(), np.int64).tobytes()],
                "qs": [vectors.tobytes()],
            }
        )

    return queries.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, qids binary, qs binary")


def paired(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """Each packed query block with each shard of its length: the stated queries against all rows, in blocks.

    A shard goes to `parts` tasks, as many as keep the cluster busy, and meets a part of the blocks in each; so shards are
    shipped a few times in all, and only the blocks, which are small, go to every shard.
    """
    last, n_blocks = shards.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0], blocks.agg(F.coalesce(F.max("block"), F.lit(0))).first()[0] + 1
    parts = min(n_blocks, 2 * partitions(blocks.sparkSession) // (last + 1) + 1)
    some = blocks.withColumn("part", F.col("block") % parts).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    return some.join(shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), ["dim", "shard", "part"])


def flat_ids(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in ids], np.int64)
    return np.concatenate([np.array(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64), np.concatenate([[0], np.cumsum(counts)])


def best_of(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all shards, ties to smaller ids."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
