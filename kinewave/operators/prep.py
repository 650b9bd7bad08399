"""Preparing rows for classifiers: label codes, scaling, splits, one-hot vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .numbering import numbered

#: Labels that are numbered in one array: some 10 MB.
MOST_LABELS = 100_000


def label_codes(rows: DataFrame, label: str = "label", most: int = MOST_LABELS) -> DataFrame:
    """label, class_id: distinct labels in order, from 0. Up to `most` are numbered as one sorted array, more by ranges."""
    distinct = rows.where(F.col(label).isNotNull()).select(label).distinct()
    if distinct.limit(most + 1).count() > most:
        return numbered(distinct, [F.col(label)], "class_id").select(label, F.col("class_id").cast("int").alias("class_id"))
    classes = distinct.agg(F.sort_array(F.collect_list(label)).alias("c"))
    return classes.select(F.posexplode("c").alias("class_id", label)).select(label, "class_id")


def encoded(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.join(label_codes(rows, label), label, "left")


def one_hot(class_id: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == class_id).cast("int"))


def scaler(rows: DataFrame, column: str) -> DataFrame:
    """pos, mean, std (population; 1 where it is 0) of each component of an array column."""
    return rows.select(F.posexplode(column).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("s")).select(
        "pos", "mean", F.when(F.col("s") > 0, F.col("s")).otherwise(1.0).alias("std")
    )


def scaled(rows: DataFrame, fitted: DataFrame, column: str) -> DataFrame:
    """The array column, scaled. `fitted` is a row per component, so it comes to the driver."""
    by = {r["pos"]: r for r in fitted.collect()}
    m, s = (F.array(*[F.lit(float(by[i][k])) for i in range(len(by))]) for k in ("mean", "std"))
    if not by:
        return rows
    return rows.withColumn(column, F.transform(column, lambda x, i: (x - F.get(m, i)) / F.get(s, i)))


def split_by_hash(rows: DataFrame, key: str, test: float = 0.2, seed: int = 42) -> DataFrame:
    """Column is_test: rows of a key stay together, so windows of a recording never part."""
    return rows.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(10_000)) < int(test * 10_000))


def split_by_remainder(rows: DataFrame, key: str, every: int = 5) -> DataFrame:
    return rows.withColumn("is_test", F.col(key) % every == 0)


def three_way(raw: DataFrame, train: float = 0.7, validation: float = 0.15, seed: int = 42) -> DataFrame:
    """Column part of raw (recording_id, label): exact shares of each class if every class has three rows or more, else of all.

    Of the n rows of a class, in order of a hash, the first round(n * (1 - train)) are left out of training, and of these
    the first half, rounded up, is the validation part (for equal shares), the rest the test part. Sorting is by class, as
    places in a class are counted; a class spills, and is not collected.
    """
    key = [F.col("label")] if (raw.groupBy("label").count().agg(F.min("count")).first()[0] or 0) >= 3 else [F.lit(0)]
    order = F.md5(F.concat_ws(":", F.lit(seed), "recording_id").cast("binary"))
    rows = raw.withColumn("_place", F.row_number().over(Window.partitionBy(*key).orderBy(order, "recording_id"))).withColumn("_n", F.count("*").over(Window.partitionBy(*key)))
    out = F.floor(F.col("_n") * F.lit(1 - train) + 0.5)
    valid = F.ceil(out * F.lit(round(validation / (1 - train), 9)))
    return rows.withColumn("part", F.when(F.col("_place") > out, "train").when(F.col("_place") <= valid, "validation").otherwise("test")).drop("_place", "_n")


def write_scaler(fitted: DataFrame, path: str) -> None:
    """pos, mean, std, a row a component; scaled() takes what read_scaler() gives."""
    fitted.select("pos", "mean", "std").write.mode("overwrite").parquet(path)


def read_scaler(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("pos int, mean double, std double").parquet(path)


def with_copies(raw: DataFrame, copies: DataFrame) -> DataFrame:
    """raw (with part) and those augmented copies (recording_id) whose original is in the training part."""
    kept = copies.join(raw.where("part = 'train'").select("recording_id"), "recording_id", "left_semi")
    return raw.withColumn("is_copy", F.lit(False)).unionByName(kept.withColumn("part", F.lit("train")).withColumn("is_copy", F.lit(True)), allowMissingColumns=True)
