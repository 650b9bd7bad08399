"""Numbers of rows in an order, and windows over neighbours, without a task that holds all rows of a key.

Rows are dealt by ranges of the order, so a key's rows lie in as many partitions as they need; a number is the place in the
partition and what lies before it, and that is a sum over partitions or over runs of a key, not over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Rows of one key that one task may sort (it spills); and places of a key that one segment of segmented() holds.
MOST, LENGTH = 1_000_000, 65_536
LARGEST, _LOW = "largest", (1 << 33) - 1


def ranged(rows: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """rows with _part and _pos, their range partition and place there, in `order`; equal rows are dealt by a number of their own."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    every = [*order, F.col("_tie")]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts, *every).sortWithinPartitions(*every).drop("_tie")
    dealt = dealt.withColumn("_at", F.monotonically_increasing_id())
    return stored(dealt.withColumn("_part", F.shiftright("_at", 33)).withColumn("_pos", F.col("_at").bitwiseAND(F.lit(_LOW))).drop("_at"), "ranged")


def numbered(rows: DataFrame, order: list[Column], column: str, parts: int | None = None) -> DataFrame:
    """rows with their number in `order` from 0 (long), ties in any order. Collected or broadcast is a row per partition."""
    placed = ranged(rows, order, parts)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(column, F.col("_before") + F.col("_pos")).drop("_part", "_pos", "_before")


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], column: str, most: int = MOST, parts: int | None = None, largest: int | None = None) -> DataFrame:
    """rows with their number among those of equal keys in `order` from 0 (long). largest: rows of the largest key, if known;
    the column's metadata say it to segmented().

    Where no key has more than `most` rows, a window by key sorts them. Else rows go by ranges of (keys, order): only the
    first run of a partition can continue a key, so what earlier partitions hold of it is a row per partition.
    """
    if largest is None:
        largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    told = {LARGEST: largest}
    if largest <= most:
        return rows.withColumn(column, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long")).withMetadata(column, told)
    placed = ranged(rows, [*map(F.col, keys), *order], parts)
    runs = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.withColumn("_before", F.sum("_n").over(before)).where("_first = 0 and _before is not null").select("_part", "_before")
    run = Window.partitionBy("_part", *keys)
    own = placed.withColumn("_first", F.min("_pos").over(run)).join(F.broadcast(carried), "_part", "left")
    number = F.col("_pos") - F.col("_first") + F.when(F.col("_first") == 0, F.coalesce("_before", F.lit(0))).otherwise(0)
    return own.withColumn(column, number).drop("_part", "_pos", "_first", "_before").withMetadata(column, told)


def largest_of(rows: DataFrame, place: str) -> int | None:
    """Rows of the largest key at most, if the column of places says so."""
    return rows.schema[place].metadata.get(LARGEST)


def segmented(rows: DataFrame, place: str, before: int = 0, after: int = 0, length: int = LENGTH) -> DataFrame:
    """rows with _seg and _own: segments of `length` places; those within reach of a neighbouring segment come there too.

    A window by (key, _seg) over up to `before` rows behind and `after` ahead gives rows with _own what a window by key
    would, whatever the key's size. Places of a key are 0, 1, 2, ... without gaps. Where no key is known to be longer than a
    segment, all rows are in segment 0.
    """
    if (most := largest_of(rows, place)) is not None and most <= length:
        return rows.withColumn("_seg", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    own = F.floor(F.col(place) / length)
    near = [own, F.when(F.col(place) % length >= length - before, own + 1), F.when((F.col(place) % length < after) & (own > 0), own - 1)]
    return rows.withColumn("_seg", F.explode(F.array_compact(F.array(*near)))).withColumn("_own", F.col("_seg") == own)
