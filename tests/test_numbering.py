"""Numbering and windows of hot keys against plain ones."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kinewave.operators.numbering import numbered, numbered_within, segmented


@pytest.fixture(scope="module")
def rows(spark):
    """A third of 3,000 rows has one key; nulls in key and order; ties in the order."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k"), F.col("id"), (F.xxhash64("id") % 500).alias("x"))
    return df.withColumn("x", F.when(F.col("id") % 91 == 0, None).otherwise(F.col("x")))


def test_numbers_of_all_rows(rows):
    got = numbered(rows, [F.col("x").desc(), F.col("id")], "n", 5).orderBy("n").collect()
    want = rows.orderBy(F.col("x").desc(), "id").collect()
    assert [(r.x, r.id, r.n) for r in got] == [(r.x, r.id, i) for i, r in enumerate(want)]


def test_numbers_within_keys_do_not_depend_on_the_plan(rows):
    order = [F.col("x"), F.col("id")]
    plain = {r.id: r.n for r in numbered_within(rows, ["k"], order, "n").collect()}
    for parts in (1, 3, 16):
        assert {r.id: r.n for r in numbered_within(rows, ["k"], order, "n", most=0, parts=parts).collect()} == plain
    assert max(plain.values()) >= 999


def test_hot_key_is_spread_over_partitions(rows):
    from kinewave.operators.numbering import ranged

    spread = ranged(rows, [F.col("k"), F.col("id")], 12).where("k = 7").groupBy("_part").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) <= 2 * 3000 / 12


def test_repeated_rows_and_empty_tables(spark, rows):
    same = spark.range(400).select(F.lit(1).alias("k"), F.lit(2).alias("x"))
    assert sorted(r.n for r in numbered_within(same, ["k"], [F.col("x")], "n", most=0, parts=4).collect()) == list(range(400))
    assert sorted(r.n for r in numbered(same, [F.col("x")], "n", 4).collect()) == list(range(400))
    for f in (lambda d: numbered(d, [F.col("x")], "n"), lambda d: numbered_within(d, ["k"], [F.col("x")], "n", most=0)):
        assert f(rows.where("false")).columns[-1] == "n" and f(rows.where("false")).count() == 0


def test_windows_over_segments_equal_windows_over_keys(rows):
    placed = numbered_within(rows, ["k"], [F.col("id")], "t")
    whole = Window.partitionBy("k").orderBy("t")
    part = Window.partitionBy("k", "_seg").orderBy("t")
    make = lambda w: {"sum": F.sum("id").over(w.rowsBetween(-2, 1)), "lag": F.lag("id", 2).over(w), "lead": F.lead("id").over(w)}
    want = sorted(map(tuple, placed.withColumns(make(whole)).select("id", "sum", "lag", "lead").collect()))
    got = segmented(placed, "t", before=2, after=1, length=16).withColumns(make(part)).where("_own").select("id", "sum", "lag", "lead").collect()
    assert sorted(map(tuple, got)) == want


def test_frames_of_one_recording_of_all_events(spark, sf):
    """One user has all events: frames and windows do not change when numbering goes by ranges and windows by segments."""
    from kinewave.operators import frames, windows

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("user_id", F.lit(3).cast("long"))
    plain = sorted(map(str, frames.from_events(events).collect()))
    hot = frames.from_events(events, most=0)
    assert sorted(map(str, hot.collect())) == plain and len(plain) == events.count()
    moves = [windows.sliding(f, 40).agg(F.round(F.sum(F.col("step")[0]), 6)).first() for f in (hot, frames.from_events(events))]
    assert moves[0] == moves[1]
