"""Count-based windows over frames. A frame finds its windows by arithmetic on t, so no task gathers a whole recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import rest
from .numbering import segmented

KEYS = ("recording_id", "label", "start")


def stride_of(width: int, overlap: float = 0.75) -> int:
    return max(1, int(width * (1 - overlap)))


def lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy("recording_id").agg(F.first("label").alias("label"), F.count("*").cast("int").alias("n"))


def quantile_length(frames: DataFrame, q: float = 0.9) -> int:
    """The exact, interpolated quantile of lengths, cut to a whole number; 0 without recordings."""
    return int(lengths(frames).agg(F.percentile("n", F.lit(q)).alias("w")).first()["w"] or 0)


def with_length(frames: DataFrame) -> DataFrame:
    return frames.join(lengths(frames).select("recording_id", "n"), "recording_id")


def covering(t: Column, last: Column, width: int, stride: int) -> Column:
    """Starts 0, stride, ... up to `last` whose window holds t."""
    low = F.greatest(F.lit(0), F.ceil((t - width + 1) / stride).cast("int")) * stride
    high = F.least(t, last)
    return F.when(low <= high, F.sequence(low, F.greatest(low, high), F.lit(stride))).otherwise(F.array().cast("array<int>"))


def filled(short: DataFrame, offset: Column, width: int, flex: int, pads: int) -> DataFrame:
    """Rest frames of windows of short recordings, whose own frames begin at `offset`."""
    rows = short.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).where((F.col("t") < offset) | (F.col("t") >= offset + F.col("n")))
    return rows.select(*KEYS, "t", *[c.alias(k) for c, k in zip(rest(flex, pads), ("flex", "z", "r"), strict=True)], F.lit(True).alias("is_rest"))


def move(a: Column, b: Column) -> Column:
    """Absolute differences of two frames' flex channels."""
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def placements(n: Column, width: int) -> Column:
    return F.array_distinct(F.array(F.lit(0), F.floor((width - n) / 2).cast("int"), (width - n).cast("int")))


def sliding(frames: DataFrame, width: int, overlap: float = 0.75, flex: int = 1, pads: int = 5) -> DataFrame:
    """recording_id, label, start, t, flex, z, r, is_rest, step: windows of `width` frames.

    Longer recordings: every stride, and the tail. Others are placed at the start, middle and end of one window, rest
    frames around them, and `start` is that place. `step` is how far each flex channel moved since the frame before in the
    window, the moves from and to rest frames counted with the recording's own frame. An empty table gives no rows.
    """
    stride = stride_of(width, overlap)
    before = F.lag("flex").over(Window.partitionBy("recording_id", "_seg").orderBy("t"))
    moved = segmented(frames, "t", before=1).withColumn("step", F.coalesce(move(F.col("flex"), before), F.array_repeat(F.lit(0.0), flex)))
    rows = with_length(moved.where("_own").drop("_seg", "_own"))
    last = F.col("n") - width
    tail = F.when(F.col("t") >= last, F.array(last)).otherwise(F.array().cast("array<int>"))
    starts = F.when(F.col("n") > width, F.array_union(covering(F.col("t"), last, width, stride), tail)).otherwise(placements(F.col("n"), width))
    own = rows.withColumn("start", F.explode(starts))
    still = F.array_repeat(F.lit(0.0), flex)
    edges = F.when((F.col("t") == 0) & (F.col("start") > 0), 1).otherwise(0) + F.when((F.col("t") == F.col("n") - 1) & (F.col("start") + F.col("n") < width), 1).otherwise(0)
    to_rest = F.zip_with("step", move(F.col("flex"), rest(flex, pads)[0]), lambda a, b: a + b * edges)
    step = F.when(F.col("n") <= width, to_rest).when(F.col("t") > F.col("start"), F.col("step")).otherwise(still)
    place = F.when(F.col("n") > width, F.col("t") - F.col("start")).otherwise(F.col("t") + F.col("start"))
    own = own.withColumn("step", step).select(*KEYS, place.alias("t"), "flex", "z", "r", F.lit(False).alias("is_rest"), "step")
    short = lengths(frames).where(F.col("n") < width).withColumn("start", F.explode(placements(F.col("n"), width)))
    return own.unionByName(filled(short, F.col("start"), width, flex, pads).withColumn("step", still))


def gold_segment(frames: DataFrame, width: int, flex: int = 1, pads: int = 5) -> DataFrame:
    """As sliding(), one window each: short recordings in the middle, long ones with all their frames."""
    rows = with_length(frames)
    offset = F.greatest(F.lit(0), F.floor((width - F.col("n")) / 2)).cast("int")
    own = rows.select("recording_id", "label", F.lit(0).alias("start"), (F.col("t") + offset).alias("t"), "flex", "z", "r", F.lit(False).alias("is_rest"))
    short = lengths(frames).where(F.col("n") < width).withColumn("start", F.lit(0))
    return own.unionByName(filled(short, offset, width, flex, pads))


def full_windows(frames: DataFrame, width: int, stride: int) -> DataFrame:
    """Windows as a stream gives them: every stride, full ones only, no tail."""
    rows = with_length(frames).withColumn("start", F.explode(covering(F.col("t"), F.col("n") - width, width, stride)))
    return rows.select(*KEYS, (F.col("t") - F.col("start")).alias("t"), "flex", "z", "r", F.lit(False).alias("is_rest"))


def right_aligned(frames: DataFrame, width: int, stride: int, channels: int) -> DataFrame:
    """recording_id, label, start, t, flat, mask: a window at every stride, short ones at the end with zeros before them.

    frames: recording_id, label, t, flat."""
    rows = with_length(frames).withColumn("start", F.explode(covering(F.col("t"), F.col("n") - 1, width, stride)))
    size = F.least(F.lit(width), F.col("n") - F.col("start"))
    own = rows.select(*KEYS, (F.col("t") - F.col("start") + width - size).alias("t"), "flat", F.lit(True).alias("mask"))
    short = lengths(frames).withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(stride)))).where(F.col("n") - F.col("start") < width)
    pad = short.withColumn("t", F.explode(F.sequence(F.lit(0), width - (F.col("n") - F.col("start")) - 1)))
    return own.unionByName(pad.select(*KEYS, "t", F.array_repeat(F.lit(0.0), channels).alias("flat"), F.lit(False).alias("mask")))


def pad_or_truncate(frames: DataFrame, width: int, channels: int) -> DataFrame:
    """recording_id, label, t, flat, mask: the first `width` frames, zeros after the end."""
    own = frames.where(F.col("t") < width).select("recording_id", "label", "t", "flat", F.lit(True).alias("mask"))
    short = lengths(frames).where(F.col("n") < width).withColumn("t", F.explode(F.sequence(F.col("n"), F.lit(width - 1))))
    return own.unionByName(short.select("recording_id", "label", "t", F.array_repeat(F.lit(0.0), channels).alias("flat"), F.lit(False).alias("mask")))


def smoothed(frames: DataFrame, channels: int = 1) -> DataFrame:
    """Flex as the mean of a frame and its two neighbours, as far as there are any."""
    near = Window.partitionBy("recording_id", "_seg").orderBy("t").rowsBetween(-1, 1)
    means = F.array(*[F.avg(F.col("flex")[c]).over(near) for c in range(channels)])
    return segmented(frames, "t", before=1, after=1).withColumn("flex", means).where("_own").drop("_seg", "_own")


def gathered(windows: DataFrame) -> DataFrame:
    """One row a window: `frames`, its frames in order; at most as many as the window is wide."""
    return windows.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("t", "flex", "z", "r"))).alias("frames"))
