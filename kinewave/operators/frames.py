"""Frames, one row each: recording_id, label, t, flex (array of double), z and r (arrays of int, a value per pad)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import MOST, numbered_within

#: Channel names of a recording, and the rest frame's values.
FLEX = tuple(f"flex{i}" for i in range(8, 16))
PADS = tuple(f"PAD_CH{i}" for i in range(7))
REST_FLEX, REST_Z, REST_R = 0.0, -1, 0
#: Event types that stand for pads in the adapter below.
EVENT_PADS = ("click", "error", "purchase", "signup", "view")


def rest(flex: int, pads: int) -> tuple[Column, Column, Column]:
    return (
        F.array_repeat(F.lit(REST_FLEX), flex),
        F.array_repeat(F.lit(REST_Z), pads),
        F.array_repeat(F.lit(REST_R), pads),
    )


def from_recordings(recordings: DataFrame, by_name: bool = True) -> DataFrame:
    """Frames of recordings (recording_id, label, frames). Pads by name, a missing one at rest and the last of a name
    counting; or by place in the list."""
    rows = recordings.select("recording_id", "label", F.posexplode("frames").alias("t", "f"))
    flex = F.array(*[F.coalesce(F.col("f.flex")[name]["curl"], F.lit(REST_FLEX)).cast("double") for name in FLEX])
    if by_name:
        def of(name: str, field: str, default: int) -> Column:
            own = F.filter("f.pads", lambda p: p.n == name)
            return F.coalesce(F.element_at(F.when(F.size(own) > 0, own), -1)[field], F.lit(default)).cast("int")

        z = F.array(*[of(name, "z", REST_Z) for name in PADS])
        r = F.array(*[of(name, "r", REST_R) for name in PADS])
    else:
        z, r = F.transform("f.pads", lambda p: p.z.cast("int")), F.transform("f.pads", lambda p: p.r.cast("int"))
    return rows.select("recording_id", "label", "t", flex.alias("flex"), z.alias("z"), r.alias("r"))


def from_events(events: DataFrame, most: int = MOST) -> DataFrame:
    """Frames of an event table: a user is a recording, its value the flex channel, the event type the pad that is touched.

    Events of a user are numbered by event_id; users of more than `most` events by ranges, see numbering.numbered_within().
    """
    k = F.get_json_object("props", "$.k").cast("int")
    events = numbered_within(events.select("user_id", "event_id", "event_type", "value", "props"), ["user_id"], [F.col("event_id")], "t", most)
    touched = lambda value, default: F.array(*[F.when(F.col("event_type") == p, value).otherwise(F.lit(default)) for p in EVENT_PADS])
    return events.select(
        F.col("user_id").alias("recording_id"),
        (F.col("user_id") % 7).cast("int").alias("label"),
        F.col("t").cast("int").alias("t", metadata=events.schema["t"].metadata),
        F.array(F.least(F.col("value") / 100, F.lit(1.0))).alias("flex"),
        touched(k % 6 - 1, REST_Z).alias("z"),
        touched(k * 20, REST_R).alias("r"),
    )


def flattened(frames: DataFrame, grouped: bool) -> DataFrame:
    """One array a frame: flex, then all z and all r (grouped), or z and r of each pad in turn."""
    pads = F.concat("z", "r") if grouped else F.flatten(F.zip_with("z", "r", lambda a, b: F.array(a, b)))
    return frames.select("recording_id", "label", "t", F.concat("flex", pads.cast("array<double>")).alias("flat"))


def channel_ranges(frames: DataFrame) -> DataFrame:
    """channel, n, min, max, mean, std (population) and in_range (0 to 1) of each flex channel, partial sums first."""
    long = frames.select(F.posexplode("flex").alias("channel", "v"))
    return long.groupBy("channel").agg(
        F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
        ((F.min("v") >= -1e-5) & (F.max("v") <= 1 + 1e-5)).alias("in_range"),
    )
