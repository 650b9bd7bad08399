"""Debounced emissions of class probabilities, window by window: gate, mean of the last few, cooldown."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import MOST, largest_of, numbered_within, segmented
from .tables import stored

EMISSIONS = "session long, window_id int, class_id int, confidence double"


@dataclass
class Debouncer:
    """State of one session, fed window by window (streams). `strict`: the mean has to exceed the threshold, and gated windows go on to the mean;
    else reaching it is enough, and gated windows end there."""

    threshold: float = 0.6
    size: int = 4
    cooldown: int = 4
    strict: bool = True
    wait: int = 0
    last: int = -1
    queue: deque = field(default_factory=deque)

    def push(self, probs: list[float]) -> tuple[int, float] | None:
        gated = max(probs) < self.threshold
        self.queue.append([0.0] * len(probs) if gated else list(probs))
        if len(self.queue) > self.size:
            self.queue.popleft()
        if gated and not self.strict:
            self.wait = max(0, self.wait - 1)
            return None
        if len(self.queue) < self.size:
            return None
        means = [reduce(add, x) / self.size for x in zip(*self.queue, strict=True)]  # plain sums, oldest first, as in the window
        top = max(means)
        best = means.index(top)
        if not (top > self.threshold if self.strict else top >= self.threshold) or (self.wait > 0 and best == self.last):
            self.wait = max(0, self.wait - 1)
            return None
        self.wait, self.last = self.cooldown, best
        return best, top


def judged(rows: DataFrame, threshold: float, size: int, strict: bool, most: int, length: int) -> tuple[DataFrame, int]:
    """session, window_id, place, seg, top, best, passes of rows with probabilities, and the size of the largest session.

    place counts a session's windows, seg its segments. Gate and mean are windows over the last `size` rows, which come along
    from the segment before.
    """
    clean = F.transform("probs", lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))
    own = rows.where("probs is not null and size(probs) > 0").select("session", "window_id", clean.alias("probs"))
    largest = largest_of(own, "window_id")
    if largest is None:  # the rows may be dear to make, so they are made once
        own = stored(own, "probabilities")
        largest = own.groupBy("session").count().agg(F.max("count")).first()[0] or 0
    placed = segmented(numbered_within(own, ["session"], [F.col("window_id")], "place", most, largest=largest), "place", before=size - 1, length=length)
    gated = F.array_max("probs") < threshold
    near = Window.partitionBy("session", "_seg").orderBy("place").rowsBetween(1 - size, 0)
    last = F.collect_list(F.when(gated, F.transform("probs", lambda _: F.lit(0.0))).otherwise(F.col("probs"))).over(near)
    out = placed.withColumn("gated", gated).withColumn("last", last).where("_own")
    means = F.transform(F.aggregate(F.slice("last", 2, size), F.element_at("last", 1), lambda a, x: F.zip_with(a, x, lambda p, q: p + q)), lambda x: x / size)
    out = out.withColumn("means", means).withColumn("top", F.array_max("means"))
    reached = F.col("top") > threshold if strict else (F.col("top") >= threshold) & ~F.col("gated")
    return out.select("session", "window_id", "place", F.col("_seg").alias("seg"), "top", (F.array_position("means", F.col("top")) - 1).cast("int").alias("best"), (reached & (F.col("place") >= size - 1)).alias("passes")), largest


class Cooldown:
    """The fold over windows that pass: one is held back if it has the class of the last emission, at most `wait` windows ago.

    A state is the last emission (off, cls: its offset from a segment's start, negative; its class). What a segment does to
    any state is told by its starts: the few windows that can be its first emission, each with the state that it leads to.
    All further windows follow from that, so starts of segments can be joined without their windows.
    """

    def __init__(self, wait: int) -> None:
        self.wait = wait

    def free(self) -> Column:
        return self.state(F.lit(-self.wait - 1), F.lit(-1))

    @staticmethod
    def state(off: Column, cls: Column) -> Column:
        return F.struct(off.cast("long").alias("off"), cls.cast("int").alias("cls"))

    def held(self, off: Column, cls: Column, last: Column) -> Column:
        return (cls == last.cls) & (off - last.off <= self.wait)

    def later(self, last: Column, by: Column) -> Column:
        """The state, seen from a start that lies `by` windows later."""
        return self.state(F.greatest(last.off - by, F.lit(-self.wait - 1)), last.cls)

    def emitted(self, passing: Column, last: Column) -> Column:
        """The emissions among passing (off, cls, ...) windows in order, after the state `last`."""
        out = F.slice(passing, 1, 0)

        def step(s: Column, x: Column) -> Column:
            held = self.held(x.off, x.cls, s.last)
            return F.struct(F.when(held, s.last).otherwise(self.state(x.off, x.cls)).alias("last"), F.when(held, s.out).otherwise(F.concat(s.out, F.array(x))).alias("out"))

        return F.aggregate(passing, F.struct(last.alias("last"), out.alias("out")), step, lambda s: s.out)

    def starts(self, passing: Column) -> Column:
        """first (off, cls) and last (state) of each window that can be the first emission: those within the wait, and the next."""
        near = F.filter(passing, lambda x: x.off < self.wait)
        able = F.slice(passing, 1, F.size(near) + 1)

        def end(x: Column) -> Column:
            follow = lambda s, y: F.when((y.off <= x.off) | self.held(y.off, y.cls, s), s).otherwise(self.state(y.off, y.cls))
            return F.struct(self.state(x.off, x.cls).alias("first"), F.aggregate(passing, self.state(x.off, x.cls), follow).alias("last"))

        return F.transform(able, end)

    def after(self, starts: Column, last: Column) -> Column:
        """The state at the end of a segment that began with `last`, as seen from its start."""
        own = F.filter(starts, lambda s: ~self.held(s.first.off, s.first.cls, last))
        return F.when(F.size(own) > 0, F.get(own, F.lit(0)).last).otherwise(last)

    def joined(self, a: Column, b: Column, length: Column) -> Column:
        """Starts of a segment of `length` windows, more than the wait, and the one that follows it. What holds back all starts
        of the former holds back none of the latter."""
        moved = lambda s: self.state(s.off + length, s.cls)
        own = F.transform(a, lambda s: F.struct(s.first.alias("first"), moved(self.after(b, self.state(s.last.off - length, s.last.cls))).alias("last")))
        next_ = F.transform(F.slice(b, 1, 1), lambda s: F.struct(moved(s.first).alias("first"), moved(s.last).alias("last")))
        return F.when(F.exists(a, lambda s: s.first.off >= self.wait), own).otherwise(F.concat(own, next_))


    def all_joined(self, below: Column, length: int, kind: str) -> Column:
        """Starts of consecutive segments (seg, starts) of `length` windows each, joined."""
        none = F.struct(F.array().cast(kind).alias("starts"), F.lit(0).cast("long").alias("n"))
        add = lambda a, x: F.struct(F.when(a.n == 0, x.starts).otherwise(self.joined(a.starts, x.starts, a.n * length)).alias("starts"), (a.n + 1).alias("n"))
        return F.aggregate(below, none, add, lambda a: a.starts)

    def entered(self, below: Column, entry: Column, length: int) -> Column:
        """seg and entry of consecutive segments, the first of which begins in the state `entry`."""
        none = F.slice(F.transform(below, lambda x: F.struct(x.seg.alias("seg"), entry.alias("entry"))), 1, 0)

        def add(a: Column, x: Column) -> Column:
            own = F.concat(a.out, F.array(F.struct(x.seg.alias("seg"), a.now.alias("entry"))))
            return F.struct(self.later(self.after(x.starts, a.now), F.lit(length)).alias("now"), own.alias("out"))

        return F.aggregate(below, F.struct(entry.alias("now"), none.alias("out")), add, lambda a: a.out)


def entries(segments: DataFrame, fold: Cooldown, length: int, fan: int, levels: int) -> DataFrame:
    """session, seg, entry: the state in which each segment (session, seg, starts) begins.

    Segments are joined `fan` at a time up to one a session, and from there the states come down again: a task never holds
    more than `fan` segments of a session.
    """
    sizes, tables, kind = [length * fan**k for k in range(levels)], [segments], dict(segments.dtypes)["starts"]
    for size in sizes:
        group = tables[-1].groupBy("session", F.floor(F.col("seg") / fan).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("seg", "starts"))).alias("below"))
        tables.append(stored(group.withColumn("starts", fold.all_joined(F.col("below"), size, kind)), "segments"))
    down = tables[-1].select("session", "seg", fold.free().alias("entry"))
    for size, group in zip(reversed(sizes), reversed(tables[1:]), strict=True):
        own = group.select("session", "seg", "below").join(down, ["session", "seg"])
        down = own.select("session", F.explode(fold.entered(F.col("below"), F.col("entry"), size)).alias("x")).select("session", "x.seg", "x.entry")
    return down


def debounced(rows: DataFrame, threshold: float = 0.6, size: int = 4, cooldown: int = 4, strict: bool = True, most: int = MOST, length: int = 256, fan: int = 64) -> DataFrame:
    """session, window_id, class_id, confidence of rows (session, window_id, probs): what each session emits, as Debouncer does.

    Gate and mean are window expressions over segments of `length` windows. Emissions follow from each other, so segments
    are folded for the few states that matter, joined up a tree, and then folded once from the state that they begin in: a
    session of any length is spread over tasks. Rows of a session with null or empty probabilities are skipped, null
    components count as 0; null sessions are one session. Window numbers of a session are expected to differ.
    """
    length, fold = max(length, cooldown + 1, size), Cooldown(cooldown)
    windows, largest = judged(rows, threshold, size, strict, most, length)
    passing = F.when(F.col("passes"), F.struct((F.col("place") % length).alias("off"), F.col("best").alias("cls"), "window_id", "top"))
    segments = windows.withColumn("session", F.struct("session")).groupBy("session", "seg").agg(F.sort_array(F.collect_list(passing)).alias("passing"))
    if largest <= length:
        folded = segments.withColumn("entry", fold.free())
    else:
        segments = stored(segments.withColumn("starts", fold.starts(F.col("passing"))), "segments")
        levels = next(k for k in range(1, 64) if length * fan**k >= largest)
        folded = segments.join(entries(segments.select("session", "seg", "starts"), fold, length, fan, levels), ["session", "seg"])
    out = folded.select("session.session", F.explode(fold.emitted(F.col("passing"), F.col("entry"))).alias("x"))
    return out.select("session", F.col("x.window_id").cast("int").alias("window_id"), F.col("x.cls").alias("class_id"), F.col("x.top").alias("confidence"))
