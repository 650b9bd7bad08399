"""Window features: statistics of flex channels, pads at their strongest touch, order of first touches, distances to exemplars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinewave.functions import scalars as S

from .windows import KEYS, gathered, gold_segment, move

#: Pad levels (z + 1) whose first time is ranked, and how many labels get an exemplar.
LEVELS = (1, 3, 4, 5)
TOP_LABELS = 20
#: Frames that all exemplars of anchor_distances() may have together: some 20 MB, as they come along with the tasks.
MOST_FRAMES = 200_000


def channel(c: int) -> Column:
    return F.transform("frames", lambda f: f.flex[c])


def at_strongest(p: int, field: str) -> Column:
    """z or r of a pad at the first frame of its largest z."""
    best = F.array_max(F.transform("frames", lambda f: F.struct(f.z[p].alias("z"), (-f.t).alias("first"), f.r[p].alias("r"))))
    return best[field]


def flex_sums(c: int, name: str, advanced: bool) -> list[Column]:
    """Statistics of a channel as aggregates, which are summed before the shuffle."""
    v = F.col("flex")[c]
    out = {"mean": F.avg(v), "var": F.var_pop(v), "energy": F.sum(F.col("step")[c])}
    if advanced:
        out |= {"max": F.max(v), "min": F.min(v), "slope": F.coalesce(F.regr_slope(v, F.col("t").cast("double")), F.lit(0.0))}
    return [x.alias(f"{name}_{k}") for k, x in out.items()]


def strongest(p: int) -> Column:
    """z and r of a pad at the first frame of its largest z, as an aggregate."""
    return F.max(F.struct(F.col("z")[p].alias("z"), (-F.col("t")).alias("first"), F.col("r")[p].alias("r")))


def first_times(pads: int) -> list[Column]:
    """For each pad and level the first t of that level, null if there is none, as aggregates; in order of pad, then level."""
    return [F.min(F.when(S.shift_z(F.col("z")[p]) == level, F.col("t"))) for p in range(pads) for level in LEVELS]


def ranks(times: Column) -> Column:
    """1 for the earliest; ties in order of place; 0 where null."""
    return F.transform(
        times,
        lambda x, i: F.when(x.isNull(), 0).otherwise(
            1 + F.size(F.filter(F.transform(times, lambda y, j: F.coalesce((y < x) | ((y == x) & (j < i)), F.lit(False))), lambda b: b))
        ),
    )


def with_steps(windows: DataFrame) -> DataFrame:
    """windows with the column step of windows.sliding(), taken within each window."""
    before = F.lag("flex").over(Window.partitionBy(*KEYS).orderBy("t"))
    return windows.withColumn("step", F.coalesce(move(F.col("flex"), before), F.transform("flex", lambda x: x * 0)))


def feature_table(windows: DataFrame, flex: int = 1, pads: int = 5, advanced: bool = True) -> DataFrame:
    """A row for each window with `flex{c}_*` and `pad{p}_*` columns: one shuffle of partial sums, then a projection.

    Basic: mean, var, energy, largest z and its r as read. Advanced: further statistics, z + 1, r in three bins, and the
    rank of the first time of each pad and level. Only the fold of trend changes needs a window's values in order; where
    its column is dropped, no frames are gathered.
    """
    names = [f"flex{c}" for c in range(flex)]
    sums = [x for c, name in enumerate(names) for x in flex_sums(c, name, advanced)] + [strongest(p).alias(f"_pad{p}") for p in range(pads)]
    if advanced:
        sums.append(F.array(*first_times(pads)).alias("_times"))
        sums += [F.transform(F.sort_array(F.collect_list(F.struct("t", F.col("flex")[c].alias("x")))), lambda f: f.x).alias(f"_{name}") for c, name in enumerate(names)]
    rows = (windows if "step" in windows.columns else with_steps(windows)).groupBy(*KEYS).agg(*sums)
    stats = ("mean", "var", "energy", "max", "min", "sig_changes", "slope") if advanced else ("mean", "var", "energy")
    columns = [(S.trend_changes(F.col(f"_{name}")) if k == "sig_changes" else F.col(f"{name}_{k}")).alias(f"{name}_{k}") for name in names for k in stats]
    for p in range(pads):
        z, r = F.col(f"_pad{p}.z"), F.col(f"_pad{p}.r")
        columns += [(S.shift_z(z) if advanced else z).alias(f"pad{p}_max_z"), (S.bin_r(r) if advanced else r).alias(f"pad{p}_corr_r")]
    if not advanced:
        return rows.select(*KEYS, *columns)
    order = [F.get("_ranks", F.lit(p * len(LEVELS) + k)).alias(f"pad{p}_{level}") for p in range(pads) for k, level in enumerate(LEVELS)]
    return rows.withColumn("_ranks", ranks(F.col("_times"))).select(*KEYS, *columns, *order)


def raw_table(windows: DataFrame, flex: int = 1, pads: int = 5) -> DataFrame:
    """A row for each window: each flex channel as an array, z + 1 and binned r of each pad; `vector` is all of them."""
    rows = gathered(windows)
    values = [v for p in range(pads) for v in (S.shift_z(at_strongest(p, "z")), S.bin_r(at_strongest(p, "r")))]
    columns = [channel(c).alias(f"flex{c}") for c in range(flex)]
    vector = F.concat(*[channel(c) for c in range(flex)], F.array(*values).cast("array<double>"))
    names = [f"pad{p}_{k}" for p in range(pads) for k in ("max_z", "corr_r")]
    return rows.select(*KEYS, *columns, *[v.alias(n) for v, n in zip(values, names, strict=True)], vector.alias("vector"))


def top_labels(recordings: DataFrame, k: int = TOP_LABELS) -> DataFrame:
    """label, n, first_seen of the k most frequent labels; ties in order of first sight. recordings: recording_id, label."""
    return recordings.groupBy("label").agg(F.count("*").alias("n"), F.min("recording_id").alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(k)


def exemplar_frames(frames: DataFrame, width: int, k: int = TOP_LABELS, flex: int = 1, pads: int = 5) -> DataFrame:
    """Frames, one row each, of the first recording of each of the k top labels, as gold_segment() gives them: all of a long one."""
    ids = frames.groupBy("recording_id").agg(F.first("label").alias("label"))
    first = top_labels(ids, k).select(F.col("first_seen").alias("recording_id"))
    return gold_segment(frames.join(F.broadcast(first), "recording_id", "left_semi"), width, flex, pads)


def exemplars(frames: DataFrame, width: int, k: int = TOP_LABELS, flex: int = 1, pads: int = 5) -> DataFrame:
    """label, gold: the exemplars with their frames flattened in one array each; k rows at most.

    An error if they have more than MOST_FRAMES frames in all, which is counted before any frame is gathered.
    """
    own = exemplar_frames(frames, width, k, flex, pads)
    if (n := own.count()) > MOST_FRAMES:
        raise ValueError(f"exemplars of {n} frames are too long to go along with each task; cut the recordings first")
    return gathered(own).select("label", F.transform("frames", flat).alias("gold"))


def flat(f: Column) -> Column:
    return F.concat(f.flex, F.flatten(F.zip_with(f.z, f.r, lambda a, b: F.array(a, b))).cast("array<double>"))


def warp_many(seqs: np.ndarray, gold: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Warping distances of many sequences of one length (count, n, channels) to one; all go through the table together."""
    count, n, _ = seqs.shape
    m = len(gold)
    row = np.full((m + 1, count), np.inf)
    row[0] = 0
    for i in range(n):
        cost = np.sqrt(((seqs[:, i, None, :] - gold[None]) ** 2 * weights).sum(axis=2)).T
        best = np.minimum(row[1:], row[:-1])
        row[0] = np.inf
        for j in range(m):
            row[j + 1] = cost[j] + np.minimum(best[j], row[j])
    return row[m] / (n + m)


def anchor_distances(windows: DataFrame, gold: DataFrame, weights: list[float], block: int = 512) -> DataFrame:
    """recording_id, label, start, anchor, distance of each window to each exemplar, by weighted time warping.

    Exemplars are TOP_LABELS rows at most and come along with the tasks. Windows are warped in blocks, as the same sums
    as an expression (scalars.frame_dtw) take some hundred times as long.
    """
    channels, w = len(weights), np.array(weights, float)
    anchors = [(r["label"], np.array(r["gold"], float).reshape(-1, channels)) for r in gold.orderBy("label").limit(TOP_LABELS).collect()]
    rows = gathered(windows).select(*KEYS, F.flatten(F.transform("frames", flat)).alias("seq"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in KEYS), f"anchor {kinds['label']}", "distance double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq")
            sizes = seqs.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                for s in range(0, len(places), block):
                    some = pa.array(places[s : s + block])
                    a = seqs.take(some).flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1, channels)
                    keys = [batch.column(k).take(some) for k in KEYS]
                    for label, g in anchors:
                        yield pa.RecordBatch.from_arrays([*keys, pa.array([label] * len(some), keys[1].type), pa.array(warp_many(a, g, w))], names=[*KEYS, "anchor", "distance"])

    return rows.mapInArrow(run, schema)


def wide_distances(distances: DataFrame, labels: list) -> DataFrame:
    """A column dtw_<label> for each given label."""
    return distances.groupBy(*KEYS).pivot("anchor", labels).agg(F.first("distance")).select(*KEYS, *[F.col(f"`{x}`").alias(f"dtw_{x}") for x in labels])


def first_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_r = 1").drop("_r")
