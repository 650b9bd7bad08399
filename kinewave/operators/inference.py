"""Recognition end to end: windows, features, a fitted scaler and classifier, debounced emissions, labels."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinewave.functions import scalars as S

from . import debounce, features, neighbours, prep, windows

#: Features of a window that the classifier sees, by flex channel.
STATS = ("mean", "var", "energy", "max", "min", "slope")


VERSIONS = "version int, folder string, settings string"
#: How recordings are cut: windows at every stride and the tail, short recordings placed; full windows only; or windows at
#: every stride to the end, right-aligned with zeros before them, of normalised channels.
CUTS = ("sliding", "full", "aligned")


def normalised(frames: DataFrame) -> DataFrame:
    """recording_id, label, t, flat: all channels within 0 to 1, grouped (flex, z, r)."""
    unit = F.concat("flex", F.transform("z", S.unit_z), F.transform("r", S.unit_r))
    return frames.select("recording_id", "label", "t", F.transform(unit, lambda x: S.clip(x)).alias("flat"))


def window_vectors(frames: DataFrame, width: int, flex: int = 1, pads: int = 5, cut: str = "sliding", smooth: bool = False) -> DataFrame:
    """id, recording_id, label, window_id, v: the vector of each window, numbered by start in its recording; see CUTS.

    v is a window's features, or for aligned windows all their frames in a row. smooth: flex is the mean of a frame and its
    neighbours first. id is a number of its own for each window: recording and start in one (starts are below 2**20).
    """
    frames = windows.smoothed(frames, flex) if smooth else frames
    if cut == "aligned":
        rows = windows.right_aligned(normalised(frames), width, windows.stride_of(width), flex + 2 * pads).groupBy(*windows.KEYS)
        table = rows.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("t", "flat"))), lambda f: f.flat)).alias("v"))
        values = F.col("v")
    else:
        rows = windows.sliding(frames, width, flex=flex, pads=pads) if cut == "sliding" else windows.full_windows(frames, width, windows.stride_of(width))
        table = features.feature_table(rows, flex, pads)
        values = F.array(*[F.col(n).cast("double") for n in [f"flex{c}_{k}" for c in range(flex) for k in STATS] + [f"pad{p}_{k}" for p in range(pads) for k in ("max_z", "corr_r")]])
    number = F.row_number().over(Window.partitionBy("recording_id").orderBy("start")) - 1
    own = F.shiftleft(F.col("recording_id").cast("long"), 20) + F.col("start")
    return table.select(own.alias("id"), "recording_id", "label", number.alias("window_id"), values.alias("v"))


@dataclass
class Fitted:
    """What recognition needs of training: class codes, the scaler, and a classifier: means and variances of each class
    (bayes), or a function from scaled vectors (id, v) to id, class_id, prob."""

    codes: DataFrame
    scaler: DataFrame
    bayes: DataFrame | None = None
    classify: Callable[[DataFrame], DataFrame] | None = None


def fit(vectors: DataFrame, classifier: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None) -> Fitted:
    """Codes, scaler and classifier of window vectors. classifier: from scaled training rows (id, class_id, v) to what
    Fitted.classify is, naive Bayes by default; e.g. by_neighbours()."""
    scaler = prep.scaler(vectors, "v")
    coded = prep.scaled(prep.encoded(vectors).where("class_id is not null"), scaler, "v")
    codes = prep.label_codes(vectors)
    return Fitted(codes, scaler, classify=classifier(coded)) if classifier else Fitted(codes, scaler, neighbours.bayes_fit(coded))


def by_neighbours(k: int = 5, widths: list[int] | None = None, weighted: bool = True) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """A classifier for fit(): shares of the votes of the k nearest training windows, by warping of parts of these widths
    (and the distance of the rest), or without widths by Euclidean distance."""

    def fitted(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        near = (lambda rows: neighbours.nearest_warped(rows, train, k, widths)) if widths else (lambda rows: neighbours.nearest(rows, train, k))
        return lambda rows: neighbours.votes(near(rows.withColumn("class_id", F.lit(-1).cast("long"))), weighted)

    return fitted


def class_probabilities(vectors: DataFrame, fitted: Fitted) -> DataFrame:
    """id, probs: an array of class probabilities in order of class_id; classes that a classifier does not name have 0."""
    rows = prep.scaled(vectors, fitted.scaler, "v")
    if fitted.classify:
        each, n = fitted.classify(rows.select("id", "v")), fitted.codes.count()
        named = each.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("class_id").cast("int"), "prob"))).alias("p"))
        return named.select("id", F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda c: F.coalesce(F.element_at("p", c), F.lit(0.0))).alias("probs"))
    each = neighbours.softmax(neighbours.bayes_scores(rows, fitted.bayes))
    return each.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "prob"))), lambda x: x.prob).alias("probs"))


def ranked(probabilities: DataFrame) -> DataFrame:
    """id, rank, class_id, prob of probabilities (id, class_id, prob): likeliest first, ties to the lower class."""
    order = Window.partitionBy("id").orderBy(F.desc("prob"), "class_id")
    return probabilities.select("id", F.row_number().over(order).alias("rank"), "class_id", "prob")


def decoded(rows: DataFrame, codes: DataFrame, column: str = "class_id") -> DataFrame:
    """rows with the label of their class id, null for an unknown one; codes: label, class_id."""
    return rows.join(codes.select(F.col("class_id").alias(column), "label"), column, "left")


def recognised(frames: DataFrame, fitted: Fitted, width: int, flex: int = 1, pads: int = 5, cut: str = "sliding", smooth: bool = False, **settings) -> DataFrame:
    """session, window_id, label, confidence: what each recording emits, window by window, after debouncing.

    See window_vectors() for cut and smooth, which have to be those of training, and debounce.debounced() for the settings;
    streaming.recognise gives the same from a stream of frames.
    """
    vectors = window_vectors(frames, width, flex, pads, cut, smooth)
    return emitted(vectors, fitted, **settings)


def emitted(vectors: DataFrame, fitted: Fitted, **settings) -> DataFrame:
    """session, window_id, label, confidence of window vectors (id, recording_id, window_id, v)."""
    rows = vectors.join(class_probabilities(vectors, fitted), "id").select(F.col("recording_id").alias("session"), "window_id", "probs")
    return decoded(debounce.debounced(rows, **settings), fitted.codes).select("session", "window_id", "label", "confidence")


def summary(emissions: DataFrame) -> DataFrame:
    """class_id, n, sessions, confidence, first_window of emissions (session, window_id, class_id, confidence)."""
    return emissions.groupBy("class_id").agg(
        F.count("*").alias("n"), F.count_distinct("session").alias("sessions"), F.avg("confidence").alias("confidence"), F.min("window_id").alias("first_window")
    )


def save(fitted: Fitted, path: str, **settings) -> int:
    """Write codes, scaler, classifier and settings (width, flex, pads, cut, smooth ...) as a new version; its number.

    Tables of a version have a folder of their own; the line of the version comes last, so that what a lost writer left is
    never read. Only the naive Bayes classifier is written; others are functions.
    """
    if fitted.bayes is None:
        raise ValueError("this classifier is a function, which no table holds")
    spark, folder = fitted.codes.sparkSession, f"{path}/{uuid.uuid4().hex}"
    for name in ("codes", "scaler", "bayes"):
        getattr(fitted, name).write.parquet(f"{folder}/{name}")
    version = len(versions(spark, path)) + 1
    spark.createDataFrame([(version, folder, json.dumps(settings, ensure_ascii=False))], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


def versions(spark: SparkSession, path: str) -> list:
    """Lines of what save() wrote, by version."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return []
    return spark.read.schema(VERSIONS).parquet(f"{path}/versions").orderBy("version").collect()


def load(spark: SparkSession, path: str, version: int | None = None) -> tuple[Fitted, dict]:
    """What save() wrote: the last version or the one asked for, and its settings, for recognised(frames, fitted, **settings)."""
    found = [r for r in versions(spark, path) if version in (None, r.version)]
    if not found:
        raise ValueError(f"{path} has no version {version or ''}")
    tables = [spark.read.parquet(f"{found[-1].folder}/{name}") for name in ("codes", "scaler", "bayes")]
    return Fitted(*tables), json.loads(found[-1].settings)
