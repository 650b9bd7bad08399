"""The registered queries over the driver's tables, and their DuckDB twins where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinewave.functions import scalars as S
from kinewave.operators import augment, boosting, debounce, features, frames, inference, metrics, neighbours, prep, svm, windows
from kinewave.operators.tables import stored

WIDTH, STRIDE = 40, 10
PADS = len(frames.EVENT_PADS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.from_events(table(spark, sf_dir, "events"))


def r6(x) -> F.Column:
    return F.round(x + 1e-12, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = features.feature_table(windows.sliding(glove(spark, sf_dir), WIDTH))
    return rounded(out.drop("flex0_sig_changes"))


flagship = window_features


def quantile_window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = glove(spark, sf_dir)
    return rounded(features.feature_table(windows.sliding(rows, windows.quantile_length(rows)), advanced=False))


def trend_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.gathered(windows.sliding(glove(spark, sf_dir), WIDTH))
    return rows.select(*windows.KEYS, S.trend_changes(features.channel(0)).cast("long").alias("changes"))


def raw_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.raw_table(windows.sliding(glove(spark, sf_dir), WIDTH))
    return rows.select(*windows.KEYS, F.size("vector").cast("long").alias("size"), r6(S.total(F.transform("vector", lambda x, i: x * (i + 1)))).alias("weighted"))


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.full_windows(glove(spark, sf_dir), WIDTH, STRIDE)
    return rows.groupBy(*windows.KEYS).agg(F.count("*").alias("n"), r6(F.sum(F.col("flex")[0] * (F.col("t") + 1))).alias("weighted"))


def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = frames.flattened(glove(spark, sf_dir), grouped=True)
    rows = windows.right_aligned(flat, WIDTH, STRIDE, 1 + 2 * PADS)
    return rows.groupBy(*windows.KEYS).agg(F.count("*").alias("n"), F.count_if("mask").alias("real"), r6(F.sum(F.col("flat")[0] * F.col("t"))).alias("weighted"))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = frames.flattened(glove(spark, sf_dir), grouped=True)
    rows = windows.pad_or_truncate(flat, 78, 1 + 2 * PADS)
    return rows.groupBy("recording_id", "label").agg(F.count("*").alias("n"), F.count_if(~F.col("mask")).alias("padding"), r6(F.sum(F.col("flat")[0] * (F.col("t") + 1))).alias("weighted"))


def smoothed_flex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.smoothed(glove(spark, sf_dir)).select("recording_id", "t", r6(F.col("flex")[0]).alias("x"))


def normalised_pads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = glove(spark, sf_dir).select("recording_id", "t", F.posexplode(F.arrays_zip("z", "r")).alias("pad", "p"))
    return rows.select("recording_id", "t", "pad", r6(S.clip(S.unit_z(F.col("p.z")))).alias("z"), S.unit_r(F.col("p.r")).alias("r"), S.bin_r(F.col("p.r")).alias("bin"))


def channel_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(frames.channel_ranges(glove(spark, sf_dir)))


def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.col("doc_id").alias("recording_id"))
    return features.top_labels(rows)


def exemplar_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.exemplar_frames(glove(spark, sf_dir), 78)
    return rows.groupBy("label").agg(F.count("*").alias("n"), r6(F.sum(F.col("flex")[0] * (F.col("t") + 1))).alias("weighted"))


def anchor_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = glove(spark, sf_dir)
    return rounded(features.anchor_distances(windows.sliding(rows, WIDTH), features.exemplars(rows, WIDTH), [1.0] * (1 + 2 * PADS)))


def wide_anchor_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.wide_distances(anchor_distances(spark, sf_dir), list(range(7)))


def label_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.encoded(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label")))
    return rows.select("doc_id", "label", F.col("class_id").cast("long").alias("class_id"))


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(prep.one_hot(F.col("label"), 10)).alias("pos", "hot"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.where("vec_id is not null and label is not null and size(embedding) = 64").where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x)))
    return rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("class_id"), F.col("embedding").cast("array<double>").alias("v"))


def scaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prep.split_by_remainder(vectors(spark, sf_dir), "id")
    out = prep.scaled(rows, prep.scaler(rows.where("not is_test"), "v"), "v")
    return out.select("id", "is_test", F.posexplode("v").alias("pos", "x")).select("id", "is_test", "pos", r6(F.col("x")).alias("x"))


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = prep.split_by_remainder(vectors(spark, sf_dir), "id")
    return rows.where("is_test"), rows.where("not is_test")


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.nearest(*parts(spark, sf_dir), 5))


def knn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.decided(neighbours.votes(neighbours.nearest(*parts(spark, sf_dir), 5))))


def knn_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(neighbours.decided(neighbours.votes(neighbours.nearest(*parts(spark, sf_dir), 5), weighted=True)))


def bayes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = parts(spark, sf_dir)
    return rounded(neighbours.decided(neighbours.softmax(neighbours.bayes_scores(test, neighbours.bayes_fit(train)))))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("predicted")).where("y is not null and predicted is not null")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.class_report(judged(spark, sf_dir)))


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(judged(spark, sf_dir))


def metric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.summary(judged(spark, sf_dir)))


def window_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session, window_id, probs of three classes, from event values: exact decimals, so that both engines agree."""
    rows = glove(spark, sf_dir).withColumn("a", F.bround(F.col("flex")[0] * 16) / 16)
    a = F.col("a")
    probs = F.when(F.col("t") % 12 < 8, F.array(a, (1 - a) / 2, (1 - a) / 2)).otherwise(F.array((1 - a) / 2, a, (1 - a) / 2))
    return rows.select(F.col("recording_id").alias("session"), F.col("t").alias("window_id"), probs.alias("probs"))


def debounced_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(debounce.debounced(window_probabilities(spark, sf_dir), threshold=0.5, size=4, cooldown=4, strict=True))


def debounced_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(debounce.debounced(window_probabilities(spark, sf_dir), threshold=0.5, size=3, cooldown=4, strict=False))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = glove(spark, sf_dir).select("recording_id", "label", "t", F.col("flex").alias("flat"))
    rows = windows.pad_or_truncate(flat, 78, 1)
    out = rows.groupBy("recording_id").agg(F.count_if("mask").cast("int").alias("real_len"), F.sort_array(F.collect_list(F.struct("t", "flat"))).alias("f"))
    return out.select("recording_id", "real_len", F.transform("f", lambda f: f.flat).alias("seq"))


def time_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = augment.time_warp(sequences(spark, sf_dir), 78, 1)
    return out.select("recording_id", "factor", F.col("real_len").cast("long").alias("n"), r6(S.total(F.transform("seq", lambda f, i: f[0] * i))).alias("weighted"))


def temporal_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = augment.temporal_shift(sequences(spark, sf_dir), 78, 1)
    return out.select("recording_id", F.col("shift").cast("long").alias("shift"), F.col("real_len").cast("long").alias("n"), r6(S.total(F.transform("seq", lambda f, i: f[0] * i))).alias("weighted"))


def augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies by place: what a value counts depends on where it came to stand."""
    place = lambda seq: np.cumsum(seq[:, :, 0] * np.arange(1, 79), axis=1)[:, -1]
    out = augment.augmented(sequences(spark, sf_dir), 78, 1, 1, of=place)
    return out.groupBy("recording_id", "repeat").agg(F.count("*").alias("copies"), F.sum("real_len").alias("real"), r6(F.sum("value")).alias("weighted"), F.min("path").alias("first_path"))


def bayes_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    test, train = parts(spark, sf_dir)
    return neighbours.softmax(neighbours.bayes_scores(test, neighbours.bayes_fit(train)))


def ranked_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.ranked(bayes_probabilities(spark, sf_dir)).where("rank <= 3"))


def decoded_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("label"))
    return inference.decoded(prep.encoded(rows).select("doc_id", "class_id"), prep.label_codes(rows)).select("doc_id", "label", F.col("class_id").cast("long").alias("class_id"))


def emission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inference.summary(debounce.debounced(window_probabilities(spark, sf_dir), threshold=0.5, size=4, cooldown=4, strict=True)))


def split_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").where("source is not null").select(F.col("doc_id").alias("recording_id"), F.col("source").alias("label"))
    return prep.three_way(rows).select("recording_id", "label", "part")


def recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the windows of four recordings in five, and run over the others, from frames to debounced labels."""
    rows = glove(spark, sf_dir)
    fitted = inference.fit(inference.window_vectors(rows.where("recording_id % 5 != 0"), WIDTH))
    out = inference.recognised(rows.where("recording_id % 5 = 0"), fitted, WIDTH, threshold=0.16, size=2, cooldown=2, strict=True)
    return rounded(out)


def recognised_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a stream gives it: smoothed frames, full windows only."""
    rows = glove(spark, sf_dir)
    fitted = inference.fit(inference.window_vectors(rows.where("recording_id % 5 != 0"), WIDTH, cut="full", smooth=True))
    return rounded(inference.recognised(rows.where("recording_id % 5 = 0"), fitted, WIDTH, cut="full", smooth=True, threshold=0.2, size=2, cooldown=2, strict=True))


def recognised_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows to the end of a recording, right-aligned, of normalised channels; gated windows end there."""
    rows = glove(spark, sf_dir)
    fitted = inference.fit(inference.window_vectors(rows.where("recording_id % 5 != 0"), WIDTH, cut="aligned", smooth=True))
    return rounded(inference.recognised(rows.where("recording_id % 5 = 0"), fitted, WIDTH, cut="aligned", smooth=True, threshold=0.9, size=3, cooldown=2, strict=False))


def warped_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest training windows by warping distance of the flex channel plus distance of the pads' values."""
    rows = features.raw_table(windows.full_windows(glove(spark, sf_dir), WIDTH, WIDTH))
    rows = rows.select((F.col("recording_id") * 1000 + F.col("start")).alias("id"), F.col("label").cast("long").alias("class_id"), F.col("vector").alias("v"), "recording_id")
    return rounded(neighbours.nearest_warped(rows.where("recording_id % 5 = 0"), rows.where("recording_id % 5 != 0"), 5, [WIDTH]))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plateaus of a series per recording, as if its values were an epoch's losses."""
    log = glove(spark, sf_dir).select(F.col("recording_id").alias("run"), F.col("t").alias("epoch"), F.col("flex")[0].alias("val_loss"))
    return metrics.schedule(log)


def knn_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warped neighbours with distance weights, from frames to debounced labels: windows of 40 frames one after the other."""
    rows = features.raw_table(windows.full_windows(glove(spark, sf_dir), WIDTH, WIDTH))
    number = (F.col("start") / WIDTH).cast("int")
    rows = rows.select((F.col("recording_id") * 1000 + F.col("start")).alias("id"), "recording_id", "label", number.alias("window_id"), F.col("vector").alias("v"))
    rows = stored(rows, "windows")  # every step of the fit reads them
    fitted = inference.fit(rows.where("recording_id % 5 != 0"), inference.by_neighbours(5, [WIDTH]))
    return rounded(inference.emitted(rows.where("recording_id % 5 = 0"), fitted, threshold=0.2, size=1, cooldown=1, strict=True))


def kernel_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel machines of the training vectors on the others."""
    test, train = parts(spark, sf_dir)
    return rounded(neighbours.decided(svm.fit(train).probabilities(test)))


def boosted_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosted trees of the training vectors on the others."""
    test, train = parts(spark, sf_dir)
    return rounded(neighbours.decided(boosting.fit(train, rounds=5, depth=3, rate=0.3).probabilities(test)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        window_features, quantile_window_features, trend_changes, raw_vectors, stream_windows, aligned_windows, padded, smoothed_flex, normalised_pads,
        channel_ranges, top_labels, exemplar_sizes, anchor_distances, wide_anchor_distances, label_codes, one_hot, scaled_vectors, knn_neighbours, knn_predictions,
        knn_weighted, bayes_predictions, class_report, confusion, metric_summary, debounced_mean, debounced_gate, time_warp, temporal_shift, augmented,
        ranked_probabilities, decoded_labels, emission_summary, split_parts, recognised, recognised_smooth, recognised_aligned, warped_neighbours, learning_rates, knn_recognised, kernel_predictions, boosted_predictions,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from .oracle import SQL

    return dict(SQL)
