"""Recognition from a stream of frames against recognition of whole recordings."""

import time

import numpy as np
import pytest

from kinewave.operators import inference
from kinewave.streaming.recognise import recognised_stream

SCHEMA = "recording_id long, label string, t int, flex array<double>, z array<int>, r array<int>"
LENGTHS = {1: 75, 2: 20, 3: 21, 4: 50, 5: 7, 6: 1, 7: 19, 8: 60}


def recorded(ids, seed=5):
    rng, rows = np.random.default_rng(seed), []
    for i in ids:
        level = (i % 2) * 0.5
        for t in range(LENGTHS[i]):
            rows.append((i, "ab"[i % 2], t, [float(level + rng.random() * 0.4), float(rng.random())], [int(x) for x in rng.integers(-1, 5, 2)], [int(x) for x in rng.integers(0, 1200, 2)]))
    return rows


@pytest.fixture(scope="module")
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def near(got, want):
    got, want = (sorted((r.session, r.window_id, r.label, round(r.confidence, 6)) for r in rows) for rows in (got, want))
    return got == want and len(got) > 3


@pytest.mark.parametrize(("cut", "smooth", "strict", "batches"), [("sliding", True, True, 4), ("sliding", False, False, 2), ("full", True, True, 3), ("aligned", True, False, 3)])
def test_stream_equals_whole_recordings(spark, store, tmp_path, cut, smooth, strict, batches):
    """Frames are dealt to micro-batches at random, out of order and some twice."""
    rows = recorded(LENGTHS)
    frames = spark.createDataFrame(rows, SCHEMA)
    fitted = inference.fit(inference.window_vectors(frames, 20, 2, 2, cut, smooth))
    settings = {"threshold": 0.5, "size": 2, "cooldown": 2, "strict": strict}
    want = inference.recognised(frames, fitted, 20, 2, 2, cut, smooth, **settings).collect()
    ends = [(i, None, n, None, None, None) for i, n in LENGTHS.items()]
    rng = np.random.default_rng(batches)
    dealt = [[] for _ in range(batches)]
    for r in [*rows, *ends, *rows[::9]]:
        dealt[min(batches - 1, max(0, int(r[2] * batches / 60 + rng.normal(0, 0.7))))].append(r)
    for part in dealt:
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    stream = recognised_stream(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), fitted, 20, cut, smooth, **settings)
    query = stream.writeStream.format("memory").queryName(f"said_{cut}_{strict}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    assert near(spark.table(f"said_{cut}_{strict}").collect(), want)


def test_idle_recordings_end_by_timer(spark, store, tmp_path):
    rows = recorded([1, 2, 3, 4, 5, 7, 8])
    frames = spark.createDataFrame(rows, SCHEMA)
    fitted = inference.fit(inference.window_vectors(frames, 20, 2, 2))
    settings = {"threshold": 0.5, "size": 2, "cooldown": 2, "strict": True}
    want = inference.recognised(frames, fitted, 20, 2, 2, **settings).collect()
    frames.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = recognised_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), fitted, 20, idle=1500, **settings)
    query = stream.writeStream.format("memory").queryName("idle").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and not near(spark.table("idle").collect(), want):
            time.sleep(1)
        assert near(spark.table("idle").collect(), want)
    finally:
        query.stop()


def test_neighbours_recognise_end_to_end(spark):
    """By warping and weighted votes, against the same steps one by one."""
    from pyspark.sql import functions as F

    from kinewave.operators import debounce, neighbours, prep

    frames = spark.createDataFrame(recorded(LENGTHS), SCHEMA)
    vectors = inference.window_vectors(frames, 20, 2, 2, "full")
    fitted = inference.fit(vectors, inference.by_neighbours(3, [6, 6]))
    settings = {"threshold": 0.5, "size": 1, "cooldown": 1, "strict": True}
    got = inference.recognised(frames, fitted, 20, 2, 2, "full", **settings).collect()
    scaled = prep.scaled(prep.encoded(vectors), fitted.scaler, "v")
    probs = neighbours.votes(neighbours.nearest_warped(scaled, scaled, 3, [6, 6]), True).groupBy("id").pivot("class_id", [0, 1]).agg(F.first("prob")).fillna(0.0)
    rows = vectors.join(probs, "id").select(F.col("recording_id").alias("session"), "window_id", F.array("0", "1").alias("probs"))
    want = debounce.debounced(rows, **settings).withColumn("label", F.when(F.col("class_id") == 0, "a").otherwise("b")).collect()
    assert near(got, want)
