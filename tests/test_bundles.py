"""Saved models, label codes of many labels, learning-rate schedules, tensors and metadata."""

import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from kinewave.operators import inference, metrics, prep
from kinewave.sources import files

SF = "/root/testdata/sf0.001"


def test_saved_model_recognises_in_a_new_session(spark, tmp_path):
    """Fitted, written, and read by another process: same emissions; a half-written version is never read."""
    from kinewave.operators import frames

    rows = frames.from_events(spark.read.parquet(f"{SF}/events.parquet"))
    fitted = inference.fit(inference.window_vectors(rows, 20, cut="full"))
    settings = {"width": 20, "cut": "full", "threshold": 0.2, "size": 2, "cooldown": 2, "strict": True}
    want = sorted(f"{r.session} {r.window_id} {r.label} {r.confidence:.6f}" for r in inference.recognised(rows, fitted, **settings).collect())
    path = str(tmp_path / "model")
    assert inference.save(fitted, path, width=1) == 1 and inference.save(fitted, path, **settings) == 2
    fitted.codes.write.parquet(f"{path}/half/codes")
    code = f"""
from pyspark.sql import SparkSession
from kinewave.operators import frames, inference
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
fitted, settings = inference.load(spark, {path!r})
rows = frames.from_events(spark.read.parquet("{SF}/events.parquet"))
for r in inference.recognised(rows, fitted, **settings).collect():
    print("found", r.session, r.window_id, r.label, f"{{r.confidence:.6f}}")
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=240, cwd=str(__import__("pathlib").Path(__file__).parent.parent)).stdout
    assert sorted(x[6:] for x in said.splitlines() if x.startswith("found ")) == want and want
    assert inference.load(spark, path, 1)[1] == {"width": 1}
    for bad in ((path, 3), (str(tmp_path / "none"), None)):
        with pytest.raises(ValueError, match="version"):
            inference.load(spark, *bad)


def test_codes_of_many_labels(spark):
    rows = spark.range(5000).select(F.concat(F.lit("l"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("label")).union(spark.range(2).select(F.lit(None).cast("string")))
    plain, many = prep.label_codes(rows), prep.label_codes(rows, most=10)
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, plain.collect())) and plain.count() > 3000
    assert many.dtypes == plain.dtypes and "collect_list" not in many._jdf.queryExecution().toString()


def test_schedule_of_runs(spark):
    """Halved after five epochs, stopped after ten; a small gain resets one counter only; nulls are no gain."""
    runs = {1: [6.7] + [7.0] * 12, 2: [3.0, 2.0, 1.99995, 1.9999, 1.99985, 1.9998, 1.99975, 1.9997], 3: [1.0, None, None, 0.5] + [0.6] * 5 + [0.4]}
    log = spark.createDataFrame([(k, e, v) for k, x in runs.items() for e, v in enumerate(x)], "run int, epoch int, val_loss double").repartition(3)
    got = {k: [(r.learning_rate, r.trained) for r in sorted((r for r in metrics.schedule(log).collect() if r.run == k), key=lambda r: r.epoch)] for k in runs}
    assert [rate for rate, _ in got[1]] == [1e-3] * 6 + [5e-4] * 5 + [2.5e-4] * 2 and [t for _, t in got[1]] == [True] * 11 + [False] * 2
    assert [rate for rate, _ in got[2]] == [1e-3] * 8 and all(t for _, t in got[2])
    assert [rate for rate, _ in got[3]] == [1e-3] * 9 + [5e-4]
    assert metrics.schedule(log, least=8e-4).agg(F.min("learning_rate")).first()[0] == 8e-4
    assert metrics.schedule(log.where("false")).collect() == []


def test_tensors_and_metadata_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", [[0.5]], [True], 0), (2, "test", [[0.25]], [False], 1)], "recording_id long, part string, seq array<array<double>>, mask array<boolean>, class_id int")
    files.write_tensors(rows, str(tmp_path / "t"))
    assert sorted(map(tuple, files.read_tensors(spark, str(tmp_path / "t")).select(*rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert [r.recording_id for r in files.read_tensors(spark, str(tmp_path / "t"), "test").collect()] == [2]
    values = {"W": 40, "class_labels": ["من", 'a"b'], "augmentation_params": {"time_warp_range": [0.7, 1.3]}}
    files.write_metadata(files.metadata(spark, **values), str(tmp_path / "m"))
    assert files.read_metadata(spark, str(tmp_path / "m")) == values
