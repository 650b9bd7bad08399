"""Sources and sinks: session files, frame streams, feature tables, exemplars, class lists, metadata, logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinewave.functions.scalars import parse_array

FRAME = "struct<flex:map<string,struct<curl:double>>,pads:array<struct<n:string,z:int,r:int>>>"
RECORDING = f"struct<label:string,frames:array<{FRAME}>>"
LOG = "epoch int, accuracy double, learning_rate double, loss double, val_accuracy double, val_loss double"


def session_files(spark: SparkSession, folder: str) -> DataFrame:
    """recording_id, file, place, label, frames of all *.json files of a folder: a list of recordings, or one.

    Files that do not parse give no rows (see rejected_files). recording_id is by hash of file and place, so that reading
    needs no global order; (file, place) is the order in which recordings count as first.
    """
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")
    rows = text.select("file", F.posexplode(F.from_json("value", f"array<{RECORDING}>")).alias("place", "r")).where("r.frames is not null")
    return rows.select(F.xxhash64("file", "place").alias("recording_id"), "file", "place", "r.label", "r.frames")


def rejected_files(spark: SparkSession, folder: str) -> DataFrame:
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return text.where(F.from_json("value", f"array<{RECORDING}>").isNull()).select("file")


def frame_stream(spark: SparkSession, path: str) -> DataFrame:
    """t, frame of a file with a list of frames, or an object with the list in `frames`; an error if there are none."""
    text = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"struct<frames:array<{FRAME}>>")["frames"]
    listed = F.from_json("value", f"array<{FRAME}>")
    own = F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)
    held = F.when(F.size(F.coalesce(own, F.array())) == 0, F.raise_error(F.lit("no frames in the file"))).otherwise(own)
    return text.select(F.posexplode(held.cast(f"array<{FRAME}>")).alias("t", "frame"))


def write_recordings(rows: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8; read back by read_recordings."""
    rows.select("label", "frames").write.mode("overwrite").json(path)


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(T.StructType.fromDDL(f"label string, frames array<{FRAME}>")).json(path)


def read_features(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV with a header; with a schema if it is known, as inferring one reads the file twice."""
    reader = spark.read.option("header", True).option("multiLine", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def with_arrays(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Printed arrays of a CSV as arrays."""
    return rows.withColumns({c: parse_array(F.col(c)) for c in columns})


def write_tensors(rows: DataFrame, path: str) -> None:
    """Sequences, masks and class ids, a folder for each part of the split."""
    rows.write.mode("overwrite").partitionBy("part").parquet(path)


def read_tensors(spark: SparkSession, path: str, part: str | None = None) -> DataFrame:
    """What write_tensors() wrote; of one part, only its folder is read."""
    rows = spark.read.parquet(path)
    return rows if part is None else rows.where(F.col("part") == part).drop("part")


def exemplar_json(gold: DataFrame, path: str) -> None:
    """label and gold (2-D list), one object a line."""
    gold.select("label", "gold").write.mode("overwrite").json(path)


def read_exemplars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("label string, gold array<array<double>>").json(path)


def class_list(spark: SparkSession, path: str) -> DataFrame:
    """class_id, label of a JSON array of labels."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("class_id", "label"))


def write_class_list(codes: DataFrame, path: str) -> None:
    """A JSON array of labels in order of class_id; a row a class is gathered."""
    codes.agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("class_id", "label"))), lambda x: x.label)).alias("value")).write.mode("overwrite").text(path)


def metadata(spark: SparkSession, **values) -> DataFrame:
    """One row: each value as JSON."""
    return spark.createDataFrame([{k: json.dumps(v, ensure_ascii=False) for k, v in values.items()}])


def write_metadata(rows: DataFrame, path: str) -> None:
    """The row of metadata() as one line of JSON, values as they were."""
    rows.select(F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(json.dumps(c) + ": "), F.col(c)) for c in rows.columns]), F.lit("}")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def read_metadata(spark: SparkSession, path: str) -> dict:
    """Values by name; one small row comes to the driver."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG).option("header", True).option("enforceSchema", False).csv(path) if path else spark.createDataFrame([], LOG)


def append_run(rows: DataFrame, table: str) -> None:
    """Runs (run_id, name, kind, key, value) of an experiment table."""
    rows.select("run_id", "name", "kind", "key", "value").write.mode("append").saveAsTable(table)
