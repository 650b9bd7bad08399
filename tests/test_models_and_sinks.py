"""Searches over model parameters, forests and balanced ensembles; tables written and read back."""

import numpy as np
import pytest
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from kinewave.operators import inference, models, neighbours, prep
from kinewave.sources import files


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, i % 3, (rng.normal(0, 0.3, 2) + [i % 3, -(i % 3)]).tolist()) for i in range(90)]
    return spark.createDataFrame(data, "id long, class_id long, v array<double>").repartition(2).cache()


def right(said, rows):
    return said.join(rows.withColumnRenamed("class_id", "own"), "id").where("predicted = own").count()


def test_grid_search_finds_the_better_depth(rows):
    forest = models.forest(trees=5, depth=1)
    grid = ParamGridBuilder().addGrid(forest.maxDepth, [0, 3]).build()
    found = models.grid_search(models.vectors(rows), forest, grid, k=2)
    scores = found.avgMetrics
    assert len(scores) == 2 and scores[1] > scores[0] and scores[1] > 0.8


def test_forest_and_boosted_trees(rows):
    some = models.vectors(rows)
    grown = models.forest(trees=5, depth=3).fit(some)
    assert right(neighbours.decided(models.probabilities(grown.transform(some))), rows) > 80
    told = models.importances(grown, ["x", "y"], rows.sparkSession).collect()
    assert {r.feature for r in told} == {"x", "y"} and sum(r.importance for r in told) == pytest.approx(1)
    boosted = models.boosted_trees(rounds=3, depth=2).fit(some).transform(some)
    assert boosted.where("prediction = class_id").count() > 80 if "class_id" in boosted.columns else boosted.count() == 90


def test_balanced_ensembles(rows):
    uneven = rows.where("class_id > 0 or id < 30")
    for thin in (models.undersampled, models.smote):
        some = models.bagged(uneven, models.forest(trees=3, depth=3), samples=2, thin=thin)
        assert len(some) == 2 and right(neighbours.decided(models.ensemble_votes(rows, some)), rows) > 75
    some = models.adaboost(uneven, 3, rounds=3, depth=2, balanced=True)
    assert right(neighbours.decided(models.ensemble_votes(rows, some)), rows) > 75


def test_ranked_and_decoded(spark):
    shares = spark.createDataFrame([(1, 0, 0.2), (1, 1, 0.4), (1, 2, 0.4), (2, 0, 1.0)], "id long, class_id long, prob double")
    assert [tuple(r) for r in inference.ranked(shares).orderBy("id", "rank").collect()] == [(1, 1, 1, 0.4), (1, 2, 2, 0.4), (1, 3, 0, 0.2), (2, 1, 0, 1.0)]
    codes = prep.label_codes(spark.createDataFrame([("b",), ("a",)], "label string"))
    got = inference.decoded(spark.createDataFrame([(0,), (1,), (7,)], "class_id int"), codes).collect()
    assert {(r.class_id, r.label) for r in got} == {(0, "a"), (1, "b"), (7, None)}


def test_recognition_of_plain_gestures(spark):
    """Two labels of unlike flex values are told apart from frames to emissions."""
    frames = [(i, i % 2, t, [0.8 * (i % 2) + 0.01 * (t % 7)], [-1, 2 * (i % 2)], [0, 5]) for i in range(8) for t in range(60)]
    rows = spark.createDataFrame(frames, "recording_id long, label int, t int, flex array<double>, z array<int>, r array<int>")
    fitted = inference.fit(inference.window_vectors(rows.where("recording_id < 6"), 20, 1, 2))
    got = inference.recognised(rows.where("recording_id >= 6"), fitted, 20, 1, 2, threshold=0.6, size=2, cooldown=2, strict=True).collect()
    assert {(r.session, r.label) for r in got} == {(6, 0), (7, 1)} and all(r.confidence > 0.6 for r in got)


def test_tables_are_read_back(spark, tmp_path):
    gold = spark.createDataFrame([("a", [[1.0, 2.0], [3.0, 4.5]])], "label string, gold array<array<double>>")
    files.exemplar_json(gold, str(tmp_path / "gold"))
    assert files.read_exemplars(spark, str(tmp_path / "gold")).collect() == gold.collect()
    own = spark.createDataFrame([(1, "train", [0.5]), (2, "test", [0.25])], "recording_id long, part string, seq array<double>")
    files.write_tensors(own, str(tmp_path / "tensors"))
    back = spark.read.parquet(str(tmp_path / "tensors"))
    assert {(r.recording_id, r.part, tuple(r.seq)) for r in back.collect()} == {(1, "train", (0.5,)), (2, "test", (0.25,))}
    table = spark.createDataFrame([(1, "[0.5 1.]")], "id int, values string")
    assert files.with_arrays(table, ["values"]).first()["values"] == [0.5, 1.0]
    meta = files.metadata(spark, labels=["a", "b"], width=40).first().asDict()
    assert meta == {"labels": '["a", "b"]', "width": "40"}
    assert files.training_log(spark, "").count() == 0
    assert own.select(F.max("recording_id")).first()[0] == 2
