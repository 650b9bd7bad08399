"""Classifiers on feature vectors by Spark's own learners, balanced ensembles around them, and grid search over folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest_within


def vectors(rows: DataFrame, column: str = "v") -> DataFrame:
    return rows.withColumn("features", array_to_vector(column)).withColumn("label", F.col("class_id").cast("double"))


def logistic(n: int, c: float = 1.0) -> LogisticRegression:
    """L2 with strength 1 / (c n), as the reference's solver counts it."""
    return LogisticRegression(family="multinomial", elasticNetParam=0.0, regParam=1 / (c * max(1, n)), maxIter=200, standardization=False)


def forest(trees: int = 100, depth: int = 10, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed)


def boosted_trees(rounds: int = 50, depth: int = 4, seed: int = 42) -> OneVsRest:
    """Stands for the gradient-boosted library that is not installed."""
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed))


def linear_svm(c: float = 1.0, n: int = 1) -> OneVsRest:
    return OneVsRest(classifier=LinearSVC(regParam=1 / (c * max(1, n))))


def random_features(rows: DataFrame, dim: int, gamma: float, count: int = 256, seed: int = 42) -> DataFrame:
    """Random Fourier features of the RBF kernel, so that a linear machine stands for the kernel one (approximate)."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, (2 * gamma) ** 0.5, (count, dim)), rng.uniform(0, 2 * np.pi, count)
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in w])
    shifts = F.array(*[F.lit(float(x)) for x in b])
    dot = lambda row: F.aggregate(F.zip_with("v", row, lambda x, y: x * y), F.lit(0.0), lambda p, q: p + q)
    return rows.withColumn("v", F.zip_with(F.transform(weights, dot), shifts, lambda d, s: F.cos(d + s) * (2.0 / count) ** 0.5))


def folds(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(k)).cast("int"))


def grid_search(rows: DataFrame, estimator: Estimator, grid: list, k: int = 5):
    """The model of the best mean accuracy over k folds; rows: id, features, label."""
    judge = MulticlassClassificationEvaluator(metricName="accuracy")
    return CrossValidator(estimator=estimator, estimatorParamMaps=grid, evaluator=judge, foldCol="fold", numFolds=k, parallelism=2).fit(folds(rows, k))


def undersampled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Classes thinned to about the size of the smallest, by hash of id; this is the operator's purpose."""
    counts = rows.groupBy("class_id").count()
    least = counts.agg(F.min("count")).first()[0] or 0
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) / 1_000_003.0
    return rows.join(F.broadcast(counts.withColumnRenamed("count", "_n")), "class_id").where(u < F.lit(float(least)) / F.col("_n")).drop("_n")


def smote(rows: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """rows (id, class_id, v) and, for each smaller class, points between a row and one of its k nearest of the class.

    Each row of a class gets as many points as bring the class to about the largest one's size; new rows have a null id, and
    classes of one row stay as they are. Neighbours of all classes are found in one pass, and one plan makes all points; a
    count per class comes to the driver.
    """
    counts = {r["class_id"]: r["count"] for r in rows.groupBy("class_id").count().collect()}
    most = max(counts.values(), default=0)
    small = {c: (most - n) / n for c, n in counts.items() if 1 < n < most}
    if not small:
        return rows
    wanted = F.create_map(*[F.lit(x) for pair in small.items() for x in pair])[F.col("class_id")]
    own = rows.where(F.col("class_id").isin(list(small)))
    near = nearest_within(own, k + 1).where(F.col("id") != F.col("neighbour")).where(F.col("rank") <= k + 1)
    draw = lambda s, *x: F.pmod(F.xxhash64(F.lit(seed + s), *x), F.lit(1 << 30)) / float(1 << 30)
    copies = own.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor(wanted + draw(0, "id")).cast("int")))).where("copy > 0")
    choice = near.groupBy("id").agg(F.sort_array(F.collect_list("neighbour")).alias("around"))
    chosen = copies.join(choice, "id").withColumn("neighbour", F.get("around", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "copy"), F.size("around")).cast("int")))
    other = own.select(F.col("id").alias("neighbour"), F.col("v").alias("w"))
    made = chosen.join(other, "neighbour").withColumn("u", draw(2, "id", "copy")).select(F.lit(None).cast("long").alias("id"), "class_id", F.zip_with("v", "w", lambda a, b: a + (b - a) * F.col("u")).alias("v"))
    return rows.unionByName(made)


def adaboost(rows: DataFrame, classes: int, rounds: int = 10, depth: int = 1, balanced: bool = False, seed: int = 42) -> list:
    """(weight, model) of each round by the multi-class exponential loss; `balanced` thins the classes in each round."""
    now, models = vectors(rows).withColumn("weight", F.lit(1.0)), []
    for k in range(rounds):
        some = undersampled(now, seed + k) if balanced else now
        model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=seed + k).fit(some)
        scored = model.transform(now).select("id", "class_id", "v", "features", "label", "weight", "prediction")
        wrong, total = scored.agg(F.sum(F.when(F.col("prediction") != F.col("label"), F.col("weight")).otherwise(0.0)), F.sum("weight")).first()
        error = (wrong or 0.0) / (total or 1.0)
        if error >= 1 - 1 / classes:
            break
        alpha = math.log((1 - max(error, 1e-10)) / max(error, 1e-10)) + math.log(max(1, classes - 1))
        models.append((alpha, model))
        if error == 0:
            break
        now = scored.withColumn("weight", F.col("weight") * F.when(F.col("prediction") != F.col("label"), math.exp(min(alpha, 30.0))).otherwise(1.0)).drop("prediction")
    return models


def bagged(rows: DataFrame, estimator, samples: int = 10, thin=undersampled, seed: int = 42) -> list:
    """(1, model) of each sample: rows thinned or grown by `thin` before each fit (balanced forest, balanced bagging)."""
    return [(1.0, estimator.fit(vectors(thin(rows, seed=seed + k)))) for k in range(samples)]


def ensemble_votes(rows: DataFrame, models: list) -> DataFrame:
    """id, class_id, prob: shares of the weighted votes; all models score a row in one pass over the table."""
    total, out = sum(w for w, _ in models), vectors(rows)
    for k, (_, model) in enumerate(models):
        names = {"predictionCol": f"_said{k}", "rawPredictionCol": f"_raw{k}", "probabilityCol": f"_prob{k}"}
        out = model.copy({model.getParam(n): v for n, v in names.items() if model.hasParam(n)}).transform(out)
    said = F.array(*[F.struct(F.col(f"_said{k}").cast("long").alias("class_id"), F.lit(w / total).alias("w")) for k, (w, _) in enumerate(models)])
    return out.select("id", F.explode(said).alias("x")).groupBy("id", "x.class_id").agg(F.sum("x.w").alias("prob"))


def probabilities(scored: DataFrame) -> DataFrame:
    """id, class_id, prob of a transformed table of a model that gives probabilities."""
    return scored.select("id", F.posexplode(vector_to_array("probability")).alias("class_id", "prob"))


def importances(model, names: list[str], spark) -> DataFrame:
    values = model.featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(names, values, strict=True)), "feature string, importance double").orderBy(F.desc("importance"), "feature")


def model_slot(rows: DataFrame, load, column: str = "v") -> DataFrame:
    """id, probs: load() gives a function from a list of inputs to a list of probability lists; it runs once a task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "probs": model(f[column].tolist())})

    return rows.select("id", column).mapInPandas(run, "id long, probs array<double>")
