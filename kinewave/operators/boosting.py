"""Gradient boosted trees for several classes: quantile bins, softmax loss, histograms of gradients summed by Spark.

All classes' trees of a round grow together, a level at a time: tasks add gradients and hessians up by (class, node, feature,
bin), one shuffle sums those, and the best split of each node is found by prefix sums over its bins. Trees are small and
come to the driver; rows stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

#: Splits that gain less than this share no loss worth a node.
LEAST_GAIN = 1e-9
SUMS = "class_id int, node int, feature int, bin int, g double, h double"


@dataclass
class Tree:
    """Splits by node (children of n are 2n + 1 and 2n + 2): feature and the last bin that goes left; values of leaves."""

    splits: dict = field(default_factory=dict)
    values: dict = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each row of bins has reached."""
        at = np.zeros(len(bins), np.int64)
        for n in sorted(self.splits):
            feature, last = self.splits[n]
            own = at == n
            at[own] = 2 * n + 1 + (bins[own, feature] > last)
        return at

    def scores(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        known = np.zeros(max(2 * max(self.splits, default=0) + 3, 1))
        for n, value in self.values.items():
            known[n] = value
        return known[at]


def cuts_of(rows: DataFrame, bins: int, accuracy: int = 10_000) -> list[np.ndarray]:
    """Ascending cuts of each feature at approximate quantiles: a row per feature comes to the driver."""
    shares = [i / bins for i in range(1, bins)]
    found = rows.select(F.posexplode("v").alias("feature", "x")).groupBy("feature").agg(F.percentile_approx("x", shares, accuracy).alias("cuts")).orderBy("feature").collect()
    return [np.unique(np.array(r.cuts, float)) for r in found]


def binned(v: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bins of rows: how many cuts lie below a value; a value equal to a cut belongs below it."""
    return np.stack([np.searchsorted(c, v[:, i], side="left") for i, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(v), 0), int)


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margins: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = softmax(margins)
    return p - (classes[:, None] == np.arange(margins.shape[1])), p * (1 - p)


def batch_of(batch: pa.RecordBatch, features: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch["bins"].to_pylist()), np.uint8).reshape(n, features)
    margins = np.frombuffer(b"".join(batch["margins"].to_pylist()), np.float64).reshape(n, classes)
    return bins, margins, batch["class_id"].to_numpy(zero_copy_only=False)


def histograms(rows: DataFrame, trees: list[Tree], level: list[set[int]], bins: int, features: int) -> DataFrame:
    """SUMS of the rows in the nodes of this level, by task."""
    classes = len(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x, margins, y = batch_of(batch, features, classes)
            g, h = gradients(margins, y)
            place = x.astype(np.int64) + np.arange(features) * bins
            for k, tree in enumerate(trees):
                at = tree.nodes(x)
                for node in level[k]:
                    own = at == node
                    if own.any():
                        flat = place[own].ravel()
                        sums = [np.bincount(flat, np.repeat(w[own, k], features), features * bins) for w in (g, h)]
                        had = total.get((k, node))
                        total[k, node] = sums if had is None else [a + b for a, b in zip(had, sums, strict=True)]
        for (k, node), (g, h) in total.items():
            some = np.flatnonzero(h)
            fill = lambda v, n=len(some): pa.array(np.full(n, v, np.int32))
            yield pa.RecordBatch.from_arrays([fill(k), fill(node), pa.array((some // bins).astype(np.int32)), pa.array((some % bins).astype(np.int32)), pa.array(g[some]), pa.array(h[some])], names=["class_id", "node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, SUMS)


def best_splits(sums: DataFrame, shrink: float) -> DataFrame:
    """class_id, node, feature, bin, gain, and g, h of both sides of the best split of each node; ties to the smaller feature, then bin.

    Gains are compared to nine digits, so that the order of sums does not decide.
    """
    each = sums.groupBy("class_id", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    order, whole = Window.partitionBy("class_id", "node", "feature").orderBy("bin"), Window.partitionBy("class_id", "node", "feature")
    rows = each.select("class_id", "node", "feature", "bin", F.sum("g").over(order).alias("gl"), F.sum("h").over(order).alias("hl"), F.sum("g").over(whole).alias("ga"), F.sum("h").over(whole).alias("ha"))
    rows = rows.withColumn("gr", F.col("ga") - F.col("gl")).withColumn("hr", F.col("ha") - F.col("hl"))
    part = lambda g, h: F.col(g) * F.col(g) / (F.col(h) + shrink)
    gain = F.when(F.col("hr") > 1e-12, F.round(part("gl", "hl") + part("gr", "hr") - part("ga", "ha"), 9)).otherwise(0.0)
    best = F.max_by(F.struct("feature", "bin", "gl", "hl", "gr", "hr", "ga", "ha", "gain"), F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
    return rows.withColumn("gain", gain).groupBy("class_id", "node").agg(best.alias("x")).select("class_id", "node", "x.*")


@dataclass
class Boosted:
    """Trees of each round and class, the cuts of their bins and the first margins."""

    cuts: list
    start: np.ndarray
    rounds: list

    def margins(self, v: np.ndarray) -> np.ndarray:
        bins = binned(v, self.cuts)
        return self.start + sum((np.stack([t.scores(bins) for t in trees], axis=1) for trees in self.rounds), np.zeros((len(v), len(self.start))))

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """id, class_id, prob of rows (id, v), a row for each class."""
        return shares(rows, [self])


def shares(rows: DataFrame, models: list[Boosted]) -> DataFrame:
    """id, class_id, prob of rows (id, v): the mean of the models' probabilities, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = np.array(batch["v"].to_pylist(), float)
                p = np.mean([softmax(m.margins(v)) for m in models], axis=0)
                n, k = p.shape
                yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(np.repeat(np.arange(n), k))), pa.array(np.tile(np.arange(k), n)), pa.array(p.ravel())], names=["id", "class_id", "prob"])

    return rows.select("id", "v").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, class_id long, prob double")


@dataclass
class Bag:
    """Boosted trees of several samples, whose probabilities are averaged."""

    models: list

    def probabilities(self, rows: DataFrame) -> DataFrame:
        return shares(rows, self.models)


def bagged(rows: DataFrame, samples: int = 10, balance: Callable[..., DataFrame] | None = None, seed: int = 42, **settings) -> Bag:
    """fit() on each of several samples: rows drawn with replacement by hashes of their ids (a Poisson number of each),
    classes then evened out by `balance` (models.smote, models.undersampled or none). rows: id, class_id, v."""
    models = []
    for k in range(samples):
        u = F.pmod(F.xxhash64(F.lit(seed + k), "id"), F.lit(1 << 30)) / float(1 << 30)
        times = sum((F.when(u >= share, 1).otherwise(0) for share in np.cumsum(np.exp(-1.0) / np.array([1, 1, 2, 6, 24, 120])).tolist()), F.lit(0))
        drawn = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), times))).where("_copy > 0")
        drawn = drawn.withColumn("id", F.xxhash64("id", "_copy")).drop("_copy")
        models.append(fit(balance(drawn, seed=seed + k) if balance else drawn, **settings))
    return Bag(models)


def fit(rows: DataFrame, rounds: int = 50, depth: int = 4, rate: float = 0.1, shrink: float = 1.0, bins: int = 32, seen: Callable[[float], None] | None = None) -> Boosted:
    """Boosted trees of rows (id, class_id, v): class ids 0, 1, ..., vectors of one length without nulls; at most 256 bins.

    Margins start at the logs of the classes' shares (a class without rows counts as one). Each round fits a tree to each
    class by second-order gains with L2 strength `shrink`, and adds `rate` times its values. Rows without class are left out;
    without rows there is nothing to fit (an error). Bins and margins are written anew each round, which cuts the lineage.
    """
    own = rows.where("class_id is not null").select(F.col("class_id").cast("int").alias("class_id"), F.col("v").cast("array<double>").alias("v"))
    counts = {r.class_id: r["count"] for r in own.groupBy("class_id").count().collect()}
    if not counts:
        raise ValueError("there are no rows with a class")
    classes, total = max(counts) + 1, sum(counts.values())
    start = np.log(np.array([max(1, counts.get(k, 0)) for k in range(classes)]) / total)
    cuts = cuts_of(own, bins)
    features, model = len(cuts), Boosted(cuts, start, [])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = binned(np.array(batch["v"].to_pylist(), float), cuts).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch["class_id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([start.tobytes()] * len(x), pa.binary())], names=["class_id", "bins", "margins"])

    table = stored(own.mapInArrow(packed, "class_id int, bins binary, margins binary"), "boosted")
    for _ in range(rounds):
        trees, level = [Tree() for _ in range(classes)], [{0} for _ in range(classes)]
        for d in range(depth):
            found = best_splits(histograms(table, trees, level, bins, features), shrink).collect()
            if d == 0 and seen:
                seen(loss(table, features, classes))
            level = [set() for _ in range(classes)]
            for r in found:
                if r.gain > LEAST_GAIN:
                    trees[r.class_id].splits[r.node] = (r.feature, r.bin)
                    level[r.class_id] |= {2 * r.node + 1, 2 * r.node + 2}
                    for child, g, h in ((2 * r.node + 1, r.gl, r.hl), (2 * r.node + 2, r.gr, r.hr)):
                        trees[r.class_id].values[child] = -rate * g / (h + shrink)
                elif r.node == 0:
                    trees[r.class_id].values[0] = -rate * r.ga / (r.ha + shrink)
            if not any(level):
                break
        model.rounds.append(trees)
        table = stored(advanced(table, trees, features), "boosted")
    if seen:
        seen(loss(table, features, classes))
    return model


def advanced(table: DataFrame, trees: list[Tree], features: int) -> DataFrame:
    """Rows with the margins that a round's trees add to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, margins, _ = batch_of(batch, features, len(trees))
                now = margins + np.stack([t.scores(x) for t in trees], axis=1)
                yield pa.RecordBatch.from_arrays([batch["class_id"], batch["bins"], pa.array([m.tobytes() for m in now], pa.binary())], names=["class_id", "bins", "margins"])

    return table.mapInArrow(run, "class_id int, bins binary, margins binary")


def loss(table: DataFrame, features: int, classes: int) -> float:
    """Mean cross entropy at the table's margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, margins, y = batch_of(batch, features, classes)
                yield pa.RecordBatch.from_pydict({"s": [float(-np.log(softmax(margins)[np.arange(len(y)), y]).sum())], "n": [len(y)]})

    total, n = table.mapInArrow(run, "s double, n long").agg(F.sum("s"), F.sum("n")).first()
    return total / n


def by_boosting(**settings) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """A classifier for inference.fit()."""
    return lambda train: fit(train, **settings).probabilities
