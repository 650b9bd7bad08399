"""Boosted trees against the same algorithm in NumPy over whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinewave.operators import boosting


def table(spark, n=300, seed=3):
    rng = np.random.default_rng(seed)
    v = np.round(rng.normal(0, 1, (n, 4)), 2)
    k = (v[:, 0] > 0).astype(int) + ((v[:, 0] > 0) & (v[:, 1] * v[:, 2] > 0))
    k = np.where(rng.random(n) < 0.1, rng.integers(0, 3, n), k)
    return v, k, spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(k, v, strict=True))], "id long, class_id int, v array<double>").repartition(3)


def plain(v, k, cuts, rounds, depth, rate, shrink):
    """Margins after each round: trees grown node by node over all rows, every split of every feature tried."""
    n, classes = len(v), k.max() + 1
    margins = np.tile(np.log(np.bincount(k) / n), (n, 1))
    bins = np.stack([(v[:, [i]] > c).sum(axis=1) for i, c in enumerate(cuts)], axis=1)
    out = [margins]

    def grow(rows, g, h, d):
        add = np.zeros(n)
        value = -rate * g[rows].sum() / (h[rows].sum() + shrink)
        best = (1e-9, None)
        part = lambda r: g[r].sum() ** 2 / (h[r].sum() + shrink)
        for f in range(v.shape[1]) if d else ():
            for b in np.unique(bins[rows, f])[:-1]:
                left, right = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                gain = round(part(left) + part(right) - part(rows), 9)
                if gain > best[0]:
                    best = (gain, (left, right))
        if best[1] is None:
            add[rows] = value
            return add
        return grow(best[1][0], g, h, d - 1) + grow(best[1][1], g, h, d - 1)

    for _ in range(rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        margins = margins + np.stack([grow(np.arange(n), p[:, c] - (k == c), p[:, c] * (1 - p[:, c]), depth) for c in range(classes)], axis=1)
        out.append(margins)
    return out


def test_rounds_against_whole_arrays(spark):
    v, k, frame = table(spark)
    seen = []
    model = boosting.fit(frame, rounds=3, depth=3, rate=0.3, bins=8, seen=seen.append)
    want = plain(v, k, model.cuts, 3, 3, 0.3, 1.0)
    assert np.allclose(model.margins(v), want[-1], atol=1e-8)
    nll = [-np.mean(np.log((np.exp(m) / np.exp(m).sum(axis=1, keepdims=True))[np.arange(len(k)), k])) for m in want]
    assert seen == pytest.approx(nll, abs=1e-9) and all(a > b for a, b in zip(seen, seen[1:], strict=False))
    probs = model.probabilities(frame).groupBy("id").agg(F.max_by("class_id", "prob").alias("k"), F.sum("prob").alias("s")).orderBy("id").collect()
    assert all(abs(r.s - 1) < 1e-9 for r in probs) and np.mean([r.k == c for r, c in zip(probs, k, strict=True)]) > 0.7


def test_constant_features_and_single_class(spark):
    rows = spark.createDataFrame([(i, i % 2, [1.0, 2.0]) for i in range(10)], "id long, class_id int, v array<double>")
    model = boosting.fit(rows, rounds=1)
    assert np.allclose(boosting.softmax(model.margins(np.array([[1.0, 2.0]]))), 0.5)
    one = boosting.fit(rows.withColumn("class_id", F.lit(0)), rounds=1)
    assert [r.prob for r in one.probabilities(rows.limit(1)).collect()] == [1.0]
    with pytest.raises(ValueError, match="no rows"):
        boosting.fit(rows.where("false"))


def test_bags_of_evened_classes(spark):
    from kinewave.operators import models

    v, k, frame = table(spark, 150)
    some = frame.where("class_id <> 1 or id % 4 = 0")
    even = models.smote(some)
    counts = {r.class_id: r["count"] for r in even.groupBy("class_id").count().collect()}
    assert max(counts.values()) - min(counts.values()) <= 0.2 * max(counts.values())
    bag = boosting.bagged(some, samples=2, balance=models.smote, rounds=2, depth=2, bins=8, rate=0.5)
    got = bag.probabilities(frame).groupBy("id").agg(F.sum("prob").alias("s"), F.max_by("class_id", "prob").alias("k")).orderBy("id").collect()
    assert all(abs(r.s - 1) < 1e-9 for r in got) and np.mean([r.k == c for r, c in zip(got, k, strict=True)]) > 0.6
    want = np.mean([boosting.softmax(m.margins(v[:1])) for m in bag.models], axis=0)[0]
    assert np.allclose([r.prob for r in bag.probabilities(frame.where("id = 0")).orderBy("class_id").collect()], want)


def test_smote_lies_between_neighbours_of_a_class(spark):
    from kinewave.operators import models, neighbours

    _, _, frame = table(spark, 120)
    some = frame.where("class_id <> 1 or id % 3 = 0")
    near = neighbours.nearest_within(some, 6).collect()
    by = {r.id: (r.class_id, np.array(r.v)) for r in some.collect()}
    for i, (c, x) in by.items():
        mine = sorted((round(float(((x - y) ** 2).sum()), 9), j) for j, (d, y) in by.items() if d == c)[:6]
        assert [r.neighbour for r in sorted((r for r in near if r.id == i), key=lambda r: r.rank)] == [j for _, j in mine]
    for r in models.smote(some).where("id is null").collect():
        own = [y for c, y in by.values() if c == r.class_id]
        w = np.array(r.v)
        assert min(np.linalg.norm(w - a) + np.linalg.norm(w - b) - np.linalg.norm(a - b) for a in own for b in own) < 1e-9
