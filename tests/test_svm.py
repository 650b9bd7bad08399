"""Kernel machines against a plain solver, optimality conditions, and probabilities against a Newton fit in NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinewave.operators import svm


def points(seed, n=150, classes=3, dim=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1.2, (classes, dim))
    k = rng.integers(0, classes, n)
    return k, centres[k] + rng.normal(0, 0.9, (n, dim))


def plain(k, y, c):
    """Exhaustive sweeps over all pairs of dual variables, each pair to its optimum, until nothing moves."""
    n = len(y)
    alpha, moved = np.zeros(n), 1.0
    while moved > 1e-10:
        moved = 0.0
        for i in range(n):
            for j in range(i):
                f = (alpha * y) @ k
                bend = max(k[i, i] + k[j, j] - 2 * k[i, j], 1e-12)
                step = ((y[i] - f[i]) - (y[j] - f[j])) / bend
                low = max(-alpha[i] if y[i] > 0 else alpha[i] - c, alpha[j] - c if y[j] > 0 else -alpha[j])
                high = min(c - alpha[i] if y[i] > 0 else alpha[i], alpha[j] if y[j] > 0 else c - alpha[j])
                step = min(max(step, low), high)
                alpha[i] += y[i] * step
                alpha[j] -= y[j] * step
                moved = max(moved, abs(step))
    return alpha


@pytest.mark.parametrize("c", [0.5, 10.0])
def test_solver_against_exhaustive_sweeps(c):
    k, v = points(1, 40, 2)
    y, m = np.where(k == 0, 1.0, -1.0), svm.kernel(v, v, 0.3)
    alpha, bias = svm.solved(m, y, c, 1e-9)
    want = plain(m, y, c)
    assert abs(alpha @ y) < 1e-9 and np.allclose((alpha * y) @ m, (want * y) @ m, atol=1e-5)
    free = (want > 1e-6) & (want < c - 1e-6)
    assert bias == pytest.approx(np.mean((y - (want * y) @ m)[free]), abs=1e-4)


def test_cascade_reaches_the_optimum_over_all_rows(spark):
    """Many small shards, some of one class only: same decisions as one solve, and no row breaks the conditions."""
    k, v = points(2, 240, 3)
    frame = spark.createDataFrame([(i, int(c), x.tolist()) for i, (c, x) in enumerate(zip(k, v, strict=True))], "id long, class_id int, v array<double>").repartition(4)
    fitted = svm.fit(frame, 10.0, 0.2, folds=3, shard=16)
    for number, (a, b) in enumerate(svm.pairs_of(3)):
        some = (k == a) | (k == b)
        y, x = np.where(k[some] == a, 1.0, -1.0), v[some]
        alpha, bias = svm.solved(svm.kernel(x, x, 0.2), y, 10.0, 1e-7)
        want = svm.kernel(v, x, 0.2) @ (alpha * y) + bias
        got = fitted.machines.scores((-1, number), v)
        assert np.allclose(got, want, atol=2e-3)
        own = fitted.machines.scores((-1, number), x) * y
        assert (own >= 1 - 1e-3)[alpha < 1e-9].all()
    probs = fitted.probabilities(frame).groupBy("id").pivot("class_id", [0, 1, 2]).agg(F.first("prob")).orderBy("id").toPandas()[["0", "1", "2"]].to_numpy()
    assert np.allclose(probs.sum(axis=1), 1) and (probs.argmax(axis=1) == k).mean() > 0.75


def test_sigmoids_are_the_best_ones(spark):
    rng = np.random.default_rng(4)
    rows = [(p, int(y), float(y * (p + 1) + rng.normal(0, 2))) for p in range(2) for y in rng.choice([-1, 1], 200)]
    got = svm.sigmoids(spark.createDataFrame(rows, "pair int, y int, score double"))

    def loss(p, a, b):
        up, down = sum(r[0] == p and r[1] > 0 for r in rows), sum(r[0] == p and r[1] < 0 for r in rows)
        t = np.array([(up + 1) / (up + 2) if y > 0 else 1 / (down + 2) for q, y, _ in rows if q == p])
        z = a * np.array([s for q, _, s in rows if q == p]) + b
        return (np.logaddexp(0, -z) + t * z).sum()

    for p, (a, b) in got.items():
        assert a < 0 and all(loss(p, a, b) <= loss(p, a + da, b + db) + 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))


def test_coupling_gives_back_consistent_pairs():
    p = np.array([[0.5, 0.3, 0.2], [0.1, 0.1, 0.8]])
    r = p[:, :, None] / (p[:, :, None] + p[:, None, :])
    assert np.allclose(svm.coupled(r), p)


def test_one_class_and_missing_classes(spark):
    rows = spark.createDataFrame([(1, 0, [0.0]), (2, 0, [1.0])], "id long, class_id int, v array<double>")
    assert [r.prob for r in svm.fit(rows).probabilities(rows).collect()] == [1.0, 1.0]
    gap = spark.createDataFrame([(i, 2 * (i % 2), [float(i % 2) * 3 + i / 100]) for i in range(30)], "id long, class_id int, v array<double>")
    best = svm.fit(gap, gamma=1.0, folds=3).probabilities(gap).groupBy("id").agg(F.max_by("class_id", "prob").alias("k")).collect()
    assert all(r.k == 2 * (r.id % 2) for r in best)


def test_vectors_of_any_number(spark, monkeypatch):
    """Vectors in several shards and a strip of the kernel in a task: no error, and the scores of whole kernels."""
    monkeypatch.setattr(svm, "MOST_NUMBERS", 500)
    monkeypatch.setattr(svm, "LARGEST", 30, raising=False)
    k, v = points(5, 120, 3)
    y, held, alone = np.where(k == 0, 1.0, -1.0), np.arange(120) % 3, svm.kernel(v, v, 0.2)
    alphas, biases, whole = svm.solve_all(v, y, held, np.zeros((120, 4)), 10.0, 0.2)
    for f in range(-1, 3):
        own = held != f
        alpha, bias = svm.solved(alone[np.ix_(own, own)], y[own], 10.0)
        assert whole[f + 1] and np.allclose(alone @ (alphas[:, f + 1] * y) + biases[f + 1], alone[:, own] @ (alpha * y[own]) + bias, atol=1e-3)
    monkeypatch.setattr(svm, "BLOCK", 32)
    monkeypatch.setattr(svm, "VECTORS", 24)
    frame = spark.createDataFrame([(i % 100, int(c), x.tolist()) for i, (c, x) in enumerate(zip(k, v, strict=True))], "id long, class_id int, v array<double>")
    fitted = svm.fit(frame, 10.0, 0.2, folds=3, shard=16)
    rows = spark.createDataFrame([(7, x.tolist(), -1, i) for i, x in enumerate(v)], "id long, v array<double>, k int, row long")
    got = {(r.row, r.pair): r.s[0] + fitted.machines.biases[r.pair][0] for r in fitted.machines.scored(rows, False).collect()}
    for number in range(3):
        want = fitted.machines.scores((-1, number), v)
        assert np.allclose([got[i, number] for i in range(120)], want, atol=1e-9)
        a, b = svm.pairs_of(3)[number]
        some = (k == a) | (k == b)
        alpha, bias = svm.solved(svm.kernel(v[some], v[some], 0.2), np.where(k[some] == a, 1.0, -1.0), 10.0)
        assert np.allclose(want, svm.kernel(v, v[some], 0.2) @ (alpha * np.where(k[some] == a, 1.0, -1.0)) + bias, atol=2e-3)
    assert fitted.probabilities(rows).count() == 360
