"""Support vector machines with the RBF kernel: one for each pair of classes, solved by shards and joined, with probabilities.

A pair's rows are solved in shards; support vectors of neighbouring shards are joined and solved again from where they stood,
up to one machine (a cascade). Then all rows are scored: those that break the optimum's conditions join the vectors, and the
machine is solved again, until none does; so the result is the optimum over all rows. The machines of all folds are solved
along with the one of all rows. Vectors stay in tables: rows are scored in blocks that meet packed shards of vectors, and a
task keeps some rows of a kernel only. Sigmoids are fitted to scores of held-out folds, and pairwise probabilities are coupled
to one distribution a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded_batches, discarded, matrix, stored

#: Rows of a shard of the cascade; numbers of a kernel that a task holds at once, and rows that one step of a solver may move.
SHARD, MOST_NUMBERS, MOVED = 1500, 4_000_000, 256
#: Rows of a block and of a shard of vectors that are scored together.
BLOCK, VECTORS = 1024, 8192
TOLERANCE, LEAST = 1e-4, 1e-9


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None]
    return np.exp(-gamma * np.maximum(d, 0))


def balanced(k: np.ndarray, y: np.ndarray, c: float, alpha: np.ndarray, slope: np.ndarray, tolerance: float) -> None:
    """Moves alpha and slope (that of the dual, over the rows of kernel matrix k) to the optimum: pairs of the steepest gain,
    until none breaks the conditions."""
    diagonal = np.diag(k)
    while True:
        f = -y * slope
        up, low = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
        if not up.any() or not low.any():
            return
        i = int(np.where(up, f, -np.inf).argmax())
        gap = f[i] - f
        if gap[low].max() <= tolerance:
            return
        bend = np.maximum(diagonal[i] + diagonal - 2 * k[i], 1e-12)
        j = int(np.where(low & (gap > 0), gap**2 / bend, -np.inf).argmax())
        room_i, room_j = (c - alpha[i] if y[i] > 0 else alpha[i]), (alpha[j] if y[j] > 0 else c - alpha[j])
        step = min(gap[j] / bend[j], room_i, room_j)
        alpha[i] += y[i] * step
        alpha[j] -= y[j] * step
        alpha[i], alpha[j] = (min(c, max(0.0, a)) for a in (alpha[i], alpha[j]))
        slope += y * step * (k[i] - k[j])


def bias_of(y: np.ndarray, c: float, alpha: np.ndarray, slope: np.ndarray) -> float:
    f = -y * slope
    up, low = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
    if not up.any() or not low.any():
        return float((f[up if up.any() else low]).mean()) if len(y) else 0.0
    free = (alpha > 1e-12 * c) & (alpha < c * (1 - 1e-12))
    return float(f[free].mean() if free.any() else (f[up].max() + f[low].min()) / 2)


def solved(k: np.ndarray, y: np.ndarray, c: float, tolerance: float = TOLERANCE / 10) -> tuple[np.ndarray, float]:
    """Dual variables and bias of the machine with kernel matrix k."""
    alpha, slope = np.zeros(len(y)), -np.ones(len(y))
    balanced(k, y, c, alpha, slope, tolerance)
    return alpha, bias_of(y, c, alpha, slope)


def slopes(v: np.ndarray, y: np.ndarray, alphas: np.ndarray, gamma: float) -> np.ndarray:
    """The dual's slope of each column of alphas, by strips of the kernel."""
    weights, strip = alphas * y[:, None], max(1, MOST_NUMBERS // max(len(y), 1))
    out = [y[i : i + strip, None] * (kernel(v[i : i + strip], v, gamma) @ weights) - 1 for i in range(0, len(y), strip)]
    return np.concatenate(out) if out else -np.ones(alphas.shape)


def solved_rows(v: np.ndarray, y: np.ndarray, c: float, gamma: float, alpha: np.ndarray, slope: np.ndarray, tolerance: float = TOLERANCE / 10) -> float:
    """As solved(), of rows v, from feasible alpha and its slope, which are moved to the optimum; gives the bias.

    The rows that break the conditions most are balanced against each other, again and again; only their rows of the kernel
    are computed, MOST_NUMBERS at a time.
    """
    half = int(np.clip(MOST_NUMBERS // max(len(y), 1), 2, MOVED)) // 2
    while True:
        f = -y * slope
        up, low = np.where(y > 0, alpha < c, alpha > 0), np.where(y > 0, alpha > 0, alpha < c)
        if not up.any() or not low.any() or (gap := f[up].max() - f[low].min()) <= tolerance:
            alpha[alpha < LEAST * c], alpha[alpha > (1 - LEAST) * c] = 0, c  # what rounding leaves; a free row would set the bias
            return bias_of(y, c, alpha, slope)
        ups, lows = np.flatnonzero(up), np.flatnonzero(low)
        if len(ups) > half:
            ups = ups[np.argpartition(-f[ups], half - 1)[:half]]
        if len(lows) > half:
            lows = lows[np.argpartition(f[lows], half - 1)[:half]]
        some = np.union1d(ups, lows)
        k, own, at = kernel(v[some], v, gamma), alpha[some], slope[some]
        balanced(np.ascontiguousarray(k[:, some]), y[some], c, own, at, max(tolerance, 0.1 * gap))
        slope += y * ((y[some] * (own - alpha[some])) @ k)
        alpha[some] = own


def feasible(alpha: np.ndarray, y: np.ndarray) -> np.ndarray:
    """alpha, the heavier side scaled down so that both sides have the same sum."""
    up, down = alpha[y > 0].sum(), alpha[y < 0].sum()
    return alpha * np.where(y > 0, min(1.0, down / up if up else 1.0), min(1.0, up / down if down else 1.0))


def solve_all(v: np.ndarray, y: np.ndarray, held: np.ndarray, start: np.ndarray, c: float, gamma: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """alphas (rows, folds + 1), biases, and whether both classes are there, of the machine of all rows and of each fold.

    The machine of all rows is solved first, from its start; one that starts at zero begins with what it has of that one.
    """
    alphas, folds = start.copy(), start.shape[1] - 1
    own = held[:, None] != np.arange(-1, folds)
    biases, whole = np.zeros(folds + 1), (own & (y > 0)[:, None]).any(axis=0) & (own & (y < 0)[:, None]).any(axis=0)
    alphas[~own | ~whole] = 0
    for some in (range(1), range(1, folds + 1)):
        for f in some:
            if whole[f]:
                alphas[own[:, f], f] = feasible(alphas[own[:, f], f if alphas[:, f].any() else 0], y[own[:, f]])
        at = slopes(v, y, alphas[:, some], gamma) if alphas[:, some].any() else -np.ones((len(y), len(some)))
        for f in some:
            if whole[f]:
                rows = own[:, f]
                alpha, slope = alphas[rows, f], at[rows, f - some[0]]
                biases[f] = solved_rows(v[rows], y[rows], c, gamma, alpha, slope)
                alphas[rows, f] = alpha
    return alphas, biases, whole


SOLVED = "pair int, shard long, row long, y int, held int, alphas array<double>"


def solve_shards(rows: DataFrame, c: float, gamma: float, folds: int, last: bool) -> DataFrame:
    """Rows of each (pair, shard) of rows (pair, shard, row, id, y, held, alphas, v) that support a machine of it; if it is not
    the last time, also the rows of a shard that has no machine, as one of its classes is elsewhere."""

    def solve(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")])
        y, held = (table[name].to_numpy() for name in ("y", "held"))
        alphas, _, whole = solve_all(matrix(table["v"]), y.astype(float), held, matrix(table["alphas"]), c, gamma)
        alone = ~whole if not last else np.zeros(folds + 1, bool)
        kept = (alphas > 0).any(axis=1) | (alone & (held[:, None] != np.arange(-1, folds))).any(axis=1)
        flat = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), folds + 1).cast(pa.list_(pa.float64()))
        own = table.filter(pa.array(kept)).select(["pair", "shard", "row", "y", "held"])
        return own.append_column("alphas", flat(alphas[kept]))

    return rows.select("pair", "shard", "row", "id", "y", "held", "alphas", "v").groupBy("pair", "shard").applyInArrow(solve, SOLVED)


def pairs_of(classes: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(classes) for b in range(a + 1, classes)]


def number_of(a: Column, b: Column, classes: int) -> Column:
    """The place of classes a < b in pairs_of()."""
    return (a * (2 * classes - a - 1) / 2 + b - a - 1).cast("int")


def with_pairs(own: DataFrame, classes: int) -> DataFrame:
    """own (k, ...), a row for each pair of classes that k is in, with pair and y: 1 for the lower class, else -1."""
    other = F.explode(F.array_remove(F.sequence(F.lit(0), F.lit(classes - 1)), F.col("k")))
    each = own.withColumn("other", other)
    return each.withColumn("pair", number_of(F.least("k", "other"), F.greatest("k", "other"), classes)).withColumn("y", F.when(F.col("k") < F.col("other"), 1).otherwise(-1)).drop("other")


@dataclass
class Machines:
    """Vectors (own: row, id, k, held, v) with their dual variables (now: pair, row, y, alphas, one a fold after that of all
    rows) in tables, and the biases of each pair: a row of them a pair is on the driver (0 where there is no machine)."""

    own: DataFrame
    now: DataFrame
    biases: dict
    gamma: float
    classes: int
    folds: int

    def scores(self, key: tuple[int, int], v: np.ndarray) -> np.ndarray:
        """Decision values of a few rows by the machine of (fold, pair), whose vectors come to the driver; 0 if it has none."""
        fold, pair = key
        if pair not in self.biases:
            return np.zeros(len(v))
        table = self.now.where(F.col("pair") == pair).select("row", (F.col("alphas")[fold + 1] * F.col("y")).alias("w")).where("w <> 0").join(self.own, "row").orderBy("row").select("w", "v").toArrow()
        if not table.num_rows:
            return np.zeros(len(v))
        return kernel(v, matrix(table["v"]), self.gamma) @ table["w"].to_numpy() + self.biases[pair][fold + 1]

    def packed(self) -> tuple[DataFrame, int]:
        """Shards of vectors: shard, n, v and k of each, and weights (n, classes, folds + 1): those of a row by the other class."""
        classes, width = self.classes, self.folds + 1
        count = self.now.select("row").distinct().count() // VECTORS + 1
        each = self.now.select("row", F.struct("pair", F.transform("alphas", lambda a: a * F.col("y")).alias("w")).alias("w")).groupBy("row").agg(F.collect_list("w").alias("w"))
        pairs = pairs_of(classes)

        def pack(table: pa.Table) -> pa.Table:
            table = table.sort_by("row")
            k, weights = table["k"].to_numpy(), np.zeros((table.num_rows, classes, width))
            lists = table["w"].combine_chunks()
            at, flat = np.repeat(np.arange(len(k)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten()
            a, b = np.array(pairs)[flat.field("pair").to_numpy()].T
            weights[at, a + b - k[at]] = flat.field("w").flatten().to_numpy().reshape(-1, width)
            return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "n": pa.array([len(k)], pa.int32()), "v": [matrix(table["v"]).tobytes()], "k": [k.astype(np.int32).tobytes()], "weights": [weights.tobytes()]})

        dealt = each.join(self.own.select("row", "k", "v"), "row").withColumn("shard", F.pmod(F.xxhash64(F.lit(2), "row"), F.lit(count)).cast("int"))
        return dealt.groupBy("shard").applyInArrow(pack, "shard int, n int, v binary, k binary, weights binary"), count

    def scored(self, rows: DataFrame, own: bool) -> DataFrame:
        """row, pair, s: sums of kernels times weights, without bias, of rows (row, k, v). own: s has a sum for the machine of all
        rows and each fold, of the pairs that k is in; else one for the machine of all rows, of every pair. Rows that meet no
        vector are missing."""
        bounded_batches(rows.sparkSession)
        shards, count = self.packed()
        width, classes, gamma, pairs = self.folds + 1 if own else 1, self.classes, self.gamma, pairs_of(self.classes)
        numbers = {p: i for i, p in enumerate(pairs)}
        blocks = rows.count() // BLOCK + 1
        groups = max(1, min(blocks, -(-2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // count)))

        def pack(table: pa.Table) -> pa.Table:
            return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int32()), "rows": [table["row"].to_numpy().tobytes()], "kinds": [table["k"].to_numpy().astype(np.int32).tobytes()], "x": [matrix(table["v"]).tobytes()]})

        dealt = rows.select("row", "k", "v").withColumn("block", F.pmod(F.xxhash64(F.lit(3), "row"), F.lit(blocks)).cast("int"))
        own_blocks = dealt.groupBy("block").applyInArrow(pack, "block int, rows binary, kinds binary, x binary").withColumn("group", F.col("block") % groups)
        met = own_blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).join(shards.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))), ["shard", "group"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    row, kinds = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["kinds"], np.int32)
                    x, k = np.frombuffer(r["x"]).reshape(len(row), -1), np.frombuffer(r["k"], np.int32)
                    v, weights = np.frombuffer(r["v"]).reshape(r["n"], -1), np.frombuffer(r["weights"]).reshape(r["n"], classes, -1)[:, :, :width]
                    parts = [(c, v[k == c], weights[k == c].reshape(-1, classes * width)) for c in range(classes) if (k == c).any()]
                    strip = max(1, MOST_NUMBERS // len(k))
                    for i in range(0, len(row), strip):
                        sums = np.zeros((len(pairs), len(x[i : i + strip]), width))
                        for c, vectors, w in parts:
                            some = (kernel(x[i : i + strip], vectors, gamma) @ w).reshape(-1, classes, width)
                            for other in range(classes):
                                if other != c:
                                    sums[numbers[min(c, other), max(c, other)]] += some[:, other]
                        near = row[i : i + strip]
                        for p, (a, b) in enumerate(pairs):
                            mine = (kinds[i : i + strip] == a) | (kinds[i : i + strip] == b) if own else np.ones(len(near), bool)
                            if mine.any():
                                s = pa.ListArray.from_arrays(pa.array(np.arange(0, (mine.sum() + 1) * width, width), pa.int32()), pa.array(sums[p][mine].ravel()))
                                yield pa.RecordBatch.from_arrays([pa.array(near[mine]), pa.array(np.full(mine.sum(), p, np.int32)), s], names=["row", "pair", "s"])

        sums = met.mapInArrow(run, "row long, pair int, s array<double>").groupBy("row", "pair")
        return sums.agg(F.array(*[F.sum(F.col("s")[f]) for f in range(width)]).alias("s"))


def fitted_machines(own: DataFrame, classes: int, c: float, gamma: float, folds: int, shard: int = SHARD) -> tuple[Machines, DataFrame]:
    """Machines of the optimum over all rows (row, id, k, held, v), written, and held-out scores (pair, y, score), written."""
    counts = {r.k: r["count"] for r in own.groupBy("k").count().collect()}
    parts = sum(sorted(counts.values())[-2:]) // shard + 1
    every, none = with_pairs(own, classes), F.array_repeat(F.lit(0.0), folds + 1)
    spread = every.withColumn("shard", F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(parts)).cast("long"))
    now = stored(solve_shards(spread.withColumn("alphas", none), c, gamma, folds, parts == 1), "vectors")
    vectors = own.select("row", "id", "v")
    while parts > 1:
        parts = (parts + 1) // 2
        joined = now.withColumn("shard", F.floor(F.col("shard") / 2)).join(vectors, "row")
        now = discarded(now, stored(solve_shards(joined, c, gamma, folds, parts == 1), "vectors"))
    spark, sums, pairs = own.sparkSession, None, pairs_of(classes)
    members = {(r.k, r.held): r["count"] for r in own.groupBy("k", "held").count().collect()}
    there = lambda k, f: any(n and held != f for (kind, held), n in members.items() if kind == k)
    usable = [[there(a, f) and there(b, f) for f in range(-1, folds)] for a, b in pairs]
    while True:
        machines = Machines(own, now, {}, gamma, classes, folds)
        sums = discarded(sums, stored(machines.scored(own, True), "sums"))
        variables = now.select("row", "pair", "alphas", F.lit(True).alias("known"))
        scored = every.drop("v").join(sums, ["row", "pair"]).join(variables, ["row", "pair"], "left").withColumn("alphas", F.coalesce("alphas", none))
        machines.biases = biases_of(scored, c, folds)
        told = [(p, [float(b) if u else 0.0 for b, u in zip(machines.biases.get(p, [0.0] * (folds + 1)), usable[p], strict=True)], usable[p]) for p in range(len(pairs))]
        machines.biases = {p: b for p, b, _ in told}
        known = F.broadcast(spark.createDataFrame(told, "pair int, b array<double>, usable array<boolean>"))
        misses = [F.when(F.col("usable")[f + 1] & (F.col("held") != f), 1 - F.col("y") * (F.col("s")[f + 1] + F.col("b")[f + 1])) for f in range(-1, folds)]
        wrong = scored.where("known is null").join(known, "pair").withColumn("miss", F.greatest(*misses, F.lit(0.0))).where(F.col("miss") > TOLERANCE)
        order = Window.partitionBy("pair", "y").orderBy(F.desc("miss"), "id", "row")
        worst = stored(wrong.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= shard // 2 + 1).select("pair", "row", "y", "held"), "wrong")
        if not worst.limit(1).count():
            h = F.col("held") + 1
            held = every.drop("v").join(sums, ["row", "pair"], "left").join(known, "pair")
            score = F.when(F.get("usable", h), F.get("s", h) + F.get("b", h))
            out = stored(held.select("pair", "y", F.coalesce(score, F.lit(0.0)).alias("score")), "scores")
            return machines, discarded(sums, discarded(worst, out))
        still = worst.select("pair").distinct()
        both = now.join(F.broadcast(still), "pair", "left_semi").select("pair", "row", "y", "held", "alphas").unionByName(worst.withColumn("alphas", none))
        done = now.join(F.broadcast(still), "pair", "left_anti")
        again = solve_shards(both.withColumn("shard", F.lit(0).cast("long")).join(vectors, "row"), c, gamma, folds, True)
        now = discarded(worst, discarded(now, stored(again.unionByName(done), "vectors")))


def biases_of(scored: DataFrame, c: float, folds: int) -> dict[int, list]:
    """Biases of each pair, over all rows (pair, y, held, s, alphas) of a machine: the mean of what free rows say, or the
    middle of what the others leave; None where nothing says it."""
    sums = []
    for f in range(-1, folds):
        alpha, y, x = F.col("alphas")[f + 1], F.col("y"), F.col("y") - F.col("s")[f + 1]
        own = F.col("held") != f
        up, low = own & F.when(y > 0, alpha < c).otherwise(alpha > 0), own & F.when(y > 0, alpha > 0).otherwise(alpha < c)
        free = F.avg(F.when(own & (alpha > 0) & (alpha < c), x))
        sums.append(F.coalesce(free, (F.max(F.when(up, x)) + F.min(F.when(low, x))) / 2, F.lit(0.0)))
    return {r.pair: list(r.b) for r in scored.groupBy("pair").agg(F.array(*sums).alias("b")).collect()}


def sigmoids(scores: DataFrame, rounds: int = 40) -> dict[int, tuple[float, float]]:
    """a and b of each pair, so that 1 / (1 + exp(a score + b)) is the probability of y = 1; scores: pair, y, score.

    Newton's method on the cross entropy with Platt's targets; each round is two aggregates, a row per pair.
    """
    counts = {r.pair: (r.up, r.down) for r in scores.groupBy("pair").agg(F.count_if(F.col("y") > 0).alias("up"), F.count_if(F.col("y") < 0).alias("down")).collect()}
    found, open_ = {p: (0.0, float(np.log((down + 1) / (up + 1)))) for p, (up, down) in counts.items()}, set(counts)
    spark, steps = scores.sparkSession, [0.5**k for k in range(10)]
    loss = lambda z: F.when(z >= 0, F.col("t") * z + F.log1p(F.exp(-z))).otherwise((F.col("t") - 1) * z + F.log1p(F.exp(z)))
    for _ in range(rounds):
        if not open_:
            break
        told = [(p, *found[p], (counts[p][0] + 1) / (counts[p][0] + 2), 1 / (counts[p][1] + 2)) for p in sorted(open_)]
        own = scores.join(F.broadcast(spark.createDataFrame(told, "pair int, a double, b double, hi double, lo double")), "pair").withColumn("t", F.when(F.col("y") > 0, F.col("hi")).otherwise(F.col("lo")))
        x, z = F.col("score"), F.col("a") * F.col("score") + F.col("b")
        p = 1 / (1 + F.exp(z))
        d, w = F.col("t") - p, p * (1 - p)
        sums = {"ga": d * x, "gb": d, "haa": w * x * x, "hab": w * x, "hbb": w}
        moves = []
        for r in own.groupBy("pair").agg(*[F.sum(v).alias(k) for k, v in sums.items()], F.count("*").alias("n")).collect():
            haa, hbb = r.haa + 1e-12, r.hbb + 1e-12
            det = haa * hbb - r.hab**2
            if max(abs(r.ga), abs(r.gb)) < 1e-7 * r.n:
                open_.discard(r.pair)
            else:
                moves.append((r.pair, -(hbb * r.ga - r.hab * r.gb) / det, -(haa * r.gb - r.hab * r.ga) / det))
        if not moves:
            break
        tried = own.join(F.broadcast(spark.createDataFrame(moves, "pair int, da double, db double")), "pair")
        at = lambda s: loss((F.col("a") + s * F.col("da")) * x + F.col("b") + s * F.col("db"))
        by = {p: (da, db) for p, da, db in moves}
        for r in tried.groupBy("pair").agg(F.sum(at(0.0)).alias("before"), F.array(*[F.sum(at(s)) for s in steps]).alias("after")).collect():
            if (better := [s for s, v in zip(steps, r.after, strict=True) if v < r.before]):
                found[r.pair] = tuple(u + better[0] * m for u, m in zip(found[r.pair], by[r.pair], strict=True))
            else:
                open_.discard(r.pair)
    return found


def coupled(r: np.ndarray) -> np.ndarray:
    """Class probabilities (rows, classes) that fit pairwise ones r (rows, classes, classes) best in squares, summing to 1."""
    n, k, _ = r.shape
    q = -r.transpose(0, 2, 1) * r
    q[:, range(k), range(k)] = (r**2).sum(axis=1) - r[:, range(k), range(k)] ** 2
    system = np.zeros((n, k + 1, k + 1))
    system[:, :k, :k], system[:, :k, k], system[:, k, :k] = q, 1, 1
    right = np.zeros((n, k + 1, 1))
    right[:, k] = 1
    p = np.maximum(np.linalg.solve(system, right)[:, :k, 0], 0)
    return p / p.sum(axis=1, keepdims=True)


@dataclass
class KernelMachine:
    """Machines of all pairs of classes, and the sigmoids of their scores."""

    classes: int
    machines: Machines | None
    sigmoids: dict

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """id, class_id, prob of rows (id, v), a row for each class; v without nulls, of the training's length."""
        curves, k, pairs = self.sigmoids, self.classes, pairs_of(self.classes)
        schema = f"id {dict(rows.dtypes)['id']}, class_id long, prob double"
        if not self.machines:
            return rows.select("id", F.lit(0).cast("long").alias("class_id"), F.lit(1.0).alias("prob"))
        biases = [self.machines.biases.get(p, [0.0])[0] for p in range(len(pairs))]
        own = stored(rows.select("id", "v", F.lit(-1).alias("k"), F.monotonically_increasing_id().alias("row")), "rows")
        sums = self.machines.scored(own, False).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pair", F.col("s")[0].alias("s")))).alias("s"))
        each = own.select("row", "id").join(sums, "row", "left").select("id", F.coalesce(F.transform("s", lambda x: x["s"]), F.array_repeat(F.lit(0.0), len(pairs))).alias("s"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                s, r = batch["s"].flatten().to_numpy().reshape(batch.num_rows, -1) + biases, np.zeros((batch.num_rows, k, k))
                for number, (a, b) in enumerate(pairs):
                    slope, shift = curves.get(number, (0.0, 0.0))
                    p = np.clip(1 / (1 + np.exp(np.clip(slope * s[:, number] + shift, -700, 700))), 1e-7, 1 - 1e-7)
                    r[:, a, b], r[:, b, a] = p, 1 - p
                ids = batch["id"].take(pa.array(np.repeat(np.arange(len(s)), k)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(k), len(s))), pa.array(coupled(r).ravel())], names=["id", "class_id", "prob"])

        return each.mapInArrow(run, schema)


def fit(rows: DataFrame, c: float = 10.0, gamma: float = 0.01, folds: int = 5, shard: int = SHARD, seed: int = 42) -> KernelMachine:
    """A machine of rows (id, class_id, v); class ids are 0, 1, ... without gaps, and vectors have one length.

    The defaults are the reference's. A pair with rows of one class only, in all rows or in a fold, has no machine there and
    scores 0. Rows without class are left out. In a task are the support vectors of a pair and a strip of their kernel.
    """
    classes = (rows.agg(F.max("class_id")).first()[0] or 0) + 1
    if classes == 1:
        return KernelMachine(classes, None, {})
    held = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(folds)).cast("int")
    own = rows.where("class_id is not null").select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), F.col("class_id").cast("int").alias("k"), "v")
    machines, held_out = fitted_machines(stored(own.withColumn("held", held), "rows"), classes, c, gamma, folds, shard)
    return KernelMachine(classes, machines, sigmoids(held_out))


def by_kernel(c: float = 10.0, gamma: float = 0.01, **settings) -> Callable[[DataFrame], Callable[[DataFrame], DataFrame]]:
    """A classifier for inference.fit()."""
    return lambda train: fit(train, c, gamma, **settings).probabilities
