"""Brute-force nearest neighbours in blocks, votes, and Gaussian naive Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import bounded_batches, matrix, stored

BLOCK, SHARD = 1024, 4096
#: Of searches by warping: rows of a block and of a shard where only pads are compared; numbers of a table of pairs, rows that are
#: warped before bounds are known, and pairs that are warped together.
WIDE_BLOCK, WIDE_SHARD, TABLE, FIRST, TOGETHER = 4096, 32_768, 2_000_000, 16, 256


def packed(rows: DataFrame, key: str, size: int, within: dict | None = None) -> DataFrame:
    """One row for about `size` vectors (id, class_id, v); rows of one dimension are expected. within: rows by class, whose
    vectors are packed apart."""
    if within is None:
        n = F.lit(rows.count() // size + 1)
    else:
        n = F.create_map(*[F.lit(x) for c, count in within.items() for x in (c, count // size + 1)])[F.col("class_id")]
    dealt = rows.withColumn(key, F.pmod(F.xxhash64(F.lit(1), "id"), n).cast("int")).withColumn("apart", (F.lit(0) if within is None else F.col("class_id")).cast("long"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        v = np.array(table["v"].to_pylist(), np.float64)
        ids, classes = (np.array(table[c].to_pylist(), np.int64) for c in ("id", "class_id"))
        return pa.table({key: pa.array([table[key][0].as_py()], pa.int32()), "apart": pa.array([table["apart"][0].as_py()], pa.int64()), f"{key}_v": [v.tobytes()], f"{key}_id": [ids.tobytes()], f"{key}_class": [classes.tobytes()]})

    return dealt.groupBy(key, "apart").applyInArrow(pack, f"{key} int, apart long, {key}_v binary, {key}_id binary, {key}_class binary")


def squared(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    return ((t - x) ** 2).sum(axis=1)


class Warped:
    """Distances of a vector to many: its first parts, as wide as given, are channels, which are compared by time warping
    (over the sum of lengths); the rest are pad values, whose Euclidean distance is added."""

    def __init__(self, widths: list[int]) -> None:
        self.parts = [(sum(widths[:i]), sum(widths[: i + 1])) for i in range(len(widths))]
        self.rest = sum(widths)

    def pads(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.sqrt(((t[:, self.rest :] - x[self.rest :]) ** 2).sum(axis=1))

    def __call__(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        for low, high in self.parts:
            width, b = high - low, t[:, low:high]
            row = np.full((width + 1, len(t)), np.inf)
            row[0] = 0
            for v in x[low:high]:
                cost, best = np.abs(b - v).T, np.minimum(row[1:], row[:-1])
                row[0] = np.inf
                for j in range(width):
                    row[j + 1] = cost[j] + np.minimum(best[j], row[j])
            out += row[width] / (2 * width)
        return out + self.pads(x, t)

    def pads_squared(self, x: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared pad distances of all rows of x to all of t, as one product, and what rounding may add to those of a row of x."""
        a, b = x[:, self.rest :], t[:, self.rest :]
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        one = np.ones
        out = np.concatenate([a, aa[:, None], one((len(a), 1))], axis=1) @ np.concatenate([-2 * b, one((len(b), 1)), bb[:, None]], axis=1).T
        return out, 1e-12 * (aa + (bb.max() if len(bb) else 0)) * (1 + self.rest)

    def ends(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """A bound without pads, of all rows of x to all of t: the first and last pairs are paid."""
        out = np.zeros((len(x), len(t)))
        for low, high in self.parts:
            for at in {low, high - 1}:
                out += np.abs(x[:, at, None] - t[:, at]) / (2 * (high - low))
        return out

    def envelopes(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """bounds() of pairs, row by row."""
        out = np.sqrt(((t[:, self.rest :] - x[:, self.rest :]) ** 2).sum(axis=1))
        for low, high in self.parts:
            a, b = x[:, low:high], t[:, low:high]
            over = lambda p, q: np.maximum(np.maximum(p - q.max(axis=1, keepdims=True), q.min(axis=1, keepdims=True) - p), 0).sum(axis=1)
            ends = np.abs(a[:, 0] - b[:, 0]) + (np.abs(a[:, -1] - b[:, -1]) if high - low > 1 else 0)
            out += np.maximum(np.maximum(over(a, b), over(b, a)), ends) / (2 * (high - low))
        return out

    def of_pairs(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Distances of pairs, row by row (nine digits): warping tables of TOGETHER pairs at once, by diagonals."""
        out = np.sqrt(((t[:, self.rest :] - x[:, self.rest :]) ** 2).sum(axis=1))
        for at in range(0, len(x), TOGETHER):
            own = slice(at, at + TOGETHER)
            for low, high in self.parts:
                out[own] += diagonals(np.ascontiguousarray(x[own, low:high].T), np.ascontiguousarray(t[own, low:high][:, ::-1].T)) / (2 * (high - low))
        return np.round(out, 9)

    def bounds(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        """No distance is smaller: every value is warped to some value of the other side, so what it lies beyond the other's
        envelope is paid, on either side; and the first and last pairs are paid whatever the way between."""
        out = self.pads(x, t)
        for low, high in self.parts:
            a, b = x[low:high], t[:, low:high]
            top, bottom = b.max(axis=1, keepdims=True), b.min(axis=1, keepdims=True)
            mine = np.maximum(np.maximum(a - top, bottom - a), 0).sum(axis=1)
            theirs = np.maximum(np.maximum(b - a.max(), a.min() - b), 0).sum(axis=1)
            ends = np.abs(a[0] - b[:, 0]) + (np.abs(a[-1] - b[:, -1]) if high - low > 1 else 0)
            out += np.maximum(np.maximum(mine, theirs), ends) / (2 * (high - low))
        return out


def diagonals(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Warping sums of the columns of a and b (width, pairs); those of b are reversed."""
    width, n = a.shape
    first, before, now = (np.full((width + 1, n), np.inf) for _ in range(3))  # a cell (i, j) is at i + 1 of diagonal i + j
    first[0] = 0
    for s in range(2 * width - 1):
        low, high = max(0, s - width + 1), min(s, width - 1) + 1
        cost = np.abs(a[low:high] - b[width - 1 - s + low : width - 1 - s + high])
        best = np.minimum(before[low + 1 : high + 1], before[low:high])
        np.minimum(best, first[low:high], out=best)
        np.add(cost, best, out=now[low + 1 : high + 1])
        if s == 0:
            first[0] = np.inf
        first, before, now = before, now, first
    return before[width]


def searched(x: np.ndarray, t: np.ndarray, tid: np.ndarray, k: int, measure: Warped, allowed, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and of t, and distances, of the k nearest rows of t to each row of x that allowed(low, high) has, ties to the
    smaller id; those beyond the row's limit may be missing.

    A row without limit warps the FIRST rows of the least bounds, and takes the kth best for its limit. Then all pairs are warped
    that no bound rules out: pads first, then the ends, then envelopes.
    """
    out: list[tuple] = []
    strip = max(1, TABLE // max(len(t), 1))
    for low in range(0, len(x) if len(t) else 0, strip):
        own = slice(low, min(len(x), low + strip))
        pads, slack = measure.pads_squared(x[own], t)
        ok, most = allowed(own.start, own.stop), limit[own].copy()
        free = np.flatnonzero(np.isinf(most))
        rows, columns, d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        seen = np.zeros(pads.shape, bool) if len(free) else None
        if len(free):
            bound = np.where(ok[free], np.sqrt(np.maximum(pads[free], 0)) + measure.ends(x[own][free], t), np.inf)
            some = min(len(t), max(k, FIRST))
            near = np.argpartition(bound, some - 1, axis=1)[:, :some] if some < len(t) else np.tile(np.arange(len(t)), (len(free), 1))
            there = ok[free[:, None], near]
            i, j = np.nonzero(there)
            rows, columns = free[i], near[i, j]
            seen[rows, columns] = True
            d = measure.of_pairs(x[own][rows], t[columns])
            table = np.full(near.shape, np.inf)
            table[i, j] = d
            if some >= k:
                most[free] = np.where(np.isnan(kth := np.sort(table, axis=1)[:, k - 1]), np.inf, kth)
        within = ok & ~(pads > ((most + 1e-8) ** 2 + slack)[:, None])
        if seen is not None:
            within &= ~seen
        i, j = np.nonzero(within)
        for at in range(0, len(i), TABLE // 50):  # pairs at once
            a, b = i[at : at + TABLE // 50], j[at : at + TABLE // 50]
            kept = ~(measure.envelopes(x[own][a], t[b]) - 1e-8 > most[a])
            a, b = a[kept], b[kept]
            rows, columns, d = np.append(rows, a), np.append(columns, b), np.append(d, measure.of_pairs(x[own][a], t[b]))
        order = np.lexsort((tid[columns], d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        kept = (place < k) & ~(d > limit[own][rows])
        out.append((rows[kept] + low, columns[kept], d[kept]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


FOUND = ("id", "neighbour", "class_id", "d")


def answers(ids: np.ndarray, x: np.ndarray, cell: np.ndarray, limit: np.ndarray, tid: np.ndarray, tclass: np.ndarray, t: np.ndarray, tcell: np.ndarray, k: int, measure: Warped, same: bool) -> pa.Table:
    """FOUND of queries (equal ones are searched once) among rows of their cell (same), or of the other cells."""
    order = np.lexsort((-limit, *x.T)) if len(x) else np.empty(0, np.int64)
    x, ids, cell, limit = x[order], ids[order], cell[order], limit[order]
    new = np.append(True, (x[1:] != x[:-1]).any(axis=1))[: len(x)]
    number = np.cumsum(new) - 1  # the first of equal queries has the largest limit
    own = cell[new]
    allowed = (lambda a, b: own[a:b, None] == tcell) if same else (lambda a, b: own[a:b, None] != tcell)
    rows, columns, d = searched(x[new], t, tid, k, measure, allowed, limit[new])
    low, high = np.searchsorted(rows, number), np.searchsorted(rows, number, "right")
    back = np.repeat(np.arange(len(ids)), high - low)
    at = np.arange(len(back)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + np.repeat(low, high - low)
    return pa.table({"id": ids[back], "neighbour": tid[columns[at]], "class_id": tclass[columns[at]], "d": d[at]})


def best_of(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def in_cells(queries: DataFrame, train: DataFrame, k: int, measure: Warped) -> DataFrame:
    """FOUND of the rows of a query's own cell. Cells are dealt to groups; those of many rows have groups of their own, in parts."""
    sizes = queries.groupBy("cell").agg(F.count("*").alias("q"), F.lit(0).alias("t")).unionByName(train.groupBy("cell").agg(F.lit(0).alias("q"), F.count("*").alias("t")))
    hot = sizes.groupBy("cell").agg(F.sum("q").alias("q"), F.sum("t").alias("t")).where(f"q > 0 and t > 0 and (q > {BLOCK} or t > {SHARD})").collect()
    groups = max(queries.count() // BLOCK, train.count() // SHARD) + 1
    spark = train.sparkSession
    told = spark.createDataFrame([(r.cell, r.q // BLOCK + 1, r.t // SHARD + 1) for r in hot], "cell long, blocks long, shards long")

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        each = rows.join(F.broadcast(told), "cell", "left").withColumn("group", F.when(F.col("blocks").isNull(), F.pmod("cell", F.lit(groups))).otherwise(F.col("cell")))
        each = each.withColumn(mine, F.when(F.col(mine).isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit(5), "v"), F.col(mine))))
        return each.withColumn(other, F.explode(F.when(F.col(other).isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))))

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        if not q.num_rows or not t.num_rows:
            return pa.table({c: pa.array([], pa.float64() if c == "d" else pa.int64()) for c in FOUND})
        none = np.full(q.num_rows, np.inf)
        return answers(q["id"].to_numpy(), matrix(q["v"]), q["cell"].to_numpy(), none, *(t[c].to_numpy() for c in ("id", "class_id")), matrix(t["v"]), t["cell"].to_numpy(), k, measure, True)

    keys = ("group", "blocks", "shards")
    return dealt(queries, "blocks", "shards").groupBy(*keys).cogroup(dealt(train, "shards", "blocks").groupBy(*keys)).applyInArrow(run, "id long, neighbour long, class_id long, d double")


def beyond_cells(queries: DataFrame, train: DataFrame, k: int, measure: Warped) -> DataFrame:
    """FOUND of the rows of other cells that are within a query's limit: packed blocks meet packed shards, where one product
    gives the pad distances of all pairs, and only pairs within the limit go on."""
    bounded_batches(train.sparkSession)
    blocks, shards = queries.count() // WIDE_BLOCK + 1, train.count() // WIDE_SHARD + 1
    groups = max(1, min(blocks, -(-3 * int(train.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) // shards)))

    def packed_by(rows: DataFrame, key: str, count: int, columns: list[str]) -> DataFrame:
        def pack(table: pa.Table) -> pa.Table:
            return pa.table({key: pa.array([table[key][0].as_py()], pa.int32())} | {f"{key}_{c}": [(matrix(table[c]) if c == "v" else table[c].to_numpy()).tobytes()] for c in columns})

        each = rows.withColumn(key, F.pmod(F.xxhash64(F.lit(6), "v"), F.lit(count)).cast("int"))
        return each.groupBy(key).applyInArrow(pack, f"{key} int, " + ", ".join(f"{key}_{c} binary" for c in columns))

    q = packed_by(queries, "block", blocks, ["id", "cell", "v", "limit"]).withColumn("group", F.col("block") % groups).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    t = packed_by(train, "shard", shards, ["id", "class_id", "cell", "v"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: memoryview(batch[c][i].as_buffer()) for c in batch.schema.names if "_" in c}
                (ids, cell, tid, tclass, tcell), (x, limit, v) = (np.frombuffer(row[c], np.int64) for c in ("block_id", "block_cell", "shard_id", "shard_class_id", "shard_cell")), (np.frombuffer(row[c]) for c in ("block_v", "block_limit", "shard_v"))
                yield from answers(ids, x.reshape(len(ids), -1), cell, limit, tid, tclass, v.reshape(len(tid), -1), tcell, k, measure, False).to_batches()

    return q.join(t, ["shard", "group"]).mapInArrow(run, "id long, neighbour long, class_id long, d double")


def closest(x: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, distances, step: int = 64) -> tuple[np.ndarray, np.ndarray, int]:
    """Places and distances (nine digits) of the k rows of t nearest to x, ties to the smaller id; and how many were computed.

    Where distances have lower bounds, rows are taken in their order, and none whose bound is beyond the kth best so far.
    """
    if not hasattr(distances, "bounds") or len(t) <= step:
        d = np.round(distances(x, t), 9)
        best = np.lexsort((ids, d))[:k]
        return best, d[best], len(t)
    bound = distances.bounds(x, t) - 1e-8
    order = np.argsort(bound, kind="stable")
    best, d, done = np.empty(0, np.int64), np.empty(0), 0
    while done < len(t):
        some = order[done : done + step]
        if len(best) >= k:
            some = some[bound[some] <= d[k - 1]]
            if not len(some):
                break
        best, d = np.append(best, some), np.append(d, np.round(distances(x, t[some]), 9))
        done += len(some)
        chosen = np.lexsort((ids[best], d))[:k]
        best, d = best[chosen], d[chosen]
        if len(some) < step:
            break
    return best, d, done


def found_by(test: DataFrame, train: DataFrame, k: int, distances, within: dict | None = None) -> DataFrame:
    """id, rank, neighbour, class_id, d of each test row (id, class_id, v): the k training rows of least distances(x, rows).

    Distances are rounded to 9 digits, ties go to the smaller id. Each packed block of test rows meets each packed shard of
    training rows (of its class, if `within` has the training rows of each) and sends on k rows a query; vectors with nulls
    have to be gone.
    """
    blocks, shards = packed(test, "block", BLOCK, within), packed(train, "shard", SHARD, within)
    if within is None:
        count = F.lit(train.count() // SHARD + 1)
    else:
        count = F.create_map(*[F.lit(x) for c, n in within.items() for x in (int(c), n // SHARD + 1)])[F.col("apart")]
    pairs = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), count - 1))).join(shards, ["shard", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qid, tid, tclass = (np.frombuffer(row[c], np.int64) for c in ("block_id", "shard_id", "shard_class"))
                q, t = np.frombuffer(row["block_v"]).reshape(len(qid), -1), np.frombuffer(row["shard_v"]).reshape(len(tid), -1)
                out: list[list] = [[], [], [], []]
                for i, x in zip(qid.tolist(), q, strict=True):
                    best, d, _ = closest(x, t, tid, k, distances)
                    for column, values in zip(out, ([i] * len(best), tid[best].tolist(), tclass[best].tolist(), d.tolist()), strict=True):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.float64())], names=["id", "neighbour", "class_id", "d"])

    found = pairs.mapInArrow(run, "id long, neighbour long, class_id long, d double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(test: DataFrame, train: DataFrame, k: int) -> DataFrame:
    """id, rank, neighbour, class_id, distance: the k nearest training rows by Euclidean distance; see found_by()."""
    return found_by(test, train, k, squared).select("id", "rank", "neighbour", "class_id", F.sqrt("d").alias("distance"))


def nearest_within(rows: DataFrame, k: int) -> DataFrame:
    """As nearest(), of each row among those of its class, itself included; classes are blocks of their own in one pass."""
    counts = {r["class_id"]: r["count"] for r in rows.groupBy("class_id").count().collect()}
    return found_by(rows, rows, k, squared, counts or {0: 0}).select("id", "rank", "neighbour", "class_id", F.sqrt("d").alias("distance"))


def nearest_warped(test: DataFrame, train: DataFrame, k: int, widths: list[int]) -> DataFrame:
    """As nearest(), by the combined distance of channels and pads (scalars.combined_distance); see Warped.

    No distance is smaller than that of the pads. So rows are searched among those of equal pads first (their cell), and what
    is beyond the kth best of these is ruled out by pads for the others. Of equal training rows the k of the smallest ids can be
    among the nearest.
    """
    measure = Warped(widths)
    cell = F.xxhash64(F.slice("v", measure.rest + 1, F.greatest(F.size("v") - measure.rest, F.lit(0)))).alias("cell")
    copies = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    own = stored(train.select(F.col("id").cast("long"), F.col("class_id").cast("long"), "v", cell).withColumn("_n", copies).where(F.col("_n") <= k).drop("_n"), "train")
    queries = stored(test.select(F.col("id").cast("long"), "v", cell), "queries")
    near = stored(best_of(in_cells(queries, own, k, measure), k), "near")
    limits = near.where(F.col("rank") == k).select("id", F.when(~F.isnan("d"), F.col("d")).alias("limit"))
    limited = queries.join(limits, "id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    found = near.select(*FOUND).unionByName(beyond_cells(limited, own, k, measure))
    return best_of(found, k).select("id", "rank", "neighbour", "class_id", F.col("d").alias("distance"))


def votes(neighbours: DataFrame, weighted: bool = False) -> DataFrame:
    """id, class_id, prob: shares of the votes. Weighted: by 1 / distance; neighbours at distance 0 take all."""
    if not weighted:
        w = F.lit(1.0)
    else:
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("id"))
        neighbours = neighbours.withColumn("_zero", zero)
        w = F.when(F.col("_zero") == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance"))
    sums = neighbours.withColumn("_w", w).groupBy("id", "class_id").agg(F.sum("_w").alias("s"))
    return sums.withColumn("prob", F.col("s") / F.sum("s").over(Window.partitionBy("id"))).where("prob > 0").select("id", "class_id", "prob")


def decided(probabilities: DataFrame) -> DataFrame:
    """id, predicted, confidence: the likeliest class, the lowest on ties."""
    best = probabilities.groupBy("id").agg(F.max_by("class_id", F.struct("prob", (-F.col("class_id")).alias("low"))).alias("predicted"), F.max("prob").alias("confidence"))
    return best


def bayes_fit(train: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """class_id, pos, mean, var, prior; a share of the largest variance of any component is added to all variances."""
    long = train.select("class_id", F.posexplode("v").alias("pos", "x"))
    floor = long.groupBy("pos").agg(F.var_pop("x").alias("s")).agg(F.max("s")).first()[0] or 0.0
    prior = train.groupBy("class_id").agg(F.count("*").alias("n")).withColumn("prior", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))).select("class_id", "prior")
    stats = long.groupBy("class_id", "pos").agg(F.avg("x").alias("mean"), (F.var_pop("x") + smoothing * floor).alias("var"))
    return stats.join(prior, "class_id")


def bayes_scores(test: DataFrame, fitted: DataFrame) -> DataFrame:
    """id, class_id, score: log prior plus log densities. One row a class is broadcast: means and variances as arrays."""
    classes = fitted.groupBy("class_id").agg(F.first("prior").alias("prior"), F.sort_array(F.collect_list(F.struct("pos", "mean", "var"))).alias("s"))
    each = test.select("id", "v").crossJoin(F.broadcast(classes))
    terms = F.zip_with("v", "s", lambda x, s: -0.5 * F.log(2 * 3.141592653589793 * s["var"]) - (x - s["mean"]) * (x - s["mean"]) / (2 * s["var"]))
    return each.select("id", "class_id", (F.log("prior") + F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)).alias("score"))


def softmax(scores: DataFrame) -> DataFrame:
    """id, class_id, prob."""
    own = Window.partitionBy("id")
    e = scores.withColumn("e", F.exp(F.col("score") - F.max("score").over(own)))
    return e.select("id", "class_id", (F.col("e") / F.sum("e").over(own)).alias("prob"))
