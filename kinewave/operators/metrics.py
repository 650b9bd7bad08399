"""Evaluation of predictions (columns y and predicted), from one count by pair of classes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """y, predicted, n: the observed cells."""
    return rows.groupBy("y", "predicted").agg(F.count("*").alias("n"))


def confusion_matrix(rows: DataFrame, classes: list) -> DataFrame:
    """A row for each y, a column for each predicted class."""
    return confusion(rows).groupBy("y").pivot("predicted", classes).agg(F.sum("n")).na.fill(0)


def class_report(rows: DataFrame) -> DataFrame:
    """class_id, precision, recall, f1, support for all classes in y or predicted; 0 where nothing divides."""
    cells = confusion(rows)
    each = cells.select(F.explode(F.array(
        F.struct(F.col("y").alias("class_id"), F.when(F.col("y") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said")),
        F.struct(F.col("predicted").alias("class_id"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said")),
    )).alias("x")).select("x.*")
    sums = each.groupBy("class_id").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("said")), share(F.col("tp"), F.col("support"))
    return sums.select("class_id", p.alias("precision"), r.alias("recall"), share(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def summary(rows: DataFrame) -> DataFrame:
    """accuracy, and precision, recall and f1 as plain means over classes."""
    report = class_report(rows).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))
    return report.crossJoin(rows.agg(F.avg((F.col("y") == F.col("predicted")).cast("double")).alias("accuracy")))


def best_run(runs: DataFrame, metric: str, order: str) -> DataFrame:
    """The run of the largest metric, the first on ties."""
    return runs.orderBy(F.desc(metric), order).limit(1)


def mean_scores(folds: DataFrame, params: list[str]) -> DataFrame:
    return folds.groupBy(*params).agg(F.avg("score").alias("mean_score"))


def stop_epoch(log: DataFrame, patience: int = 10) -> DataFrame:
    """best_epoch, stop_epoch of a training log (epoch, val_loss): training ends `patience` epochs after the best so far.

    A log has one row an epoch, so it is folded as one array.
    """
    losses = log.agg(F.transform(F.sort_array(F.collect_list(F.struct("epoch", "val_loss"))), lambda x: x).alias("l"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).alias("at"), F.lit(-1).alias("stop"))

    def step(s, x):
        better = x.val_loss < s.best
        go = s.stop < 0
        return F.struct(
            F.when(go & better, x.val_loss).otherwise(s.best).alias("best"),
            F.when(go & better, x.epoch).otherwise(s["at"]).cast("int").alias("at"),
            F.when(go & ~better & (x.epoch - s["at"] >= patience), x.epoch).otherwise(s.stop).cast("int").alias("stop"),
        )

    return losses.select(F.aggregate("l", zero, step).alias("s")).select(F.col("s.at").alias("best_epoch"), F.expr("nullif(s.stop, -1)").alias("stop_epoch"))


def schedule(log: DataFrame, start: float = 1e-3, factor: float = 0.5, patience: int = 5, least: float = 1e-6, delta: float = 1e-4, stop: int = 10) -> DataFrame:
    """run, epoch, learning_rate, trained of training logs (run, epoch, val_loss): two patience counters over each run.

    The rate is multiplied by `factor`, down to `least`, after `patience` epochs in a row whose loss is not below the best by
    more than `delta`. Training stops after the epoch that is the `stop`-th in a row not below the best; later epochs are not
    trained. Null losses are never better. Runs are sorted, and a task reads them in order with two counters as its state.
    """
    dealt = log.select(F.col("run").cast("long").alias("run"), F.col("epoch").cast("int").alias("epoch"), F.col("val_loss").cast("double").alias("val_loss")).repartition("run").sortWithinPartitions("run", "epoch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple | None = None
        rate = best = low = wait = idle = 0.0
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for k, epoch, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen != (k,):
                    seen, rate, best, low, wait, idle = (k,), start, float("inf"), float("inf"), 0, 0
                for column, value in zip(out, (k, epoch, rate, idle < stop), strict=True):
                    column.append(value)
                if idle >= stop:
                    continue
                x = float("inf") if x is None else x
                low, idle = (x, 0) if x < low else (low, idle + 1)
                best, wait = (x, 0) if x < best - delta else (best, wait + 1)
                if wait >= patience:
                    rate, wait = max(rate * factor, least), 0
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.float64()), pa.array(out[3])], names=["run", "epoch", "learning_rate", "trained"])

    return dealt.mapInArrow(run, "run long, epoch int, learning_rate double, trained boolean")
