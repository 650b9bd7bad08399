"""Column functions on numbers and sequences; all are built-in expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def shift_z(z: Column) -> Column:
    return z + 1


def unit_z(z: Column) -> Column:
    """Levels -1 to 4 as 0 to 1."""
    return (z + 1) / F.lit(5.0)


def bin_r(r: Column) -> Column:
    """0 at zero, 1 below 900 (negative ones too), else 2."""
    return F.when(r == 0, 0).when(r < 900, 1).otherwise(2)


def unit_r(r: Column) -> Column:
    """0, 0.5 or 1: negative readings count as none."""
    return F.when((r > 0) & (r < 900), 0.5).when(r >= 900, 1.0).otherwise(0.0)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def parse_array(text: Column) -> Column:
    """array<double> of a printed array such as "[0. 0.1\\n 2]"; an empty one for "[]"."""
    plain = F.trim(F.regexp_replace(text, r"[\[\]\s]+", " "))
    return F.when(plain == "", F.array().cast("array<double>")).otherwise(F.transform(F.split(plain, " "), lambda x: x.cast("double")))


def clean_name(name: Column) -> Column:
    return F.translate(F.regexp_replace(name, " ", "_"), "()", "__")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def variance(values: Column) -> Column:
    """Of the population."""
    m = mean(values)
    return total(F.transform(values, lambda x: (x - m) * (x - m))) / F.size(values)


def energy(values: Column) -> Column:
    """Sum of absolute steps."""
    return total(F.zip_with(F.slice(values, 2, F.size(values)), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: F.abs(a - b)))


def slope(values: Column) -> Column:
    """Least squares against the index; 0 for fewer than two values."""
    n = F.size(values).cast("double")
    middle = (n - 1) / 2
    m = mean(values)
    over = total(F.transform(values, lambda x, i: (i - middle) * (x - m)))
    return F.when(n < 2, 0.0).otherwise(over / (n * (n * n - 1) / 12))


def trend_changes(values: Column, threshold: float = 0.4) -> Column:
    """How often the trend turns by the threshold or more; the first move of that size counts too."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("way"), F.get(values, F.lit(0)).alias("ref"))

    def step(s: Column, v: Column) -> Column:
        up, down = v - s.ref >= threshold, s.ref - v >= threshold
        turn = F.when((s.way <= 0) & up, 1).when((s.way >= 0) & down, -1).otherwise(0)
        follow = ((s.way == 1) & (v > s.ref)) | ((s.way == -1) & (v < s.ref))
        return F.struct(
            (s.n + F.abs(turn)).alias("n"),
            F.when(turn != 0, turn).otherwise(s.way).alias("way"),
            F.when((turn != 0) | follow, v).otherwise(s.ref).alias("ref"),
        )

    return F.when(F.size(values) > 0, F.aggregate(F.slice(values, 2, F.size(values)), start, step, lambda s: s.n)).otherwise(0)


def norm(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def weighted_norm(a: Column, b: Column, weights: Column) -> Column:
    return F.sqrt(total(F.zip_with(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), weights, lambda d, w: d * w)))


def warp_distance(a: Column, b: Column, cost) -> Column:
    """Dynamic time warping of two arrays by cost(x, y), over the sum of lengths; one row of the table is kept at a time."""
    first = F.concat(F.array(F.lit(0.0)), F.array_repeat(F.lit(INF), F.size(b)))

    def row(prev: Column, x: Column) -> Column:
        def cell(cur: Column, j: Column) -> Column:
            best = F.least(F.get(prev, j), F.get(cur, j - 1), F.get(prev, j - 1))
            return F.concat(cur, F.array(cost(x, F.get(b, j - 1)) + best))

        return F.aggregate(F.sequence(F.lit(1), F.size(b)), F.array(F.lit(INF)), cell)

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.aggregate(a, first, row, lambda p: F.get(p, F.size(b)) / (F.size(a) + F.size(b))))


def dtw(a: Column, b: Column) -> Column:
    """Of two number sequences; null where one is empty."""
    return warp_distance(a, b, lambda x, y: F.abs(x - y))


def frame_dtw(a: Column, b: Column, weights: Column) -> Column:
    """Of two sequences of frames (arrays) with a weight for each channel."""
    return warp_distance(a, b, lambda x, y: weighted_norm(x, y, weights))


def combined_distance(channels_a: Column, channels_b: Column, pads_a: Column, pads_b: Column) -> Column:
    """Warping distances summed over channels, plus the Euclidean distance of the pad values."""
    return total(F.zip_with(channels_a, channels_b, dtw)) + norm(pads_a, pads_b)


def resample(values: Column, m: Column) -> Column:
    """m values linearly interpolated at even steps over the sequence."""
    n = F.size(values)

    def at(i: Column) -> Column:
        p = i * (n - 1) / F.greatest(m - 1, F.lit(1))
        low = F.floor(p).cast("int")
        a, b = F.get(values, low), F.get(values, F.least(low + 1, n - 1))
        return a + (b - a) * (p - low)

    return F.transform(F.sequence(F.lit(0), m - 1), at)
