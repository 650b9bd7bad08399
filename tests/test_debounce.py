"""The debouncer over segments against its state machine, window by window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinewave.operators.debounce import Debouncer, debounced


def plain(rows, **settings):
    out, states = [], {}
    for s, w, p in sorted((r for r in rows if r[2]), key=lambda r: (r[0] is not None, r[0], r[1])):
        if found := states.setdefault(s, Debouncer(**settings)).push([x or 0.0 for x in p]):
            out.append((s, w, *found))
    return sorted(out, key=str)


def script(seed, n=240):
    """Stretches of steady classes, switches, gated windows and ties, one hot session, gaps and nulls."""
    rng, rows = np.random.default_rng(seed), []
    for s, count in ((1, n), (2, 37), (3, 3), (None, 20)):
        cls = 0
        for w in range(count):
            if rng.random() < 0.12:
                cls = int(rng.integers(0, 3))
            p = [0.125, 0.125, 0.125]
            p[cls] = float(rng.choice([0.25, 0.5, 0.75, 1.0], p=[0.15, 0.25, 0.3, 0.3]))
            rows.append((s, 3 * w + 1, None if rng.random() < 0.03 else [] if rng.random() < 0.02 else [None, *p[1:]] if rng.random() < 0.03 else p))
    return rows


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize(("size", "cooldown", "length", "fan"), [(4, 4, 6, 2), (3, 0, 5, 3), (2, 7, 9, 4), (1, 2, 4, 2), (4, 4, 256, 64)])
def test_segments_emit_what_the_state_machine_does(spark, strict, size, cooldown, length, fan):
    rows = script(size * 10 + cooldown + strict)
    settings = {"threshold": 0.5, "size": size, "cooldown": cooldown, "strict": strict}
    frame = spark.createDataFrame(rows, "session long, window_id int, probs array<double>").repartition(5)
    got = debounced(frame, **settings, most=0 if length < 256 else 10**6, length=length, fan=fan)
    assert got.columns == ["session", "window_id", "class_id", "confidence"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, **settings) and plain(rows, **settings)


def test_hot_session_is_spread_and_empty_tables_are_fine(spark):
    rows = spark.range(2000).select(F.lit("a").alias("session"), F.col("id").cast("int").alias("window_id"), F.array(F.lit(0.75), F.lit(0.25)).alias("probs"))
    got = debounced(rows, threshold=0.5, size=4, cooldown=4, most=0, length=16, fan=4)
    assert [r.window_id for r in got.orderBy("window_id").collect()] == list(range(3, 2000, 5))
    assert debounced(rows.where("false")).collect() == []
