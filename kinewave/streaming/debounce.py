"""The debouncer as a stateful stream: state of a session is its queue, cooldown and last class."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from kinewave.operators.debounce import EMISSIONS, Debouncer


def debounced_stream(rows: DataFrame, **settings) -> DataFrame:
    """As operators.debounce.debounced, over a stream; rows of a session are folded in order of window_id per batch."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Debouncer(**settings)
        if state.exists:
            queue, own.wait, own.last = state.get
            own.queue = deque(json.loads(queue))
        some = pd.concat(list(frames)).sort_values("window_id")
        out = []
        for w, p in zip(some["window_id"], some["probs"], strict=True):
            if p is not None and len(p) and (emitted := own.push([float(x) for x in p])):
                out.append((int(key[0]), int(w), *emitted))
        state.update((json.dumps(list(own.queue)), own.wait, own.last))
        yield pd.DataFrame(out, columns=["session", "window_id", "class_id", "confidence"])

    return rows.groupBy("session").applyInPandasWithState(fold, EMISSIONS, "queue string, wait int, last int", "append", "NoTimeout")
