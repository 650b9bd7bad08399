"""Recognition as a stream: frames in, debounced labels out, with the state of a recording in Spark's state store.

State of a recording are its last frames (a window and a stride of them), the frames that came before their turn, how many
windows were cut, and the debouncer. Windows are cut across micro-batches; smoothing waits for the next frame. What a stream
emits is what operators.inference.recognised() gives for the same frames, however they are dealt to micro-batches.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from kinewave.operators.debounce import Debouncer
from kinewave.operators.frames import REST_FLEX, REST_R, REST_Z
from kinewave.operators.inference import CUTS, Fitted
from kinewave.operators.windows import stride_of

#: Numbers that a classifier may have, as it goes along with the tasks.
MOST_NUMBERS = 4_000_000


@dataclass
class Scorer:
    """A fitted scaler and naive Bayes classifier as arrays."""

    shift: np.ndarray
    scale: np.ndarray
    prior: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    labels: list

    @classmethod
    def of(cls, fitted: Fitted) -> Scorer:
        """From a fit, whose rows come to the driver: a row per class and component, MOST_NUMBERS at most."""
        if (n := fitted.bayes.count()) > MOST_NUMBERS:
            raise ValueError(f"a classifier of {n} rows is too large to go along with each task")
        scaler, bayes = fitted.scaler.orderBy("pos").toPandas(), fitted.bayes.orderBy("class_id", "pos").toPandas()
        shape = (bayes["class_id"].nunique(), -1)
        table = lambda c: bayes[c].to_numpy(float).reshape(shape)
        labels = [r["label"] for r in fitted.codes.orderBy("class_id").collect()]
        return cls(scaler["mean"].to_numpy(), scaler["std"].to_numpy(), np.log(table("prior")[:, 0]), table("mean"), table("var"), labels)

    def probabilities(self, v: np.ndarray) -> np.ndarray:
        x = (v - self.shift) / self.scale
        score = self.prior + (-0.5 * np.log(2 * np.pi * self.var) - (x - self.mean) ** 2 / (2 * self.var)).sum(axis=1)
        e = np.exp(score - score.max())
        return e / e.sum()


def feature_vector(x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The features of a window as operators.inference.window_vectors() orders them."""
    t = np.arange(len(x)) - (len(x) - 1) / 2
    slope = (t[:, None] * (x - x.mean(axis=0))).sum(axis=0) / max((t**2).sum(), 1e-300)
    stats = np.stack([x.mean(axis=0), x.var(axis=0), np.abs(np.diff(x, axis=0)).sum(axis=0), x.max(axis=0), x.min(axis=0), slope], axis=1)
    at = z.argmax(axis=0)
    own = r[at, np.arange(r.shape[1])]
    return np.concatenate([stats.ravel(), np.stack([z.max(axis=0) + 1.0, np.where(own == 0, 0, np.where(own < 900, 1, 2))], axis=1).ravel()])


def normalised_frames(x: np.ndarray, z: np.ndarray, r: np.ndarray) -> np.ndarray:
    bins = np.where((r > 0) & (r < 900), 0.5, np.where(r >= 900, 1.0, 0.0))
    return np.clip(np.concatenate([x, (z + 1) / 5, bins], axis=1), 0.0, 1.0)


@dataclass
class Recording:
    """Frames of one recording that later windows may need, from number `base` on, and how far windows were cut."""

    width: int
    cut: str
    smooth: bool
    base: int
    count: int
    start: int
    number: int
    frames: list
    early: dict

    def add(self, rows: Iterator[tuple[int, list]]) -> bool:
        """Take frames (number, values) in any order; a repeated number counts once. True if the end mark (no values) is reached."""
        for t, values in rows:
            if t >= self.count:
                self.early.setdefault(t, values)
        while self.count in self.early:
            values = self.early.pop(self.count)
            if values is None:
                return True
            self.frames.append(values)
            self.count += 1
        return False

    def arrays(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """flex (smoothed, if so), z and r of frames; the frame after `stop` has to be known, unless there is none."""
        own = self.frames[start - self.base : stop - self.base]
        x, z, r = (np.array([f[k] for f in own], float) for k in range(3))
        if self.smooth:
            near = lambda t: np.mean([self.frames[i - self.base][0] for i in range(max(0, t - 1), min(self.count, t + 2))], axis=0)
            x = np.array([near(t) for t in range(start, stop)])
        return x, z, r

    def vector(self, start: int, stop: int) -> np.ndarray:
        x, z, r = self.arrays(start, stop)
        if self.cut != "aligned":
            return feature_vector(x, z, r)
        flat = normalised_frames(x, z, r)
        return np.concatenate([np.zeros((self.width - len(flat), flat.shape[1])), flat]).ravel()

    def placed(self, offset: int) -> np.ndarray:
        """All frames of a short recording, at a place in a window of rest frames."""
        x, z, r = self.arrays(0, self.count)
        around = ((offset, self.width - self.count - offset), (0, 0))
        return feature_vector(*(np.pad(a, around, constant_values=v) for a, v in ((x, REST_FLEX), (z, REST_Z), (r, REST_R))))

    def windows(self, ended: bool) -> Iterator[np.ndarray]:
        """Vectors of the windows that can be cut now, in order; frames that no later window needs go."""
        stride, known = stride_of(self.width), self.count - (self.smooth and not ended)
        while self.start + self.width <= known:
            yield self.vector(self.start, self.start + self.width)
            self.start += stride
        if ended and self.cut == "sliding":
            rest = self.width - self.count
            if rest < 0 and self.start - stride != -rest:
                yield self.vector(-rest, self.count)
            elif rest > 0 and self.count:
                yield from (self.placed(k) for k in dict.fromkeys((0, rest // 2, rest)))
        if ended and self.cut == "aligned":
            while self.start < self.count:
                yield self.vector(self.start, self.count)
                self.start += stride
        keep = max(self.base, min(self.start, self.count - self.width) - 1)
        self.frames, self.base = self.frames[keep - self.base :], keep


class Recogniser(StatefulProcessor):
    def __init__(self, scorer: Scorer, width: int, cut: str, smooth: bool, idle: int | None, settings: dict) -> None:
        self.scorer, self.width, self.cut, self.smooth, self.idle, self.settings = scorer, width, cut, smooth, idle, settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("recording", "json string")

    def loaded(self) -> tuple[Recording, Debouncer]:
        told = json.loads(self.state.get()[0]) if self.state.exists() else {}
        early = {int(t): f for t, f in told.get("early", {}).items()}
        bouncer = Debouncer(**self.settings, wait=told.get("wait", 0), last=told.get("last", -1), queue=deque(told.get("queue", [])))
        return Recording(self.width, self.cut, self.smooth, *(told.get(k, 0) for k in ("base", "count", "start", "number")), told.get("frames", []), early), bouncer

    def out(self, key: tuple, own: Recording, bouncer: Debouncer, ended: bool) -> pd.DataFrame:
        rows = []
        for v in own.windows(ended):
            if found := bouncer.push(self.scorer.probabilities(v).tolist()):
                rows.append((key[0], own.number, self.scorer.labels[found[0]], found[1]))
            own.number += 1
        if ended:
            self.state.clear()
        else:
            kept = {k: getattr(own, k) for k in ("base", "count", "start", "number", "frames", "early")}
            self.state.update((json.dumps(kept | {"queue": list(bouncer.queue), "wait": bouncer.wait, "last": bouncer.last}),))
        return pd.DataFrame(rows, columns=["session", "window_id", "label", "confidence"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        own, bouncer = self.loaded()
        plain = lambda a: None if a is None else np.asarray(a).tolist()
        every = ((int(t), None if x is None else [plain(x), plain(z), plain(r)]) for f in rows for t, x, z, r in zip(f["t"], f["flex"], f["z"], f["r"], strict=True))
        ended = own.add(every)
        if self.idle:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if not ended:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield self.out(key, own, bouncer, ended)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.out(key, *self.loaded(), True)

    def close(self) -> None:
        pass


def recognised_stream(frames: DataFrame, fitted: Fitted, width: int, cut: str = "sliding", smooth: bool = False, idle: int | None = None, **settings) -> DataFrame:
    """session, window_id, label, confidence of a stream of frames (recording_id, t, flex, z, r), append mode.

    Frames of a recording are numbered 0, 1, ... by t and may come in any order; one that comes before its turn waits, a
    repeated one counts once. A row without flex at the t after the last frame ends a recording: tail, short recordings and
    short windows are cut then, and its state goes. `idle` (milliseconds) ends one that gets no frames for so long; frames
    that follow belong to a new recording from t = 0. A full cut needs no end. The state store has to be the one by RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    if cut not in CUTS:
        raise ValueError(f"cut has to be one of {CUTS}")
    kinds = dict(frames.dtypes)
    label = dict(fitted.codes.dtypes)["label"]
    processor = Recogniser(Scorer.of(fitted), width, cut, smooth, idle, settings)
    rows = frames.select("recording_id", "t", "flex", "z", "r").groupBy("recording_id")
    return rows.transformWithStateInPandas(processor, f"session {kinds['recording_id']}, window_id int, label {label}, confidence double", "append", "processingTime" if idle else "none")
