"""Operators against plain Python and NumPy on small inputs."""

import json

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from kinewave.functions import scalars as S
from kinewave.operators import augment, debounce, features, frames, metrics, models, neighbours, prep, windows
from kinewave.sources import files
from kinewave.streaming.debounce import debounced_stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def array(values):
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def brute_dtw(a, b, cost):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            d[i, j] = cost(x, y) + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    return d[-1, -1] / (len(a) + len(b))


def test_dtw(spark):
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (4, 7), (12, 5)):
        a, b = rng.random(n), rng.random(m)
        assert one(spark, S.dtw(array(a), array(b))) == pytest.approx(brute_dtw(a, b, lambda x, y: abs(x - y)))
        assert one(spark, S.dtw(array(a), array(b))) == pytest.approx(one(spark, S.dtw(array(b), array(a))))
        assert one(spark, S.dtw(array(a), array(a))) == 0
    p, q, w = rng.random((5, 3)), rng.random((6, 3)), [1.0, 0.5, 2.0]
    got = one(spark, S.frame_dtw(F.array(*map(array, p)), F.array(*map(array, q)), array(w)))
    assert got == pytest.approx(brute_dtw(p, q, lambda x, y: np.sqrt((w * (x - y) ** 2).sum())))
    both = one(spark, S.combined_distance(F.array(*map(array, p)), F.array(*map(array, q[:5])), array([1, 2]), array([1, 4])))
    assert both == pytest.approx(sum(brute_dtw(x, y, lambda s, t: abs(s - t)) for x, y in zip(p, q, strict=False)) + 2)
    assert one(spark, S.dtw(array([]), array([1]))) is None


@pytest.mark.parametrize(("values", "want"), [([], 0), ([0.3], 0), ([0.1, 0.9, 0.2, 0.2, 0.95, 0.1], 4), ([0.5, 0.6, 0.7], 0), ([1, 0.6, 0.7, 0.1, 0.6], 2)])
def test_trend_changes(spark, values, want):
    assert one(spark, S.trend_changes(array(values))) == want


def test_scalars(spark):
    v = [0.1, 0.5, 0.2, 0.9]
    assert one(spark, S.slope(array(v))) == pytest.approx(np.polyfit(range(4), v, 1)[0])
    assert one(spark, S.slope(array([2]))) == 0
    assert one(spark, S.variance(array(v))) == pytest.approx(np.var(v))
    assert one(spark, S.energy(array(v))) == pytest.approx(np.abs(np.diff(v)).sum())
    assert one(spark, S.energy(array([1]))) == 0
    assert one(spark, S.half_even(F.lit(2.5))) == 2
    assert one(spark, S.parse_array(F.lit("[0. 0.25\n  1.]"))) == [0, 0.25, 1]
    assert one(spark, S.parse_array(F.lit("[]"))) == []
    assert [one(spark, S.bin_r(F.lit(x))) for x in (0, -3, 899, 900)] == [0, 1, 1, 2]
    assert [one(spark, S.unit_r(F.lit(x))) for x in (0, -3, 899, 900)] == [0, 0, 0.5, 1]
    assert one(spark, S.resample(array([0, 1, 2]), F.lit(5))) == [0, 0.5, 1, 1.5, 2]


def recording(n):
    return [(1, 3, t, [t / 10], [t % 6 - 1] * 2, [t * 100] * 2) for t in range(n)]


SCHEMA = "recording_id long, label int, t int, flex array<double>, z array<int>, r array<int>"


@pytest.mark.parametrize("n", [1, 12, 38, 39, 40, 41, 50, 55, 85])
def test_windows(spark, n):
    rows = spark.createDataFrame(recording(n), SCHEMA)
    got = {r.start: [f.flex[0] for f in r.frames] for r in windows.gathered(windows.sliding(rows, 40, pads=2)).collect()}
    x = [t / 10 for t in range(n)]
    if n > 40:
        starts = sorted({*range(0, n - 39, 10), n - 40})
        want = {s: x[s : s + 40] for s in starts}
    else:
        want = {s: [0.0] * s + x + [0.0] * (40 - n - s) for s in {0, (40 - n) // 2, 40 - n}}
    assert got == want
    full = windows.full_windows(rows, 40, 10).select("start").distinct().collect()
    assert sorted(r.start for r in full) == list(range(0, n - 39, 10))
    gold = windows.gathered(windows.gold_segment(rows, 40, pads=2)).first().frames
    assert len(gold) == max(40, n) and [f.t for f in gold] == list(range(max(40, n)))
    flat = frames.flattened(rows, grouped=False)
    kept = windows.pad_or_truncate(flat, 40, 5).orderBy("t").collect()
    assert len(kept) == 40 and sum(r["mask"] for r in kept) == min(n, 40)
    lined = windows.right_aligned(flat, 40, 10, 5).groupBy("start").agg(F.count("*").alias("n"), F.count_if("mask").alias("m")).collect()
    assert {r.start: (r.n, r.m) for r in lined} == {s: (40, min(40, n - s)) for s in range(0, n, 10)}


def test_windows_of_nothing(spark):
    rows = spark.createDataFrame([], SCHEMA)
    assert windows.sliding(rows, 40).count() == 0 and windows.quantile_length(rows) == 0
    assert features.feature_table(windows.sliding(rows, 40)).count() == 0


def test_ranks_break_ties_by_place(spark):
    assert one(spark, features.ranks(F.array(F.lit(3), F.lit(None).cast("int"), F.lit(1), F.lit(3)))) == [2, 0, 1, 3]


def test_anchor_distances(spark):
    rows = spark.createDataFrame(recording(12) + [(2, 4, *r[2:]) for r in recording(7)], SCHEMA)
    gold, cut, w = features.exemplars(rows, 5, pads=2), windows.sliding(rows, 5, pads=2), [1.0, 0.5, 2.0, 0.1, 0.2]
    got = {(r.recording_id, r.start, r.anchor): r.distance for r in features.anchor_distances(cut, gold, w, block=3).collect()}
    seqs = windows.gathered(cut).withColumn("seq", F.transform("frames", features.flat)).crossJoin(gold.withColumnRenamed("label", "anchor"))
    want = seqs.select("recording_id", "start", "anchor", S.frame_dtw(F.col("seq"), F.col("gold"), F.array(*map(F.lit, w))).alias("d")).collect()
    assert got == pytest.approx({(r.recording_id, r.start, r.anchor): r.d for r in want}) and len({a for _, _, a in got}) == 2


def test_recordings(spark, tmp_path):
    frame = {"flex": {"flex8": {"curl": 0.5}}, "pads": [{"n": "PAD_CH1", "z": 2, "r": 9}, {"n": "PAD_CH1", "z": 3, "r": 7}, {"n": "other", "z": 1, "r": 1}]}
    (tmp_path / "a.json").write_text(json.dumps([{"label": "مرحبا", "frames": [frame, frame]}, {"label": "b", "frames": [frame]}], ensure_ascii=False))
    (tmp_path / "b.json").write_text(json.dumps({"label": "c", "frames": [frame]}))
    (tmp_path / "bad.json").write_text("{not")
    (tmp_path / "note.txt").write_text("x")
    got = files.session_files(spark, str(tmp_path))
    assert sorted((r.label, len(r.frames)) for r in got.collect()) == sorted([("مرحبا", 2), ("b", 1), ("c", 1)])
    assert [r.file.rsplit("/")[-1] for r in files.rejected_files(spark, str(tmp_path)).collect()] == ["bad.json"]
    row = frames.from_recordings(got).where("label = 'c'").first()
    assert row.flex == [0.5] + [0.0] * 7 and row.z == [-1, 3] + [-1] * 5 and row.r == [0, 7] + [0] * 5
    assert frames.from_recordings(got, by_name=False).where("label = 'c'").first().z == [2, 3, 1]
    files.write_recordings(got, str(tmp_path / "out"))
    assert files.read_recordings(spark, str(tmp_path / "out")).count() == 3
    for name, value in (("list", [frame]), ("dict", {"frames": [frame]})):
        (tmp_path / f"{name}.txt").write_text(json.dumps(value))
        assert files.frame_stream(spark, str(tmp_path / f"{name}.txt")).count() == 1
    (tmp_path / "none.txt").write_text("{}")
    with pytest.raises(Exception, match="no frames"):
        files.frame_stream(spark, str(tmp_path / "none.txt")).collect()


def test_class_list(spark, tmp_path):
    codes = prep.label_codes(spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string"))
    files.write_class_list(codes, str(tmp_path / "c"))
    assert [tuple(r) for r in files.class_list(spark, str(tmp_path / "c")).orderBy("class_id").collect()] == [(0, "a"), (1, "b")]


SCRIPT = [[0.9, 0.1]] * 6 + [[0.5, 0.5]] + [[0.9, 0.1]] * 5 + [[0.1, 0.9]] * 6 + [[0.9, 0.1]] * 4


@pytest.mark.parametrize("strict", [True, False])
def test_stream_equals_batch(spark, tmp_path, strict):
    rows = [Row(session=s, window_id=i, probs=p) for s in (1, 2) for i, p in enumerate(SCRIPT[s:])]
    settings = {"threshold": 0.6, "size": 3, "cooldown": 4, "strict": strict}
    schema = "session long, window_id int, probs array<double>"
    batch = sorted(map(tuple, debounce.debounced(spark.createDataFrame(rows, schema), **settings).collect()))
    for k in range(2):
        spark.createDataFrame([r for r in rows if r.window_id % 24 // 10 == k or k and r.window_id >= 20], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = debounced_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), **settings)
    query = stream.writeStream.format("memory").queryName(f"emitted_{strict}").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert sorted(map(tuple, spark.table(f"emitted_{strict}").collect())) == batch
    for a, b in zip(batch, batch[1:], strict=False):
        assert a[0] != b[0] or a[2] != b[2] or b[1] - a[1] >= 5
    assert len(batch) >= 4


def test_augmentation(spark):
    rows = spark.createDataFrame([(1, 4, [[1.0], [2.0], [4.0], [8.0]] + [[0.0]] * 8), (2, 1, [[0.5]] + [[0.0]] * 11)], "recording_id long, real_len int, seq array<array<double>>")
    warped = {(r.recording_id, r.factor): (r.real_len, [x[0] for x in r.seq]) for r in augment.time_warp(rows, 12, 1).collect()}
    assert warped[1, 0.7][0] == 3 and warped[1, 0.7][1] == pytest.approx([1, 3, 8] + [0] * 9)
    assert warped[2, 1.3] == (1, [0.5] + [0.0] * 11)
    shifted = {r.shift: (r.real_len, [x[0] for x in r.seq]) for r in augment.temporal_shift(rows.where("recording_id = 1"), 12, 1).collect()}
    assert shifted[5] == (4, [0.0] * 5 + [1, 2, 4, 8] + [0.0] * 3) and shifted[10] == (2, [0.0] * 10 + [1, 2]) and shifted[-5] == (0, [0.0] * 12)
    assert augment.augmented(rows, 12, 1, 1).count() == 256
    noisy = augment.flex_noise(rows, 1).where("recording_id = 2").first().seq
    assert 0 < abs(noisy[0][0] - 0.5) < 0.1 and noisy[1:] == [[0.0]] * 11
    dropped = augment.frame_dropout(rows, 1).orderBy("recording_id").collect()
    assert 1 <= [x[0] for x in dropped[0].seq[:4]].count(0.0) <= 3 and dropped[1].seq[0] == [0.5]


def test_models(spark):
    rng = np.random.default_rng(5)
    data = [(i, i % 3, (rng.normal(0, 0.3, 2) + [i % 3, -(i % 3)]).tolist()) for i in range(90)]
    rows = spark.createDataFrame(data, "id long, class_id long, v array<double>").cache()
    some = models.vectors(rows)
    fitted = models.logistic(90).fit(some)
    probs = models.probabilities(fitted.transform(some))
    own = rows.withColumnRenamed("class_id", "rows_class")
    said = neighbours.decided(probs).join(own, "id")
    assert said.where("predicted = rows_class").count() > 85
    boosted = models.adaboost(rows, 3, rounds=4, depth=2)
    assert neighbours.decided(models.ensemble_votes(rows, boosted)).join(own, "id").where("predicted = rows_class").count() > 80
    uneven = rows.where("class_id > 0 or id < 30")
    grown = models.smote(uneven)
    counts = {r.class_id: r["count"] for r in grown.groupBy("class_id").count().collect()}
    assert counts[0] > 20 and counts[1] == 30 and grown.where("id is not null").count() == uneven.count()
    assert models.undersampled(uneven).count() < uneven.count()
    bayes = neighbours.decided(neighbours.softmax(neighbours.bayes_scores(rows, neighbours.bayes_fit(rows)))).join(own, "id")
    assert bayes.where("predicted = rows_class").count() > 85
    slot = models.model_slot(rows, lambda: lambda xs: [[float(x[0] > 1), 0.0] for x in xs])
    assert slot.count() == 90


def test_metrics(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, predicted int")
    report = {r.class_id: r for r in metrics.class_report(rows).collect()}
    assert report[1].precision == pytest.approx(1 / 3) and report[1].recall == 1 and report[2].f1 == 0 and report[0].support == 2
    assert metrics.summary(rows).first().accuracy == 0.5
    matrix = {r.y: r.asDict() for r in metrics.confusion_matrix(rows, [0, 1, 2]).collect()}
    assert matrix[0]["1"] == 1 and matrix[2]["2"] == 0
    log = spark.createDataFrame([(e, v) for e, v in enumerate([3.0, 1.0, 2.0, 2.0, 0.5])], "epoch int, val_loss double")
    assert tuple(metrics.stop_epoch(log, 2).first()) == (1, 3) and tuple(metrics.stop_epoch(log, 10).first()) == (4, None)


def test_splits(spark):
    raw = spark.createDataFrame([(i, i % 3) for i in range(300)], "recording_id long, label int")
    parts = {r.part: r["count"] for r in prep.three_way(raw).groupBy("part").count().collect()}
    assert parts == {"train": 210, "validation": 45, "test": 45}
    each = {(r.label, r.part): r["count"] for r in prep.three_way(raw).groupBy("label", "part").count().collect()}
    assert {each[k, "train"] for k in range(3)} == {70} and {each[k, "test"] for k in range(3)} == {15}
    both = prep.with_copies(prep.three_way(raw), raw.select("recording_id", "label"))
    assert both.where("is_copy and part != 'train'").count() == 0 and both.where("is_copy").count() == parts["train"]
    assert prep.split_by_hash(raw, "recording_id").where("is_test").count() < 100


def test_scaler_is_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 2.0, -i / 3]) for i in range(9)], "id long, v array<double>")
    fitted = prep.scaler(rows, "v")
    prep.write_scaler(fitted, str(tmp_path / "scaler"))
    again = prep.scaled(rows, prep.read_scaler(spark, str(tmp_path / "scaler")), "v")
    assert sorted(again.collect()) == sorted(prep.scaled(rows, fitted, "v").collect())


def test_nearest_by_warping(spark):
    """The combined distance of the expression form, over all pairs."""
    rng = np.random.default_rng(6)
    data = [(i, i % 3, np.round(rng.random(14), 3).tolist()) for i in range(40)]
    rows = spark.createDataFrame(data, "id long, class_id long, v array<double>")
    got = {(r.id, r["rank"]): (r.neighbour, r.distance) for r in neighbours.nearest_warped(rows.where("id < 6"), rows.where("id >= 6"), 3, [5, 5]).collect()}
    parts = lambda c: (F.array(F.slice(c, 1, 5), F.slice(c, 6, 5)), F.slice(c, 11, 4))
    (ca, pa_), (cb, pb) = parts("v"), parts("w")
    pairs = rows.where("id < 6").crossJoin(rows.where("id >= 6").select(F.col("id").alias("other"), F.col("v").alias("w")))
    want = {}
    for r in pairs.select("id", "other", S.combined_distance(ca, cb, pa_, pb).alias("d")).collect():
        want.setdefault(r.id, []).append((round(r.d, 9), r.other))
    for i, some in want.items():
        for k, (d, other) in enumerate(sorted(some)[:3]):
            assert got[i, k + 1] == (other, pytest.approx(d, abs=1e-8))


def test_exemplars_too_long_to_ship_are_refused(spark, monkeypatch):
    rows = spark.createDataFrame(recording(85), SCHEMA)
    assert features.exemplars(rows, 40, pads=2).count() == 1 and features.exemplar_frames(rows, 40, pads=2).count() == 85
    monkeypatch.setattr(features, "MOST_FRAMES", 84)
    with pytest.raises(ValueError, match="too long"):
        features.exemplars(rows, 40, pads=2)


def test_warping_neighbours_skip_what_bounds_rule_out():
    """Same neighbours as over all pairs, bounds that hold, and a part of the pairs only."""
    rng = np.random.default_rng(8)
    level = rng.normal(0, 2, (400, 1))
    t = np.concatenate([level + rng.normal(0, 0.3, (400, 12)), -level + rng.normal(0, 0.3, (400, 5)), rng.integers(0, 3, (400, 2))], axis=1)
    measure, ids, done = neighbours.Warped([12, 5]), rng.permutation(400), 0
    for x in t[:40]:
        every = np.round(measure(x, t), 9)
        assert (measure.bounds(x, t) <= every + 1e-9).all()
        best, d, n = neighbours.closest(x, t, ids, 5, measure)
        want = np.lexsort((ids, every))[:5]
        assert best.tolist() == want.tolist() and d.tolist() == every[want].tolist()
        done += n
    assert done < 0.5 * 40 * 400
    same = np.zeros((300, 19))
    best, d, _ = neighbours.closest(same[0], same, np.arange(300)[::-1], 3, measure)
    assert best.tolist() == [299, 298, 297] and d.tolist() == [0, 0, 0]


def test_warping_neighbours_by_cells_of_equal_pads(spark, monkeypatch):
    """Same neighbours as over all pairs: cells of many rows and of few, copies of vectors, ties, several blocks and shards."""
    for name, value in {"BLOCK": 20, "SHARD": 30, "WIDE_BLOCK": 25, "WIDE_SHARD": 60}.items():
        monkeypatch.setattr(neighbours, name, value, raising=False)
    rng = np.random.default_rng(12)
    v = np.concatenate([rng.random((260, 9)), rng.choice([0, 1, 2], (260, 2), p=[0.8, 0.15, 0.05])], axis=1)
    v[200:] = v[rng.integers(0, 200, 60)]
    v[250:, 9:] = [[7, 0.5]]
    ids = rng.permutation(1000)[:260]
    rows = spark.createDataFrame([(int(i), int(i) % 4, x.tolist(), n % 4 == 0) for n, (i, x) in enumerate(zip(ids, v, strict=True))], "id long, class_id long, v array<double>, is_test boolean")
    got = {(r.id, r["rank"]): (r.neighbour, r.class_id, r.distance) for r in neighbours.nearest_warped(rows.where("is_test"), rows.where("not is_test"), 5, [6, 3]).collect()}
    test = np.arange(260) % 4 == 0
    measure, tid = neighbours.Warped([6, 3]), ids[~test]
    assert len(got) == 5 * test.sum()
    for i, x in zip(ids[test], v[test], strict=True):
        d = np.round(measure(x, v[~test]), 9)
        for rank, j in enumerate(np.lexsort((tid, d))[:5]):
            assert got[i, rank + 1] == (tid[j], tid[j] % 4, d[j])


def test_pads_rule_out_pairs_before_they_are_warped(monkeypatch):
    rng = np.random.default_rng(13)
    t = np.concatenate([rng.random((2000, 40)), rng.integers(0, 4, (2000, 3))], axis=1)
    measure, count = neighbours.Warped([40]), []
    whole = measure.of_pairs
    monkeypatch.setattr(measure, "of_pairs", lambda a, b: count.append(len(a)) or whole(a, b))
    rows, columns, d = neighbours.searched(t[:50], t, np.arange(2000), 5, measure, lambda a, b: np.ones((b - a, 2000), bool), np.full(50, np.inf))
    assert sum(count) < 0.03 * 50 * 2000
    for i in range(50):
        every = np.round(measure(t[i], t), 9)
        want = np.lexsort((np.arange(2000), every))[:5]
        assert columns[rows == i].tolist() == want.tolist() and d[rows == i].tolist() == every[want].tolist()


def test_copies_in_numpy_are_those_of_the_expressions(spark):
    """All copies, also of recordings of few frames, two channels, and names so long that messages take two blocks."""
    rng = np.random.default_rng(14)
    names = ["a", "b" * 60, "c" * 45, None, "e", "f"]
    rows = [(name, n, [[float(x) if t < n else 0.0 for x in rng.random(2)] for t in range(12)]) for name, n in zip(names, (12, 9, 4, 3, 1, 0), strict=True)]
    table = spark.createDataFrame(rows, "recording_id string, real_len int, seq array<array<double>>")
    of = lambda seq: seq.sum(axis=(1, 2))
    value = {(r.path, r.repeat): r.value for r in augment.augmented(table, 12, 2, 1, 2, of=of).collect()}
    got, want = ({(r.path, r.repeat): (r.recording_id, r.real_len, r.seq) for r in augment.augmented(table, 12, 2, 1, 2, given).collect()} for given in (None, augment.TRANSFORMS))
    assert len(got) == 6 * 2 * 16 and set(got) == set(want) == set(value)
    for key, (name, n, seq) in want.items():
        assert got[key][:2] == (name, n) and np.allclose(got[key][2], seq, rtol=0, atol=1e-12)
        assert value[key] == pytest.approx(np.sum(seq))
