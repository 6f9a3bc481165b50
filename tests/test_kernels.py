"""Closed forms of the numpy kernels and of operators that SQL does not express."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import arrays as A
from tidewave.functions import kernels as K
from tidewave.operators import align, augment, clean, metrics, model, split, stats
from tidewave.plans import preprocess
from tidewave.sources.arrays import array_recordings
from tidewave.sources import capture, folds


def gain_at(z, p, k, hz, fs=350.0):
    w = np.exp(2j * np.pi * hz / fs)
    return abs(k * np.prod(w - z) / np.prod(w - p))


def test_butterworth_edges():
    z, p, k = K.butterworth(4, (30.0,), 350.0)
    assert gain_at(z, p, k, 30.0) == pytest.approx(2**-0.5, abs=1e-9)
    assert gain_at(z, p, k, 0.0) == pytest.approx(1, abs=1e-9)
    z, p, k = K.butterworth(4, (0.5, 80.0), 350.0)
    assert len(p) == 8 and all(gain_at(z, p, k, e) == pytest.approx(2**-0.5, abs=1e-6) for e in (0.5, 80.0))


def test_zero_phase_passes_and_stops():
    t = np.arange(350) / 350
    low = K.filter_matrix("low", 350)
    slow, fast = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 100 * t)
    assert np.abs(low @ slow - slow)[40:-40].max() < 0.01
    assert np.abs(low @ fast)[40:-40].max() < 0.01
    assert np.allclose(low @ np.ones(350), 1)


def test_sections_agree_with_the_transfer_function():
    z, p, k = K.butterworth(4, (0.5, 80.0), 350.0)
    w = np.exp(2j * np.pi * 20 / 350)
    h = np.prod([(b0 + b1 / w + b2 / w**2) / (1 + a1 / w + a2 / w**2) for b0, b1, b2, a1, a2 in K.sections(z, p, k)])
    assert abs(h) == pytest.approx(gain_at(z, p, k, 20.0), rel=1e-9)


def test_pchip_linear_and_no_overshoot():
    x = np.array([0.0, 1, 2.5, 4, 7])
    at = np.linspace(-1, 8, 50)
    assert np.allclose(K.pchip(x, 3 * x + 1, at)[:, 0], 3 * np.clip(at, 0, 7) + 1)
    y = np.array([0.0, 1, 0, 1, 0])
    v = K.pchip(x, y, np.linspace(0, 7, 200))
    assert v.min() >= -1e-12 and v.max() <= 1 + 1e-12


def test_pchip_column_form_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.uniform(0, 20, 15)), rng.normal(size=15)
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(x, y)], "k int, x double, y double")
    got = align.resampled(df, ["k"], "x", "y", 0.37).orderBy("i").collect()
    grid = np.arange(0, len(got)) * 0.37 + x[0]
    assert np.allclose([r.value for r in got], K.pchip(x, y, grid)[:, 0]) and got[-1].grid < x[-1] <= got[-1].grid + 0.37


def test_stft_tone():
    x = np.exp(2j * np.pi * 16 * np.arange(350) / 128)
    s = K.stft(x)
    assert s.shape == (28, 128) and np.allclose(np.abs(s[:, 16]), 1) and np.abs(s[:, 40]).max() < 1e-9


@pytest.mark.parametrize("n,want", [(349, 0), (350, 1), (524, 1), (525, 2), (1749, 8), (1750, 9)])
def test_window_counts(spark, n, want):
    df = spark.range(n).select(F.lit(1).alias("k"), "id", F.col("id").cast("double").alias("v"))
    assert stats.sliding(df, ["k"], "id").select("window_idx").distinct().count() == want


def test_nan_windows_are_renumbered(spark):
    df = spark.range(60).select(F.lit(1).alias("k"), "id", F.when(F.col("id") == 5, float("nan")).otherwise(1.0).alias("v"))
    w = stats.whole_windows(stats.sliding(df, ["k"], "id", 20, 10), ["k"], "v")
    assert [r[0] for r in w.select("window_idx").distinct().orderBy("window_idx").collect()] == [0, 1, 2, 3]


@pytest.mark.parametrize("size,want", [(52, [4] * 13), (30, [3] * 4 + [2] * 9)])
def test_group_sizes(spark, size, want):
    rows = spark.range(size).groupBy(stats.group_of(F.col("id"), size, 13).alias("g")).count().orderBy("g").collect()
    assert [r["count"] for r in rows] == want


def test_best_per_group_takes_the_first_on_ties(spark):
    s = spark.range(52).select(F.col("id").alias("sub"), F.lit(1.0).alias("score"))
    assert [r["sub"] for r in stats.best_per_group(s, "sub", 52).orderBy("grp").collect()] == list(range(0, 52, 4))


@pytest.mark.parametrize("at,bad", [(0, []), (10, [10]), (19, [])])
def test_hampel_spike(spark, at, bad):
    """An end's value is repeated seven times past the edge, so a spike there is its own median."""
    df = spark.range(20).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") == at, 50.0).otherwise(1.0).alias("v"))
    rows = clean.hampel(df, ["k"], "t", "v").orderBy("t").collect()
    assert [r.t for r in rows if r.bad] == bad
    assert [r.t for r in rows if r.dilated] == [i + j for i in bad for j in (-1, 0, 1)]


def test_anchored_groups_split_at_the_anchor(spark):
    ts = [0.0, 0.9, 1.0, 1.01, 1.9, 3.5]
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate(ts)], "k int, t double, i int")
    g = clean.anchored_groups(df, ["k"], "t", F.col("i"), 1.0).orderBy("group_start").collect()
    assert [(r.group_start, r["items"]) for r in g] == [(0.0, [0, 1, 2]), (1.01, [3, 4]), (3.5, [5])]


@pytest.mark.parametrize("delay", [5, -5, 0])
def test_lag_sign(spark, delay):
    x = np.sin(np.arange(100) / 5) * np.hanning(100)
    y = np.roll(x, delay)
    rows = [("a", i, float(v)) for i, v in enumerate(x)] + [("b", i, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "name string, i long, v double")
    got = {r.name: r.lag for r in align.lags(df, [], "name", "i", "v", "a", 20).select(F.col("name"), "lag").collect()}
    assert got == {"a": 0, "b": delay} and preprocess.lag_of(x, y, 1.0) == delay


def test_edges_filled(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 3, 4.0), (1, 4, None), (2, 0, None)], "k int, t int, v double")
    rows = clean.edge_filled(df, ["k"], "t", "v").orderBy("k", "t").collect()
    assert [r.filled for r in rows] == [2.0, 2.0, None, 4.0, 4.0, 0.0]


def test_folds_are_disjoint_and_whole(spark):
    people = spark.createDataFrame([(p,) for p in "abcde"], "person string")
    f = split.subject_folds(people, "person")
    assert f.count() == 25 and f.where("split = 'test'").count() == 5
    assert f.groupBy("fold").agg(F.count_if(F.col("split") == "train").alias("n")).where("n <> 3").isEmpty()
    with pytest.raises(ValueError):
        split.subject_folds(people.limit(2), "person")


def test_probabilities_sum_to_one(spark):
    df = spark.range(50).select(F.array(*(F.randn(i) for i in range(8))).alias("e"))
    p = metrics.composed(A.sigmoid(F.col("e")[0]), A.sigmoid(F.col("e")[1]), A.softmax(F.slice("e", 3, 6)))
    assert df.where(F.abs(A.total(p) - 1) > 1e-9).isEmpty()


def test_calibration_error_drops_full_confidence(spark):
    df = spark.createDataFrame([(1.0, False), (0.95, True)], "confidence double, correct boolean")
    assert metrics.calibration_error(df).first().ece == pytest.approx(0.5 * 0.05)


def test_macro_f1_of_present_classes(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "truth int, pred int")
    assert metrics.macro_f1(metrics.per_class(metrics.confusion(df, 8))).first().macro_f1 == pytest.approx((2 / 3) / 2)


def test_unpack_by_hand():
    word = (1 << 31) | (3 << 22) | (31 << 16) | (5 << 6) | 32
    re, im = capture.unpack(np.array([word], np.uint32))
    assert (re[0], im[0]) == (3 - 512, 10.0)


def test_fold_tables(spark, tmp_path):
    df = spark.range(20).select((F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") < 10, "train").otherwise("test").alias("split"), F.col("id").cast("string").alias("recording_id"))
    folds.write_fold(df, str(tmp_path / "f"))
    folds.write_fold(df.limit(0), str(tmp_path / "f"))  # existing output stays
    assert folds.read_fold(spark, str(tmp_path / "f"), 1, "test").count() == 5
    folds.write_manifest(df, str(tmp_path / "m"), dataset="own")
    assert spark.read.json(str(tmp_path / "m")).where("dataset = 'own' and recordings = 5").count() == 4
    assert folds.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_preprocessing_finds_the_tone(spark):
    packets = preprocess.synthetic_packets(spark, persons=1).where("label in (1, 7)")
    frames = preprocess.uniform_frames(packets.drop("person", "label"))
    refs = frames.select("recording_id").distinct().withColumn("ref", F.lit(0))
    w = preprocess.window_features(frames, refs, 52).where("window_idx = 0").collect()
    assert len(w) == 6 and all(len(r.doppler) == 28 * 128 and np.isfinite(r.doppler).all() for r in w)


def test_weighted_sample_balances(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("label"))
    s = augment.weighted_sample(df, "label", "id", 1)
    assert s.count() == 1000 and 400 < s.where("label = 1").count() < 600
    b = augment.batches(df, "id", 64, 3)
    assert b.count() == 960 and b.groupBy("batch").count().where("count <> 64").isEmpty()


def test_augmentation_is_a_function_of_seed_and_id(spark):
    df = spark.range(20).select("id", F.array(*(F.lit(float(i)) for i in range(40))).alias("v"))
    a, b = (augment.augmented(df.repartition(n), "id", "v", 5).orderBy("id").collect() for n in (1, 4))
    assert a == b and any(r.v != r.augmented for r in a)


def test_log_keeps_its_first_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    folds.append_log(spark.createDataFrame([(0, "train", 1.5)], "epoch int, phase string, loss double"), path)
    folds.append_log(spark.createDataFrame([(1, "val", 9.0)], "epoch int, phase string, f1 double"), path)
    log = spark.read.parquet(path)
    assert sorted(map(tuple, log.collect())) == [(0, "train", 1.5), (1, "val", None)]
    folds.csv_log(log, str(tmp_path / "csv"))
    assert folds.read_log(spark, str(tmp_path / "csv"), "train").count() == 1 and folds.read_log(spark, str(tmp_path / "csv")).count() == 2
    with pytest.warns(UserWarning):
        assert folds.read_summaries(spark, str(tmp_path / "none")) is None


def test_array_files_without_folders(spark):
    files = spark.createDataFrame([("d/S1_walk_2.npy",), ("d/S2_other.npy",), ("d/S3_standing_up_1.mat",), ("d/S4_fall.txt",)], "path string")
    got = {r.recording_id: (r.person, r.class_id) for r in array_recordings(files, split.CLASSES_30, "d").collect()}
    assert got == {"S1_walk_2": ("S1", 0), "S3_standing_up_1": ("S3", 2)}


def test_fold_statistics_against_loops(spark, tmp_path):
    """From packets to fold tables; the statistics are those of the training persons' windows, counted by loops."""
    rng = np.random.default_rng(3)
    bins, rows = 14, []
    for p in range(3):
        for c in range(2):
            for rx in range(3):
                t = np.arange(560) / 350 + rng.uniform(0, 2e-4, 560)
                tone = 1 + (0.2 + 0.3 * c) * np.exp(2j * np.pi * (3 + 4 * c) * t)[:, None] * np.exp(1j * np.linspace(0, 2, bins))
                for ant in range(4):
                    h = tone * np.exp(1j * ant) + 0.02 * (rng.normal(size=(560, bins)) + 1j * rng.normal(size=(560, bins)))
                    rows += [(f"p{p}c{c}", f"p{p}", "room", c, rx, float(a), ant, x.real.tolist(), x.imag.tolist()) for a, x in zip(t, h)]
    packets = spark.createDataFrame(rows, "recording_id string, person string, room string, label int, rx int, ts double, ant int, re array<double>, im array<double>")
    path = str(tmp_path / "out")
    preprocess.preprocess(packets, path, bins)
    windows, refs = {}, {r.recording_id: r.ref for r in folds.read_folds(spark, f"{path}/folds").select("recording_id", "ref").distinct().collect()}
    frames = {}
    for r in spark.read.parquet(f"{path}/frames").orderBy("t_idx").collect():
        frames.setdefault((r.recording_id, r.rx), []).append(np.array(r.re) + 1j * np.array(r.im))
    for rec in refs:
        h = np.stack([np.stack(frames[rec, rx]) for rx in range(3)], 1).reshape(-1, 3, bins, 4)
        for at in range(0, len(h) - 349, 175):
            w = h[at : at + 350]
            low = np.tensordot(K.filter_matrix("low", 350, 350.0), np.abs(w), (1, 0))
            c = w * np.conj(w[..., refs[rec]])[..., None]
            c = np.tensordot(K.filter_matrix("band", 350, 350.0), c - c.mean(0), (1, 0))
            dynamic = np.delete(np.abs(c).var(0), refs[rec], axis=2).mean((0, 2))
            windows.setdefault(rec, []).append((low - np.median(low, 0), dynamic))
    assert len(refs) == 6 and all(len(w) >= 1 for w in windows.values())
    for fold in range(3):
        train = [r for r in refs if int(r[1]) == (fold + 2) % 3]
        own = np.concatenate([a for r in train for a, _ in windows[r]])
        z = {r.place: r for r in folds.read_statistics(spark, f"{path}/statistics", "zscore", fold).collect()}
        assert [z[i].mu for i in range(3 * bins * 4)] == pytest.approx(own.mean(0).ravel().tolist(), abs=1e-9)
        assert [z[i].sigma for i in range(3 * bins * 4)] == pytest.approx((own.std(0) + 1e-8).ravel().tolist(), abs=1e-9)
        x, y = np.array([d for r in train for _, d in windows[r]]), np.array([int(r[3]) for r in train for _ in windows[r]])
        between = sum((y == c).sum() * (x[y == c].mean(0) - x.mean(0)) ** 2 for c in (0, 1))
        score = between / (sum((y == c).sum() * x[y == c].var(0) for c in (0, 1)) + 1e-12)
        want = [int(g[np.argmax(score[g])]) for g in np.array_split(np.arange(bins), 13)]
        chosen = folds.read_statistics(spark, f"{path}/statistics", "selected", fold).orderBy("grp").collect()
        assert [r["sub"] for r in chosen] == want
        out = folds.read_fold(spark, f"{path}/folds", fold, "train").collect()
        assert {r.recording_id for r in out} == set(train)
        r = next(r for r in out if r.window_idx == 0)
        unit = (windows[r.recording_id][0][0] - own.mean(0)) / (own.std(0) + 1e-8)
        assert r.amplitude == pytest.approx(unit[:, r.rx].ravel().tolist(), abs=1e-4) and len(r.doppler) == 28 * 128


def test_leave_one_out_resumes(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, f"p{i % 3}", i % 8, [float((i % 8) == j) + 0.1 * float(rng.normal()) for j in range(8)]) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, person string, truth int, x array<double>")
    path = str(tmp_path / "run")
    out = {r.id: (r.fold, r.pred) for r in model.leave_one_out(df, "person", "id", "x", "truth", path).collect()}
    assert {i: f for i, (f, _) in out.items()} == {i: i % 3 for i in range(240)} and sum(p == i % 8 for i, (_, p) in out.items()) > 200
    again = {r.id: (r.fold, r.pred) for r in model.leave_one_out(df.withColumn("truth", F.lit(0)), "person", "id", "x", "truth", path).collect()}
    assert again == out
    models = model.load(f"{path}/models/1")
    assert {r.id: r.pred for r in model.predict(models, df.where("person = 'p1'"), "x").collect()} == {i: p for i, (f, p) in out.items() if f == 1}


def test_joint_augmentation_draws_noise(spark):
    df = spark.range(300).select("id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("rx"), F.lit(1).alias("ref")).withColumn("ant", F.explode(F.sequence(F.lit(0), F.lit(3))))
    df = df.withColumn("re", F.array_repeat(F.lit(1.0), 20)).withColumn("im", F.array_repeat(F.lit(0.0), 20))
    out = augment.augmented_joint(df, "id", "rx", "ant", "ref", "re", "im", 3, noise=0.01)
    small = out.where(F.abs(F.get("re", 0)) < 0.2)
    assert small.where("ant = 1").select("id", "rx").distinct().groupBy("id").count().where("count > 1").isEmpty()
    share = small.select("id").distinct().count() / 300
    assert 0.2 < share < 0.36  # one antenna with .2, one receiver with .1
    r = small.select(F.explode("im").alias("v")).agg(F.stddev("v").alias("s"), F.avg("v").alias("m")).first()
    assert 0.009 < r.s < 0.012 and abs(r.m) < 0.001
