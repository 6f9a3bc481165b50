"""The preprocessing pipeline from packets to window features, over all folds at once.

Tracks (recording, receiver) are the unit of work: each is cleaned, aligned and
resampled by numpy in one group of bounded size; folds, windows and statistics
are relational. Frames are written once and shared by all folds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..operators import split, stats
from ..operators.clean import outliers
from ..sources import folds

FRAME = "recording_id string, t_idx int, rx int, re array<double>, im array<double>"


def cleaned(h: np.ndarray) -> np.ndarray | None:
    """Gain-normalised, outliers repaired; None if over half of the packets of an antenna are bad. h: (T, F, A)."""
    gain = np.abs(h).mean(1)
    safe = np.where(gain > gain.max() * 1e-3, gain, 1.0)
    h = h / (safe[:, None] + 1e-8)
    for a in range(h.shape[2]):
        first = np.zeros(len(h), int)
        _, bad = outliers(np.abs(h[:, :, a]).mean(1), first, first + len(h) - 1)
        if bad.mean() > 0.5:
            return None
        good = np.flatnonzero(~bad)
        if bad.any() and len(good) >= 4:
            both = np.hstack([h[good, :, a].real, h[good, :, a].imag])
            fixed = K.pchip(good.astype(float), both, np.flatnonzero(bad).astype(float))
            f = h.shape[1]
            h[bad, :, a] = fixed[:, :f] + 1j * fixed[:, f:]
    return h


def lag_of(reference: np.ndarray, other: np.ndarray, rate: float) -> float:
    """Seconds that the other envelope (T,) lags behind."""
    x, y = reference - reference.mean(), other - other.mean()
    return (int(np.correlate(y, x, "full").argmax()) - (len(x) - 1)) / rate


def uniform_frames(packets: DataFrame, rate: float = 350.0, receivers: int = 3, antennas: int = 4, sign: int = 1, max_lag: float = 0.5) -> DataFrame:
    """packets (recording_id, rx, ts, ant, re, im) -> frames on each recording's common grid (re, im of bins x antennas).

    A recording is dropped unless all receivers pass. Timestamps move by sign x lag.
    A group is one recording of some seconds, which one task holds.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame(columns=["recording_id", "t_idx", "rx", "re", "im"])
        tracks = {}
        for rx, own in pdf.groupby("rx"):
            wide = own.drop_duplicates(["ts", "ant"]).sort_values(["ts", "ant"])
            times = np.sort(wide["ts"].unique())
            bins = len(wide["re"].iloc[0])
            h = np.zeros((len(times), bins, antennas), complex)
            h[np.searchsorted(times, wide["ts"]), :, wide["ant"]] = np.stack(wide["re"]) + 1j * np.stack(wide["im"])
            h = cleaned(h)
            if h is None:
                return empty
            tracks[rx] = times, h
        if len(tracks) < receivers or min(len(t) for t, _ in tracks.values()) < 4:
            return empty
        first, h0 = tracks[min(tracks)]
        skip = min(350, len(first) // 5)
        top = np.argsort(np.abs(h0).var(axis=(0, 2)) if h0.shape[1] > 1 else [0])[-5:]
        base = np.abs(h0[skip:, top]).mean((1, 2))
        grid = np.arange(first[0], first[-1], 1 / rate)
        out = []
        for rx, (times, h) in sorted(tracks.items()):
            if rx != min(tracks):
                lag = lag_of(base, np.abs(h[skip:, top]).mean((1, 2)), rate)
                if abs(lag) > max_lag:
                    return empty
                times = times + sign * lag
            flat = h.reshape(len(h), -1)
            n = flat.shape[1]
            y = K.pchip(times, np.hstack([flat.real, flat.imag]), grid)
            out.append(pd.DataFrame({"recording_id": pdf["recording_id"].iloc[0], "t_idx": np.arange(len(grid)), "rx": rx, "re": list(y[:, :n]), "im": list(y[:, n:])}))
        return pd.concat(out)

    return packets.groupBy("recording_id").applyInPandas(run, FRAME)


def window_features(frames: DataFrame, references: DataFrame, bins: int, antennas: int = 4, length: int = 350, stride: int = 175, kind: str = "float") -> DataFrame:
    """recording_id, window_idx, rx, amplitude (length x bins x antennas), doppler (frames x 128), shapes flattened row by row.

    references: recording_id, ref (antenna). Windows with NaN are skipped and the rest numbered on. kind: float or double.
    """
    schema = f"recording_id string, window_idx int, rx int, amplitude array<{kind}>, doppler array<{kind}>"
    number = np.float32 if kind == "float" else np.float64

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        h = (np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])).reshape(-1, bins, antennas)
        ref, rows = int(pdf["ref"].iloc[0]), []
        others = [a for a in range(antennas) if a != ref]
        for at in range(0, len(h) - length + 1, stride):
            w = h[at : at + length]
            if not np.isfinite(w).all():
                continue
            rows.append((pdf["recording_id"].iloc[0], len(rows), int(pdf["rx"].iloc[0]), K.amplitude(w).ravel().astype(number), K.doppler(w[:, :, others], w[:, :, ref]).ravel().astype(number)))
        return pd.DataFrame(rows, columns=["recording_id", "window_idx", "rx", "amplitude", "doppler"])

    # references: an int for each recording, joined on the key that the groups shuffle on
    return frames.join(references, "recording_id").groupBy("recording_id", "rx").applyInPandas(run, schema)


def window_summaries(frames: DataFrame, references: DataFrame, bins: int, antennas: int = 4, receivers: int = 3, length: int = 350, stride: int = 175) -> DataFrame:
    """recording_id, window, mean, var (places: receiver, bin, antenna), x (bins): what fold_statistics() takes of each whole window.

    mean and var are of the low-passed magnitude less its median; x is the variance over
    time of the band-passed product with the reference antenna, averaged over receivers and the other antennas.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        h = (np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])).reshape(-1, bins, antennas)
        ref, rows = int(pdf["ref"].iloc[0]), []
        others = [a for a in range(antennas) if a != ref]
        for at in range(0, len(h) - length + 1, stride):
            w = h[at : at + length]
            if np.isfinite(w).all():
                a = K.amplitude(w)
                c = w[:, :, others] * np.conj(w[:, :, ref])[..., None]
                c = np.tensordot(K.filter_matrix("band", length, 350.0), c - c.mean(0), (1, 0))
                rows.append((pdf["recording_id"].iloc[0], at // stride, int(pdf["rx"].iloc[0]), a.mean(0).ravel(), a.var(0).ravel(), np.abs(c).var(0).mean(1)))
        return pd.DataFrame(rows, columns=["recording_id", "window", "rx", "mean", "var", "x"])

    per = frames.join(references, "recording_id").groupBy("recording_id", "rx").applyInPandas(run, "recording_id string, window int, rx int, mean array<double>, var array<double>, x array<double>")
    own = F.array_sort(F.collect_list(F.struct("rx", "mean", "var", "x")))  # one for each receiver
    whole = per.groupBy("recording_id", "window").agg(own.alias("r")).where(F.size("r") == receivers)
    total = F.transform(F.get("r.x", 0), lambda _, i: F.aggregate(F.col("r.x"), F.lit(0.0), lambda s, x: s + F.get(x, i)) / receivers)
    return whole.select("recording_id", "window", F.flatten("r.mean").alias("mean"), F.flatten("r.var").alias("var"), total.alias("x"))


def moments_of(frames: DataFrame, recordings: DataFrame, bins: int, **shape) -> DataFrame:
    """What fit_folds() takes: one pass over all windows; recordings: recording_id, person, label, ref."""
    windows = window_summaries(frames, recordings.select("recording_id", "ref"), bins, **shape)
    return stats.person_moments(windows.join(recordings.select("recording_id", "person", "label"), "recording_id"))


def fit_folds(moments: DataFrame, recordings: DataFrame, bins: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The statistics of every fold from its training persons alone; each reads the moments, and no window, again."""
    return stats.fold_statistics(moments, split.person_ranks(recordings, "person"), bins)


def fold_features(frames: DataFrame, recordings: DataFrame, statistics: tuple[DataFrame, DataFrame, DataFrame], bins: int, antennas: int = 4, length: int = 350, stride: int = 175) -> DataFrame:
    """fold, split, recording_id, person, room, label, ref, window_idx, rx, amplitude, doppler: both branches for all folds.

    The amplitude is in units of the fold's training statistics, the spectrogram of the
    bins that the fold selected. recordings: recording_id, person, room, label, ref.
    """
    zscore, _, selected = statistics
    chosen = selected.groupBy("fold").agg(F.array_sort(F.collect_list("sub")).alias("subs"))  # one bin for each group
    of = split.with_folds(recordings, "person").join(chosen, "fold")
    wanted = of.groupBy("recording_id", "ref").agg(F.collect_list(F.struct("fold", "subs")).alias("folds"))
    schema = "recording_id string, fold int, window_idx int, rx int, amplitude array<double>, doppler array<double>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        h = (np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])).reshape(-1, bins, antennas)
        ref, rows, n = int(pdf["ref"].iloc[0]), [], 0
        others = [a for a in range(antennas) if a != ref]
        for at in range(0, len(h) - length + 1, stride):
            w = h[at : at + length]
            if not np.isfinite(w).all():
                continue
            a = K.amplitude(w).ravel()
            for f in pdf["folds"].iloc[0]:
                subs = list(f["subs"])
                d = K.doppler(w[:, subs][:, :, others], w[:, subs, ref])
                rows.append((pdf["recording_id"].iloc[0], f["fold"], n, int(pdf["rx"].iloc[0]), a, d.ravel()))
            n += 1
        return pd.DataFrame(rows, columns=["recording_id", "fold", "window_idx", "rx", "amplitude", "doppler"])

    raw = frames.join(wanted, "recording_id").groupBy("recording_id", "rx").applyInPandas(run, schema)
    per = bins * antennas
    units = zscore.withColumn("rx", F.floor(F.col("place") / per).cast("int")).groupBy("fold", "rx").agg(F.array_sort(F.collect_list(F.struct("place", "mu", "sigma"))).alias("z"))
    out = raw.join(units, ["fold", "rx"]).withColumn("amplitude", F.transform("amplitude", lambda x, i: ((x - F.get("z.mu", i % per)) / F.get("z.sigma", i % per)).cast("float")))
    out = out.withColumn("doppler", F.transform("doppler", lambda x: x.cast("float"))).drop("z")
    return out.join(of.select("recording_id", "person", "room", "label", "ref", "fold", "split"), ["recording_id", "fold"])


def preprocess(packets: DataFrame, path: str, bins: int, rate: float = 350.0) -> None:
    """From packets (recording_id, person, room, label, rx, ts, ant, re, im) to fold tables and statistics under path.

    Packets are cleaned, aligned and resampled; the reference antenna of each recording is the steadiest of its frames.
    """
    frames = uniform_frames(packets.drop("person", "room", "label"), rate)
    spark = packets.sparkSession
    frames.write.mode("overwrite").parquet(f"{path}/frames")
    frames = spark.read.parquet(f"{path}/frames")
    antenna = frames.select("recording_id", "t_idx", "rx", F.posexplode(F.zip_with("re", "im", lambda a, b: F.sqrt(a * a + b * b))).alias("i", "m"))
    antenna = antenna.select("recording_id", F.concat_ws(":", "t_idx", "rx").alias("time"), (F.col("i") % 4).alias("ant"), "m")
    refs = stats.reference_antenna(antenna, ["recording_id"], "time", "ant", "m").select("recording_id", F.col("ant").cast("int").alias("ref"))
    recordings = packets.select("recording_id", "person", "room", "label").distinct().join(refs, "recording_id")
    recordings.write.mode("overwrite").parquet(f"{path}/recordings")  # a row for each recording, read by all that follows
    recordings = spark.read.parquet(f"{path}/recordings")
    folds.write_statistics(spark, f"{path}/statistics", moments=moments_of(frames, recordings, bins))
    moments = folds.read_statistics(spark, f"{path}/statistics", "moments")
    folds.write_statistics(spark, f"{path}/statistics", **dict(zip(("zscore", "fisher", "selected"), fit_folds(moments, recordings, bins))))
    statistics = tuple(folds.read_statistics(spark, f"{path}/statistics", name) for name in ("zscore", "fisher", "selected"))
    folds.write_fold(fold_features(frames, recordings, statistics, bins), f"{path}/folds")


def synthetic_packets(spark, persons: int = 3, repetitions: int = 1, seconds: float = 5.0, rate: float = 350.0, bins: int = 52, seed: int = 42) -> DataFrame:
    """Moving reflectors: a class's Doppler tone on every antenna with gain jitter and noise; ts jitters and some packets are lost."""
    # Doppler frequency of each class in Hz.
    tones = (1.5, 5.0, 1.0, 1.0, 0.8, 3.0, 0.3, 0.05)
    units = spark.range(persons * len(tones) * repetitions * 3)

    def run(batches):
        for pdf in batches:
            for i in pdf["id"]:
                rx, rest = int(i % 3), int(i // 3)
                cls, person = rest % len(tones), rest // len(tones) % persons
                name = f"p{person}-c{cls}-r{rest // len(tones) // persons}"
                rng = np.random.default_rng([seed, int(i)])
                t = np.arange(0, seconds, 1 / rate) + rng.uniform(0, 0.2 / rate, int(np.ceil(seconds * rate)))
                t = t[rng.random(len(t)) > 0.02]
                phase = 2 * np.pi * tones[cls] * t[:, None] + np.linspace(0, 1, bins)
                for ant in range(4):
                    h = (1 + 0.5 * np.exp(1j * (phase + ant))) * rng.uniform(0.8, 1.2, (len(t), 1)) + 0.05 * (rng.normal(size=(len(t), bins)) + 1j * rng.normal(size=(len(t), bins)))
                    yield pd.DataFrame({"recording_id": name, "person": f"p{person}", "label": cls, "rx": rx, "ts": t, "ant": ant, "re": list(h.real), "im": list(h.imag)})

    return units.repartition(units.sparkSession.sparkContext.defaultParallelism).mapInPandas(run, "recording_id string, person string, label int, rx int, ts double, ant int, re array<double>, im array<double>")
