"""Filters over pieces of tracks against the recurrence over whole ones."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.operators import filters


def recurrence(sos, x):
    lead = 3 * (2 * len(sos) + 1)
    return K.zero_phase(np.array(sos), x, lead) if len(x) > lead else [None] * len(x)


@pytest.mark.parametrize("kind,length,width", [("low", 256, None), ("low", 7, 50.0), ("band", 64, 11.0), ("band", 1, None)])
def test_pieces_equal_the_recurrence(spark, kind, length, width):
    rng = np.random.default_rng(3)
    sos = filters.butterworth_sections(kind)
    data = {k: 5 + rng.normal(size=n).cumsum() for k, n in (("a", 700 if length > 1 else 90), ("b", 28), ("c", 27), ("d", 1), ("e", 16), (None, 60))}
    rows = [(k, i * 0.5, float(v)) for k, x in data.items() for i, v in enumerate(x)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t double, v double").repartition(5)
    got = sorted(((r.k, r.t, r.filtered) for r in filters.zero_phase(df, ["k"], "t", "v", sos, width=width, length=length).collect()), key=repr)
    want = sorted(((k, i * 0.5, y) for k, x in data.items() for i, y in enumerate(recurrence(sos, x))), key=repr)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert (g[2] is None) == (w[2] is None) and (w[2] is None or g[2] == pytest.approx(w[2], rel=1e-9, abs=1e-9))


def test_a_long_track(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=30_000) + np.sin(np.arange(30_000) / 9)
    df = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "k int, i long, v double").repartition(8)
    for kind in ("low", "band"):
        sos = filters.butterworth_sections(kind)
        out = filters.zero_phase(df, ["k"], "i", "v", sos, width=1000.0, length=512).orderBy("i").select("filtered").toPandas()["filtered"]
        assert np.abs(out.to_numpy() - recurrence(sos, x)).max() < 1e-8


def test_no_rows_and_ties(spark):
    sos = filters.butterworth_sections("low")
    none = spark.createDataFrame([], "k int, t double, v double")
    assert filters.zero_phase(none, ["k"], "t", "v", sos).collect() == []
    ties = spark.range(40).select(F.lit(1).alias("k"), F.lit(0.0).alias("t"), "id", F.sin("id").alias("v"))
    out = filters.zero_phase(ties, ["k"], "t", "v", sos, order=("id",)).orderBy("id").collect()
    assert [r.filtered for r in out] == pytest.approx(list(recurrence(sos, np.sin(np.arange(40)))), abs=1e-9)


def test_the_sections_have_the_closed_form_gain():
    """Both the library's and the oracle's band-pass: 1 / (1 + ((W^2 - W0^2) / (B W))^8) at W = tan(pi f / rate)."""
    from tidewave.plans.queries_tracks import BAND

    f = np.array([0.1, 0.5, 0.7, 2, 6.3, 20, 50, 79, 80, 90, 120, 170])
    w, lo, hi = (np.tan(np.pi * x / 350) for x in (f, 0.5, 80.0))
    want = 1 / (1 + ((w * w - lo * hi) / ((hi - lo) * w)) ** 8)
    z = np.exp(-2j * np.pi * f / 350)
    for sections in (filters.butterworth_sections("band"), [[float(x) for x in s] for s in BAND]):
        h = np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, a1, a2 in sections], axis=0)
        assert np.abs(h) ** 2 == pytest.approx(want, rel=1e-6, abs=1e-12)
