"""Correlations over every lag, in pieces, against the plain ones over whole series."""

import numpy as np
import pytest

from tidewave.operators import align


def plain(x, r):
    """lag -> score of two dicts place -> value."""
    xm, rm = np.mean(list(x.values())), np.mean(list(r.values()))
    out = {}
    for lag in range(min(x) - max(r), max(x) - min(r) + 1):
        out[lag] = sum((v - xm) * (r[i - lag] - rm) for i, v in x.items() if i - lag in r)
    return out


@pytest.mark.parametrize("piece,bins", [(16, 4), (64, 64), (5, 3), (4096, 64)])
def test_every_lag_of_pieces(spark, piece, bins):
    rng = np.random.default_rng(piece)
    rows, want = [], {}
    for track, (n, offset, delay) in {"u": (150, -40, 90), "v": (61, 1000, -33), None: (20, 0, 3)}.items():
        base = rng.normal(size=n + 400)
        series = {"a": {offset + i: base[200 + i] for i in range(n)}, "b": {offset + 7 + i: base[200 + 7 + i - delay] + 2.0 for i in range(n // 2)}}
        series["c"] = {i: v for i, v in series["b"].items() if i % 5 != 2}  # gaps
        for s, x in series.items():
            rows += [(track, s, i, float(v)) for i, v in x.items()]
            want |= {(track, s, lag): v for lag, v in plain(x, series["a"]).items()}
    df = spark.createDataFrame(rows, "k string, s string, i long, v double").repartition(4)
    got = {(r.k, r.s, r.lag): r.score for r in align.correlations(df, ["k"], "s", "i", "v", "a", piece, bins).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-8) for k in want)


def test_a_lag_beyond_any_limit(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=3000)
    rows = [("a", i, float(base[i])) for i in range(2000)] + [("b", i, float(base[i - 900])) for i in range(900, 2000)] + [("c", i, float(base[i + 700])) for i in range(1300)]
    df = spark.createDataFrame(rows, "s string, i long, v double")
    got = {r.s: (r.lag, r.shift, r.warned, r.rejected) for r in align.full_lags(df, [], "s", "i", "v", "a", rate=1000.0, piece=128).collect()}
    assert got == {"a": (0, 0.0, False, False), "b": (900, 0.9, True, True), "c": (-700, -0.7, True, True)}


def test_within_a_limit_both_agree(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=400)
    df = spark.createDataFrame([(s, i, float(base[i + d])) for s, d in (("a", 0), ("b", 3), ("c", -6)) for i in range(20, 300)], "s string, i long, v double")
    a, b = (sorted(map(tuple, x.collect())) for x in (align.lags(df, [], "s", "i", "v", "a", 10), align.full_lags(df, [], "s", "i", "v", "a")))
    assert a == b


def test_no_reference_no_lags(spark):
    df = spark.createDataFrame([("u", "b", 0, 1.0)], "k string, s string, i long, v double")
    assert align.full_lags(df, ["k"], "s", "i", "v", "a").collect() == []
    assert align.full_lags(df.limit(0), ["k"], "s", "i", "v", "a").collect() == []
