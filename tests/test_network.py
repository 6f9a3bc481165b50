import math

import numpy as np
from pyspark.sql import functions as F

from tidewave.operators import network as N


def test_parameter_count():
    assert N.parameters() == 494_037


def test_gelu():
    x = np.linspace(-4, 4, 41)
    assert np.allclose(N.gelu(x), [v * (1 + math.erf(v / 2**0.5)) / 2 for v in x], atol=1e-6)


def test_convolution_and_norms_by_hand():
    net = N.Network(N.seeded(1))
    x = np.random.default_rng(0).normal(size=(1, 4, 6, 1))
    w, out = net.w["dfs.conv0.w"], net.convolved(0, x)
    p = np.pad(x[0, :, :, 0], ((1, 1), (2, 2)))
    y = np.array([[[(p[t : t + 3, v : v + 5] * w[:, :, 0, o]).sum() for o in range(16)] for v in range(6)] for t in range(4)])
    g = y[:, :, :4]
    want = N.gelu((g - g.mean()) / np.sqrt(g.var() + 1e-5))
    assert np.allclose(out[0, :, :, :4], want)
    assert net.convolved(1, out).shape == (1, 4, 3, 32)


def test_attention_of_equal_keys_is_their_mean():
    net = N.Network(N.seeded(2))
    kv = np.tile(np.random.default_rng(1).normal(size=(1, 1, 80)), (1, 5, 1))
    a = net.attention("fuse.attn", np.random.default_rng(2).normal(size=(1, 3, 80)), kv)
    want = net.dense("fuse.attn.o", net.dense("fuse.attn.v", kv[:, :1]))
    assert np.allclose(a, np.tile(want, (1, 3, 1)))


def test_predictions_are_probabilities(spark):
    rng = np.random.default_rng(3)
    rows = [("r", w, rx, rng.normal(size=350 * 6 * 4).tolist(), rng.normal(size=28 * 128).tolist()) for w in range(2) for rx in range(3 if w else 2)]
    df = spark.createDataFrame(rows, "recording_id string, window_idx int, rx int, amplitude array<float>, doppler array<float>")
    out = N.predictions(df, N.seeded(4, bins=6), bins=6).collect()
    assert [r.window_idx for r in out] == [1] and abs(sum(out[0].probs) - 1) < 1e-9 and out[0].pred == int(np.argmax(out[0].probs))
    assert df.where(F.size("doppler") != 28 * 128).isEmpty()
