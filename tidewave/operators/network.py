"""The two-branch classifier's forward pass in numpy, for inference over window features in Spark.

Weights are a dict of arrays (see `shapes`), trained elsewhere or seeded; a
batch of windows is scored per Arrow batch, the weights go along with the tasks
(about 2 MB). Training needs a deep learning library and is out of scope;
`operators.model` trains the heads alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .metrics import argmax

WIDTH, HEADS, FRAMES, BINS, RECEIVERS = 80, 4, 28, 128, 3
#: (kernel, dilation) of the two blocks of each branch.
BLOCKS = {"amp": ((7, 2), (7, 4)), "dfs": ((5, 1), (5, 2))}
#: (channels in, out, groups of the norm, kernel, stride along bins) of the spectrogram's convolutions.
CONVOLUTIONS = ((1, 16, 4, (3, 5), 1), (16, 32, 8, (3, 3), 2), (32, 48, 8, (3, 3), 2))


def shapes(bins: int = 52, antennas: int = 4, length: int = 350) -> dict[str, tuple[int, ...]]:
    """Name -> shape of every weight; dense layers are (in, out)."""
    d, out = WIDTH, {}

    def dense(name, i, o):
        out[name + ".w"], out[name + ".b"] = (i, o), (o,)

    def norm(name, n=d):
        out[name + ".g"], out[name + ".b"] = (n,), (n,)

    def attention(name):
        for part in "qkvo":
            dense(f"{name}.{part}", d, d)

    dense("amp.ant1", antennas, antennas), dense("amp.ant2", antennas, 1), dense("amp.proj", bins, d), norm("amp.norm")
    for i, (c_in, c_out, _, (kh, kw), _) in enumerate(CONVOLUTIONS):
        out[f"dfs.conv{i}.w"], out[f"dfs.conv{i}.b"] = (kh, kw, c_in, c_out), (c_out,)
        norm(f"dfs.gn{i}", c_out)
    dense("dfs.proj", CONVOLUTIONS[-1][1] * BINS // 4, d), norm("dfs.norm")
    for branch, n in (("amp", length), ("dfs", FRAMES)):
        out[f"{branch}.time"], out[f"{branch}.receiver"] = (n, d), (RECEIVERS, d)
        for i, (k, _) in enumerate(BLOCKS[branch]):
            at = f"{branch}.block{i}"
            for j in range(3):
                norm(f"{at}.norm{j}")
            out[f"{at}.dw.w"], out[f"{at}.dw.b"] = (k, d), (d,)
            dense(f"{at}.pw", d, d), attention(f"{at}.attn"), dense(f"{at}.ffn1", d, 2 * d), dense(f"{at}.ffn2", 2 * d, d)
    norm("fuse.amp"), norm("fuse.dfs"), norm("fuse.out"), attention("fuse.attn")
    out["fuse.gate"] = (1,)
    dense("receivers", d * RECEIVERS, RECEIVERS)
    out["slow.w"], out["slow.b"] = (5, d), (d,)
    dense("read1", 3 * d, 2 * d), dense("read2", 2 * d, d)
    dense("occ", d, 1), dense("dyn", d, 1), dense("act", d, 6)
    return out


def parameters(**size) -> int:
    return sum(math.prod(s) for s in shapes(**size).values())


def seeded(seed: int = 42, **size) -> dict[str, np.ndarray]:
    """Untrained weights: gains 1, biases 0, the gate -2, the rest normal with variance 1 / inputs."""
    rng, out = np.random.default_rng(seed), {}
    for name, shape in shapes(**size).items():
        if name.endswith(".g"):
            out[name] = np.ones(shape)
        elif name.endswith(".b"):
            out[name] = np.zeros(shape)
        elif name == "fuse.gate":
            out[name] = np.full(shape, -2.0)
        else:
            scale = 0.02 if name.endswith((".time", ".receiver")) else math.prod(shape[:-1]) ** -0.5
            out[name] = rng.normal(0, scale, shape)
    return out


def erf(x: np.ndarray) -> np.ndarray:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


def gelu(x: np.ndarray) -> np.ndarray:
    return x * (1 + erf(x / math.sqrt(2))) / 2


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Network:
    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    def dense(self, name, x):
        return x @ self.w[name + ".w"] + self.w[name + ".b"]

    def norm(self, name, x):
        x = x - x.mean(-1, keepdims=True)
        return x / np.sqrt((x * x).mean(-1, keepdims=True) + 1e-5) * self.w[name + ".g"] + self.w[name + ".b"]

    def depthwise(self, name, x, dilation=1):
        """Along axis 1, same length."""
        w = self.w[name + ".w"]
        reach = dilation * (len(w) - 1)
        p = np.pad(x, ((0, 0), (reach // 2, reach - reach // 2), (0, 0)))
        return sum(p[:, i * dilation : i * dilation + x.shape[1]] * w[i] for i in range(len(w))) + self.w[name + ".b"]

    def attention(self, name, q, kv):
        def heads(x):
            return x.reshape(*x.shape[:2], HEADS, -1).transpose(0, 2, 1, 3)

        q, k, v = heads(self.dense(name + ".q", q)), heads(self.dense(name + ".k", kv)), heads(self.dense(name + ".v", kv))
        a = softmax(q @ k.swapaxes(-1, -2) / math.sqrt(q.shape[-1])) @ v
        return self.dense(name + ".o", a.transpose(0, 2, 1, 3).reshape(len(a), -1, WIDTH))

    def block(self, name, x, dilation):
        x = x + self.dense(name + ".pw", self.depthwise(name + ".dw", self.norm(name + ".norm0", x), dilation))
        n = self.norm(name + ".norm1", x)
        x = x + self.attention(name + ".attn", n, n)
        return x + self.dense(name + ".ffn2", gelu(self.dense(name + ".ffn1", self.norm(name + ".norm2", x))))

    def encoded(self, branch, x, rx):
        x = x + self.w[branch + ".time"][: x.shape[1]] + self.w[branch + ".receiver"][rx]
        for i, (_, dilation) in enumerate(BLOCKS[branch]):
            x = self.block(f"{branch}.block{i}", x, dilation)
        return x

    def amplitude(self, x, rx):
        """(B, T, F, A) -> (B, T, D)"""
        h = self.dense("amp.ant2", gelu(self.dense("amp.ant1", x)))[..., 0]
        return self.encoded("amp", self.norm("amp.norm", self.dense("amp.proj", h)), rx)

    def convolved(self, i, x):
        """(B, T, V, C) with a normed and gated convolution, zeros beyond the edges."""
        _, _, groups, (kh, kw), stride = CONVOLUTIONS[i]
        p = np.pad(x, ((0, 0), (kh // 2, kh // 2), (kw // 2, kw // 2), (0, 0)))
        near = np.lib.stride_tricks.sliding_window_view(p, (kh, kw), (1, 2))[:, :, ::stride]
        y = np.einsum("btvcij,ijco->btvo", near, self.w[f"dfs.conv{i}.w"], optimize=True) + self.w[f"dfs.conv{i}.b"]
        g = y.reshape(*y.shape[:3], groups, -1)
        g = g - g.mean((1, 2, 4), keepdims=True)
        g = g / np.sqrt((g * g).mean((1, 2, 4), keepdims=True) + 1e-5)
        return gelu(g.reshape(y.shape) * self.w[f"dfs.gn{i}.g"] + self.w[f"dfs.gn{i}.b"])

    def doppler(self, x, rx):
        """(B, 28, 128) -> (B, 28, D); channels are flattened before bins."""
        h = x[..., None]
        for i in range(len(CONVOLUTIONS)):
            h = self.convolved(i, h)
        h = h.transpose(0, 1, 3, 2).reshape(*h.shape[:2], -1)
        return self.encoded("dfs", self.norm("dfs.norm", self.dense("dfs.proj", h)), rx)

    def fused(self, amp, dfs):
        gate = 1 / (1 + np.exp(-self.w["fuse.gate"]))
        return self.norm("fuse.out", amp + gate * self.attention("fuse.attn", self.norm("fuse.amp", amp), self.norm("fuse.dfs", dfs)))

    def readout(self, z):
        n = (z.shape[1] - 5) // 4 + 1
        blurred = sum(c * z[:, i : i + 4 * n : 4][:, :n] for i, c in enumerate((1, 4, 6, 4, 1))) / 16
        streams = [z.mean(1), (z * z).mean(1), self.depthwise("slow", blurred).mean(1)]
        return self.dense("read2", gelu(self.dense("read1", np.concatenate(streams, -1))))

    def forward(self, amp: np.ndarray, dfs: np.ndarray) -> np.ndarray:
        """amp (B, M, T, F, A), dfs (B, M, 28, 128) -> (B, 8) probabilities."""
        z = [self.fused(self.amplitude(amp[:, m], m), self.doppler(dfs[:, m], m)) for m in range(amp.shape[1])]
        alpha = softmax(self.dense("receivers", np.concatenate([x.mean(1) for x in z], -1)))
        r = self.readout(sum(alpha[:, m, None, None] * x for m, x in enumerate(z)))
        occ, dyn = (1 / (1 + np.exp(-self.dense(name, r))) for name in ("occ", "dyn"))
        return np.concatenate([occ * dyn * softmax(self.dense("act", r)), occ * (1 - dyn), 1 - occ], -1)


def predictions(windows: DataFrame, weights: dict[str, np.ndarray], bins: int, antennas: int = 4, length: int = 350) -> DataFrame:
    """windows (recording_id, window_idx, rx, amplitude, doppler) -> recording_id, window_idx, probs, pred; windows without all receivers are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, net, rows = pdf.sort_values("rx"), Network(weights), []
        for at, own in pdf.groupby("window_idx"):
            if len(own) == RECEIVERS:
                amp = np.stack(own["amplitude"]).reshape(1, RECEIVERS, length, bins, antennas).astype(float)
                dfs = np.stack(own["doppler"]).reshape(1, RECEIVERS, FRAMES, BINS).astype(float)
                rows.append((own["recording_id"].iloc[0], at, net.forward(amp, dfs)[0]))
        return pd.DataFrame(rows, columns=["recording_id", "window_idx", "probs"])

    # a group is one recording's windows
    out = windows.groupBy("recording_id").applyInPandas(run, "recording_id string, window_idx int, probs array<double>")
    return out.withColumn("pred", argmax(out["probs"]))
