"""Numpy kernels: Butterworth designs, zero-phase filters as matrices, PCHIP, STFT.

Zero-phase filtering with odd extension is linear in its input, so a filter for
a fixed length is one matrix; a window is filtered by one product.
"""

from __future__ import annotations

import functools

import numpy as np


def butterworth(order: int, edges: tuple[float, ...], fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital zeros, poles and gain by the bilinear transform; one edge is a low-pass, two a band-pass."""
    k = np.arange(order)
    poles = -np.exp(1j * np.pi * (2 * k - order + 1) / (2 * order))
    warped = [2 * fs * np.tan(np.pi * e / fs) for e in edges]
    if len(edges) == 1:
        p, z, gain = poles * warped[0], np.zeros(0, complex), warped[0] ** order
    else:
        width, centre = warped[1] - warped[0], np.sqrt(warped[0] * warped[1])
        half = poles * width / 2
        root = np.sqrt(half * half - centre**2)
        p, z, gain = np.concatenate([half + root, half - root]), np.zeros(order, complex), width**order
    fs2 = 2 * fs
    gain *= np.real(np.prod(fs2 - z) / np.prod(fs2 - p))
    zd, pd = (fs2 + z) / (fs2 - z), (fs2 + p) / (fs2 - p)
    return np.concatenate([zd, -np.ones(len(pd) - len(zd))]), pd, float(gain)


def sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    """Second-order rows b0 b1 b2 a1 a2; conjugate poles pair up, zeros are spread in order of nearness."""
    upper = sorted(p[p.imag > 1e-12], key=lambda q: abs(abs(q) - 1))
    real = sorted(p[np.abs(p.imag) <= 1e-12].real)
    pairs = [(q, np.conj(q)) for q in upper] + [(real[i], real[i + 1]) for i in range(0, len(real) - 1, 2)]
    left, rows = list(z.real), []
    for a, b in pairs:
        own = [left.pop(min(range(len(left)), key=lambda i: abs(left[i] - a))) for _ in range(2)]
        rows.append([1, -sum(own), own[0] * own[1], -(a + b).real, (a * b).real])
    rows = np.array(rows[::-1], float)
    rows[0, :3] *= gain
    return rows


def _run(sos: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Filter along axis 0. state: (sections, 2, columns)."""
    for (b0, b1, b2, a1, a2), s in zip(sos, state):
        y = np.empty_like(x)
        s0, s1 = s
        for i, v in enumerate(x):
            y[i] = b0 * v + s0
            s0, s1 = b1 * v - a1 * y[i] + s1, b2 * v - a2 * y[i]
        x = y
    return x


def steady_state(sos: np.ndarray) -> np.ndarray:
    """Section states for a constant input of 1."""
    out, scale = [], 1.0
    for b0, b1, b2, a1, a2 in sos:
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        s1 = b2 - a2 * dc
        out.append([scale * (b1 - a1 * dc + s1), scale * s1])
        scale *= dc
    return np.array(out)


def zero_phase(sos: np.ndarray, x: np.ndarray, lead: int) -> np.ndarray:
    """Forward and backward with an odd extension of `lead` samples, along axis 0."""
    x = np.asarray(x, float)
    flat = x.reshape(len(x), -1)
    ext = np.concatenate([2 * flat[0] - flat[lead:0:-1], flat, 2 * flat[-1] - flat[-2 : -lead - 2 : -1]])
    z = steady_state(sos)[:, :, None]
    y = _run(sos, ext, z * ext[0])
    y = _run(sos, y[::-1], z * y[-1])[::-1]
    return y[lead:-lead].reshape(x.shape)


@functools.cache
def filter_matrix(kind: str, n: int, fs: float = 350.0) -> np.ndarray:
    """The n x n matrix of the zero-phase low-pass (30 Hz) or band-pass (0.5-80 Hz) of order 4."""
    sos = sections(*butterworth(4, (30.0,) if kind == "low" else (0.5, 80.0), fs))
    return zero_phase(sos, np.eye(n), 3 * (2 * len(sos) + 1))


def pchip(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Monotone cubic through knots (along axis 0 of y); beyond them the nearest knot's value."""
    y = np.asarray(y, float).reshape(len(x), -1)
    h, d = np.diff(x)[:, None], np.diff(y, axis=0) / np.diff(x)[:, None]
    m = np.zeros_like(y)
    if len(x) == 2:
        m[:] = d[0]
    else:
        w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
        same = d[1:] * d[:-1] > 0
        safe = np.where(same, d[1:], 1), np.where(same, d[:-1], 1)
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / safe[1] + w2 / safe[0]), 0)

        def end(h0, h1, d0, d1):
            v = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
            v = np.where(np.sign(v) != np.sign(d0), 0, v)
            return np.where((np.sign(d0) != np.sign(d1)) & (np.abs(v) > np.abs(3 * d0)), 3 * d0, v)

        m[0], m[-1] = end(h[0], h[1], d[0], d[1]), end(h[-1], h[-2], d[-1], d[-2])
    at = np.clip(at, x[0], x[-1])
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    u, w = ((at - x[i]) / (x[i + 1] - x[i]))[:, None], h[i]
    return (2 * u**3 - 3 * u**2 + 1) * y[i] + (u**3 - 2 * u**2 + u) * w * m[i] + (3 * u**2 - 2 * u**3) * y[i + 1] + (u**3 - u**2) * w * m[i + 1]


def hann(n: int) -> np.ndarray:
    """Periodic."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def stft(x: np.ndarray, size: int = 128, hop: int = 8) -> np.ndarray:
    """(frames, size) two-sided spectra along axis 0, scaled by the window's sum; only whole frames."""
    w = hann(size)
    frames = np.stack([x[a : a + size] * w.reshape(-1, *[1] * (x.ndim - 1)) for a in range(0, len(x) - size + 1, hop)])
    return np.fft.fft(frames, axis=1) / w.sum()


def doppler(other: np.ndarray, reference: np.ndarray, fs: float = 350.0) -> np.ndarray:
    """(28, 128) log spectrogram of one window of 350 x subcarriers, from the phase-free product with the reference antenna.

    other: (350, F, A'), reference: (350, F). Mean removal, band-pass, mean over
    antennas, STFT, mean power over subcarriers, centred, in dB, scaled robustly.
    """
    c = other * np.conj(reference)[..., None]
    c = c - c.mean(0)
    m = filter_matrix("band", len(c), fs)
    c = np.tensordot(m, c.mean(-1), (1, 0))
    power = (np.abs(stft(c)) ** 2).mean(-1)
    s = 10 * np.log10(np.fft.fftshift(power, axes=1) + 1e-10)
    lo, mid, hi = np.percentile(s, [5, 50, 95])
    return (s - mid) / ((hi - lo) / 2 + 1e-8)


def amplitude(h: np.ndarray, mu: np.ndarray | float = 0.0, sigma: np.ndarray | float = 1.0, fs: float = 350.0) -> np.ndarray:
    """Low-passed magnitudes of one window less their median, in units of the training statistics."""
    a = np.tensordot(filter_matrix("low", len(h), fs), np.abs(h), (1, 0))
    return (a - np.median(a, axis=0) - mu) / sigma
