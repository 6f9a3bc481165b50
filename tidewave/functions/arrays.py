"""Array and complex helpers as column expressions; complex vectors are parallel arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def multiply_conjugate(ar: Column, ai: Column, br: Column, bi: Column) -> tuple[Column, Column]:
    """a * conj(b): (re, im) arrays."""
    re = F.zip_with(F.zip_with(ar, br, lambda x, y: x * y), F.zip_with(ai, bi, lambda x, y: x * y), lambda x, y: x + y)
    im = F.zip_with(F.zip_with(ai, br, lambda x, y: x * y), F.zip_with(ar, bi, lambda x, y: x * y), lambda x, y: x - y)
    return re, im


def dft_power(values: Column, n: int) -> Column:
    """|DFT|^2 of real vectors of n samples, a batch of vectors at a time; null vectors stay null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return by_batch(x, lambda m: np.abs(np.fft.fft(m, n, axis=1)) ** 2)

    return run(values)


def filtered(values: Column, matrix: np.ndarray) -> Column:
    """matrix @ vector for each vector, as one product for a batch; null vectors stay null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return by_batch(x, lambda m: m @ matrix.T)

    return run(values)


def by_batch(x: pd.Series, f) -> pd.Series:
    there = x.notna()
    rows = iter(f(np.stack(x[there].to_numpy())) if there.any() else ())
    return pd.Series([next(rows) if t else None for t in there], dtype=object)


def centred_bins(a: Column, n: int) -> Column:
    """The zero frequency moved to the middle."""
    half = (n + 1) // 2
    return F.concat(F.slice(a, half + 1, n - half), F.slice(a, 1, half))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(a)
    e = F.transform(a, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / total(e))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def data_bins(a: Column) -> Column:
    """64 FFT bins to the 52 that carry data: 1..26, then 38..63."""
    return F.concat(F.slice(a, 2, 26), F.slice(a, 39, 26))


def spread_bins(a: Column, size: int, keep: int) -> Column:
    """keep of size bins at equal steps, rounded half to even."""
    return F.transform(F.sequence(F.lit(0), F.lit(keep - 1)), lambda i: F.get(a, F.bround(i * (size - 1) / (keep - 1)).cast("int")))


def padded(a: Column, size: int) -> Column:
    """Cut to, or filled with zeros up to, size."""
    return F.when(F.size(a) >= size, F.slice(a, 1, size)).otherwise(F.concat(a, F.array_repeat(F.lit(0.0), F.greatest(F.lit(size) - F.size(a), F.lit(0)))))


def masked(a: Column, start: int, width: int) -> Column:
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + width), 0.0).otherwise(x))


def shifted(a: Column, by: int) -> Column:
    """Moved right by `by` places, edges repeated."""
    n = F.size(a)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(a, F.least(F.greatest(i - by, F.lit(0)), n - 1)))


def unpacked(word: Column) -> tuple[Column, Column]:
    """(re, im) of a packed 32-bit sample: sign, 9-bit mantissa and 6-bit exponent each."""

    def half(sign: int, mantissa: int, exponent: int) -> Column:
        m = F.shiftright(word, mantissa).bitwiseAND(F.lit(0x1FF))
        m = F.when(F.shiftright(word, sign).bitwiseAND(F.lit(1)) == 1, m - 512).otherwise(m)
        return m * F.pow(F.lit(2.0), F.shiftright(word, exponent).bitwiseAND(F.lit(0x3F)) - 31)

    return half(31, 22, 16), half(15, 6, 0)


def frequency(k: Column, size: int = 128, rate: float = 350.0) -> Column:
    """Hz of the k-th bin of a centred two-sided spectrum."""
    return (k - size // 2) * rate / size


def mean_of(parts: Column) -> Column:
    """The element-wise mean of an array of equally long arrays."""
    return F.transform(F.get(parts, 0), lambda _, i: F.aggregate(parts, F.lit(0.0), lambda s, p: s + F.get(p, i)) / F.size(parts))
