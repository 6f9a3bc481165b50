"""Time base: lags between receivers, monotone cubic interpolation on a common grid, repair."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tracks


def pchip_slopes(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """df plus x1, y1 (the next knot), slope and slope1 at both knots, after Fritsch and Carlson."""
    order = Window.partitionBy(*by).orderBy(x)
    k = df.withColumn("x1", F.lead(x).over(order)).withColumn("y1", F.lead(y).over(order))
    k = k.withColumn("h", F.col("x1") - F.col(x)).withColumn("d", (F.col("y1") - F.col(y)) / F.col("h"))
    k = k.withColumn("hp", F.lag("h").over(order)).withColumn("dp", F.lag("d").over(order))
    k = k.withColumn("hn", F.lead("h").over(order)).withColumn("dn", F.lead("d").over(order))
    k = k.withColumn("hpp", F.lag("hp").over(order)).withColumn("dpp", F.lag("dp").over(order))
    inner = _inner_slope(F.col("hp"), F.col("h"), F.col("dp"), F.col("d"))

    def end(*names: str) -> Column:
        return _end_slope(*map(F.col, names))

    first = F.when(F.col("dn").isNull(), F.col("d")).otherwise(end("h", "hn", "d", "dn"))
    last = F.when(F.col("dpp").isNull(), F.col("dp")).otherwise(end("hp", "hpp", "dp", "dpp"))
    k = k.withColumn("slope", F.when(F.col("dp").isNull(), first).when(F.col("d").isNull(), last).otherwise(inner))
    return k.withColumn("slope1", F.lead("slope").over(order)).drop("hp", "dp", "hn", "dn", "hpp", "dpp", "d")


def _inner_slope(hp: Column, h: Column, dp: Column, d: Column) -> Column:
    """The slope at a knot between intervals hp and h with differences dp and d."""
    w1, w2 = 2 * h + hp, h + 2 * hp
    return F.when(d * dp <= 0, 0.0).otherwise((w1 + w2) / (w1 / dp + w2 / d))


def _end_slope(h0: Column, h1: Column, d0: Column, d1: Column) -> Column:
    """The slope at the track's end of interval h0, with h1 the next one inwards."""
    raw = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
    return F.when(F.signum(raw) != F.signum(d0), 0.0).when((F.signum(d0) != F.signum(d1)) & (F.abs(raw) > F.abs(3 * d0)), 3 * d0).otherwise(raw)


def hermite(t: Column, x: Column, h: Column, y: Column, y1: Column, s: Column, s1: Column) -> Column:
    u = (t - x) / h
    u2, u3 = u * u, u * u * u
    return (2 * u3 - 3 * u2 + 1) * y + (u3 - 2 * u2 + u) * h * s + (3 * u2 - 2 * u3) * y1 + (u3 - u2) * h * s1


def resampled(df: DataFrame, by: list[str], x: str, y: str, step: float, limits: DataFrame | None = None) -> DataFrame:
    """by, i, grid, value: the PCHIP curve of each track on start + i * step, up to but without the end.

    limits: by, start, stop of the common grid; without it each track's own.
    Grid points before the first or after the last knot take the nearest knot's
    value. Each knot emits the grid points of its own interval, so no row meets
    another track's and no range join is needed.
    """
    order = Window.partitionBy(*by).orderBy(x)
    k = pchip_slopes(df, by, x, y)
    if limits is None:
        all_ = Window.partitionBy(*by)
        k = k.withColumn("start", F.min(x).over(all_)).withColumn("stop", F.max(x).over(all_))
    else:
        k = k.join(limits, by)
    first, last = F.row_number().over(order) == 1, F.col("x1").isNull()
    k = k.withColumn("__n", F.ceil((F.col("stop") - F.col("start")) / step).cast("long"))
    lo = F.when(first, F.lit(0)).otherwise(F.ceil((F.col(x) - F.col("start")) / step))
    hi = F.when(last, F.col("__n") - 1).otherwise(F.ceil((F.col("x1") - F.col("start")) / step) - 1)
    k = k.withColumn("__lo", F.greatest(lo.cast("long"), F.lit(0))).withColumn("__hi", F.least(hi.cast("long"), F.col("__n") - 1)).where("__lo <= __hi")
    k = k.withColumn("i", F.explode(F.sequence("__lo", "__hi"))).withColumn("grid", F.col("start") + F.col("i") * step)
    curve = hermite(F.col("grid"), F.col(x), F.col("h"), F.col(y), F.col("y1"), F.col("slope"), F.col("slope1"))
    value = F.when((F.col("grid") <= F.col(x)) | F.col("x1").isNull(), F.col(y)).otherwise(curve)
    return k.select(*by, "i", "grid", value.alias("value"))


def repaired(df: DataFrame, by: list[str], index: str, value: str, bad: str, min_good: int = 4, width: float | None = None) -> DataFrame:
    """df plus repaired: bad values from the PCHIP curve through the good ones, in index space; tracks with fewer than min_good good ones stay.

    The curve between two knots hangs on these and one more on either side, which
    running windows from both ends bring to each row; nothing is joined. With a width,
    tracks are cut into slots of index, and each slot takes the last two knots before
    it and the first two after it along as rows of their own.
    """
    x = F.col(index).cast("double")
    knot = F.when(~F.col(bad), F.struct(x.alias("x"), F.col(value).cast("double").alias("y")))
    rows = df.withColumn(index, F.col(index).cast("long")).withColumn("__slot", tracks.slot(x, width)).withColumn("__k", knot)
    rows = rows.withColumn("__n", F.count("__k").over(Window.partitionBy(*by, "__slot"))).withColumn("__own", F.lit(True))
    keys = [*by, "__slot"]
    if width is not None:
        rows = rows.unionByName(_knots_around(rows, by, index), allowMissingColumns=True)
        total = rows.where("__own").groupBy(*by, "__slot").agg(F.max("__n").alias("n")).groupBy(*by).agg(F.sum("n").alias("__n"))
        rows = tracks.joined(rows.drop("__n"), total, by)
    past, ahead = Window.partitionBy(*keys).orderBy(index), Window.partitionBy(*keys).orderBy(F.desc(index))
    # a knot with the one behind it, seen from either end, then the nearest such pair of every row
    for order, own, pair in ((past, "__p", "__l"), (ahead, "__q", "__r")):
        behind = F.last("__k", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn(own, F.when(F.col("__k").isNotNull(), F.struct(F.col("__k").alias("k"), behind.alias("b"))))
        rows = rows.withColumn(pair, F.last(own, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    a, b, c, d = (F.col(k) for k in ("__l.b", "__l.k", "__r.k", "__r.b"))  # four knots, the row lies between b and c
    h0, h, h1 = b["x"] - a["x"], c["x"] - b["x"], d["x"] - c["x"]
    d0, m, d1 = (b["y"] - a["y"]) / h0, (c["y"] - b["y"]) / h, (d["y"] - c["y"]) / h1
    left = F.when(a.isNull() & d.isNull(), m).when(a.isNull(), _end_slope(h, h1, m, d1)).otherwise(_inner_slope(h0, h, d0, m))
    right = F.when(a.isNull() & d.isNull(), m).when(d.isNull(), _end_slope(h, h0, m, d0)).otherwise(_inner_slope(h, h1, m, d1))
    curve = hermite(x, b["x"], h, b["y"], c["y"], left, right)
    fixed = F.when(~F.col(bad) | (F.col("__n") < min_good), F.col(value)).when(b.isNull(), c["y"]).when(c.isNull(), b["y"]).otherwise(curve)
    return rows.withColumn("repaired", fixed).where("__own").select(*df.columns, "repaired")


def _knots_around(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    """The two knots before and the two after each slot of a track, as rows of that slot; four of every slot are read."""
    good = rows.where(F.col("__k").isNotNull()).select(*by, "__slot", index, "__k")
    rank = lambda order: F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(order))
    edges = good.withColumn("__a", rank(F.col(index))).withColumn("__b", rank(F.desc(index))).where("__a <= 2 or __b <= 2")
    slots = rows.select(*by, "__slot").distinct()
    # a slot's row stands before its knots in one order, and before them in the other
    marks = edges.select(*by, "__slot", F.lit(1).alias("__m"), index, "__k").unionByName(slots.withColumn("__m", F.lit(0)), allowMissingColumns=True)
    found = []
    for slot_order, place in ((F.col("__slot"), F.col(index)), (F.desc("__slot"), F.desc(index))):
        order = Window.partitionBy(*by).orderBy(slot_order, "__m", place).rowsBetween(Window.unboundedPreceding, -1)
        before = marks.withColumn("__one", F.last("__k", ignorenulls=True).over(order))
        before = before.withColumn("__two", F.last(F.when(F.col("__m") == 1, F.struct(F.col("__k").alias("k"), F.col("__one").alias("b"))), ignorenulls=True).over(order))
        pair = F.array_compact(F.array("__two.k", "__two.b"))
        found.append(before.where("__m = 0").select(*by, "__slot", F.explode(pair).alias("__k")))
    halo = found[0].unionByName(found[1])
    return halo.withColumn(index, F.col("__k.x").cast("long")).withColumn("__own", F.lit(False))


def lags(df: DataFrame, by: list[str], name: str, index: str, value: str, reference: str, limit: int, rate: float = 1.0, warn: float = 0.1, reject: float = 0.5) -> DataFrame:
    """by, name, lag, shift, warned, rejected: the lag of each series against `reference` at the largest correlation.

    Series are centred over the whole; only the lags within `limit` are tried,
    by exploding each reference sample to the samples it can meet and joining on
    equality. A series delayed by n has lag +n; the smallest lag wins ties.
    """
    centred = df.withColumn("__c", F.col(value) - F.avg(value).over(Window.partitionBy(*by, name)))
    base = centred.where(F.col(name) == reference).select(*by, F.col(index).alias("__i"), F.col("__c").alias("__r"))
    base = base.withColumn("lag", F.explode(F.sequence(F.lit(-limit), F.lit(limit)))).withColumn(index, F.col("__i") + F.col("lag"))
    sums = centred.join(base, [*by, index]).groupBy(*by, name, "lag").agg(F.sum(F.col("__c") * F.col("__r")).alias("score"))
    return _lag_verdict(sums, by, name, rate, warn, reject)


def _lag_verdict(sums: DataFrame, by: list[str], name: str, rate: float, warn: float, reject: float) -> DataFrame:
    best = sums.groupBy(*by, name).agg(F.max_by("lag", F.struct(F.round("score", 6), -F.col("lag"))).alias("lag"))
    shift = F.col("lag") / rate
    return best.withColumn("shift", shift).withColumn("warned", F.abs(shift) > warn).withColumn("rejected", F.abs(shift) > reject)


def correlations(df: DataFrame, by: list[str], name: str, index: str, value: str, reference: str, piece: int = 1 << 12, bins: int = 64) -> DataFrame:
    """by, name, lag, score: the correlation of each series with `reference` at every lag at which the two overlap.

    Series are centred; grid places that a series lacks count as its mean. A series of n
    samples is cut into n / piece pieces, and a lag into whole pieces and a rest. The rest
    is a product of the pieces' spectra; for each of their frequencies, whole pieces are
    once more a correlation, along pieces, by their spectrum. So the work is n log n, and
    its steps are dealt out by piece, by `bins` frequencies, and by whole pieces of lag;
    none holds a series. What neighbours have of one lag is added at the end.
    """
    means = df.groupBy(*by, name).agg(F.avg(value).alias("__m"), F.min(index).cast("long").alias("__lo"), F.max(index).cast("long").alias("__hi"))
    rows = tracks.joined(df.select(*by, name, F.col(index).cast("long").alias("__i"), F.col(value).cast("double").alias("__v")), means, [*by, name])
    rows = rows.select(*by, name, F.floor(F.col("__i") / piece).alias("__p"), F.pmod("__i", F.lit(piece)).alias("__k"), (F.col("__v") - F.col("__m")).alias("__c"))
    kinds = {f.name: f for f in rows.schema.fields}
    keys = [kinds[c] for c in by]
    pair = [T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("__re", "__im")]
    size, width = 2 * piece, piece + 1
    blocks = [(a, min(a + bins, width)) for a in range(0, width, bins)]

    def parts(heads: pa.Table, spectra: list[np.ndarray], blocks: list[tuple[int, int]]) -> pa.Table:
        """A row for each head and block of frequencies."""
        out = heads.take(pa.array(np.repeat(np.arange(heads.num_rows), len(blocks))))
        out = out.append_column("__f", pa.array(np.tile(np.arange(len(blocks)), heads.num_rows), pa.int64()))
        for c, part in (("__re", np.real), ("__im", np.imag)):
            out = out.append_column(c, pa.array([part(s[a:b]) for s in spectra for a, b in blocks], pa.list_(pa.float64())))
        return out

    def forward(t: pa.Table, starts: np.ndarray) -> pa.Table:
        places, values = t["__k"].to_numpy(), tracks.numbers(t["__c"])
        spectra = []
        for a, b in zip(starts, tracks.ends_of(starts, t.num_rows)):
            x = np.zeros(piece)
            np.add.at(x, places[a:b], np.nan_to_num(values[a:b]))
            spectra.append(np.fft.rfft(x, size))
        return parts(t.take(pa.array(starts)).select([*by, name, "__p"]), spectra, blocks)

    def across(t: pa.Table, starts: np.ndarray) -> pa.Table:
        series, pieces = t[name].to_pylist(), t["__p"].to_numpy()
        re, im = (t[c].to_pylist() for c in ("__re", "__im"))
        at, lags_, found = [], [], []
        for a, b in zip(starts.tolist(), tracks.ends_of(starts, t.num_rows).tolist()):
            of: dict = {}
            for i in range(a, b):
                of.setdefault(series[i], []).append(i)
            if reference not in of:
                continue
            spread = {}
            for s, own in of.items():
                m = np.zeros((pieces[own[-1]] - pieces[own[0]] + 1, len(re[a])), complex)
                m[pieces[own] - pieces[own[0]]] = np.array([re[i] for i in own]) + 1j * np.array([im[i] for i in own])
                spread[s] = int(pieces[own[0]]), m
            r0, r = spread[reference]
            for s, (s0, x) in spread.items():
                n = 1 << (len(r) + len(x) - 1).bit_length()
                product = np.fft.ifft(np.fft.fft(x, n, axis=0) * np.conj(np.fft.fft(r, n, axis=0)), axis=0)
                for d in range(-(len(r) - 1), len(x)):
                    at.append(of[s][0])
                    lags_.append(d + s0 - r0)
                    found.append(product[d])
        out = t.take(pa.array(at, pa.int64())).select([*by, name, "__f"]).append_column("__d", pa.array(lags_, pa.int64()))
        for c, part in (("__re", np.real), ("__im", np.imag)):
            out = out.append_column(c, pa.array([part(s) for s in found], pa.list_(pa.float64())))
        return out

    def back(t: pa.Table, starts: np.ndarray) -> pa.Table:
        re, im, whole = t["__re"].to_pylist(), t["__im"].to_pylist(), t["__d"].to_numpy()
        at, lag, score = [], [], []
        for a, b in zip(starts.tolist(), tracks.ends_of(starts, t.num_rows).tolist()):
            c = np.fft.irfft(np.concatenate(re[a:b]) + 1j * np.concatenate(im[a:b]), size)
            lag.append(whole[a] * piece + np.arange(-(piece - 1), piece))
            score.append(np.concatenate([c[piece + 1 :], c[:piece]]))
            at.append(np.full(2 * piece - 1, a))
        heads = t.take(pa.array(np.concatenate(at))).select([*by, name])
        return heads.append_column("lag", pa.array(np.concatenate(lag))).append_column("score", pa.array(np.concatenate(score)))

    f, d = T.StructField("__f", T.LongType()), T.StructField("__d", T.LongType())
    spectra = tracks.segmented(rows, [*by, name, "__p"], ["__k"], forward, T.StructType([*keys, kinds[name], kinds["__p"], f, *pair]))
    mixed = tracks.segmented(spectra, [*by, "__f"], [name, "__p"], across, T.StructType([*keys, kinds[name], f, d, *pair]))
    partial = tracks.segmented(mixed, [*by, name, "__d"], ["__f"], back, T.StructType([*keys, kinds[name], T.StructField("lag", T.LongType()), T.StructField("score", T.DoubleType())]))
    sums = partial.groupBy(*by, name, "lag").agg(F.sum("score").alias("score"))
    ends = means.where(F.col(name) == reference).select(*by, F.col("__lo").alias("__rlo"), F.col("__hi").alias("__rhi"))
    means = tracks.joined(means, ends, by) if by else means.crossJoin(F.broadcast(ends))  # one row
    sums = tracks.joined(sums, means, [*by, name])
    return sums.where((F.col("lag") >= F.col("__lo") - F.col("__rhi")) & (F.col("lag") <= F.col("__hi") - F.col("__rlo"))).select(*by, name, "lag", "score")


def full_lags(df: DataFrame, by: list[str], name: str, index: str, value: str, reference: str, rate: float = 1.0, warn: float = 0.1, reject: float = 0.5, piece: int = 1 << 12) -> DataFrame:
    """As lags(), over every lag at which a series overlaps the reference."""
    return _lag_verdict(correlations(df, by, name, index, value, reference, piece), by, name, rate, warn, reject)
