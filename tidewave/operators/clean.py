"""Packet cleaning: deduplication, validation, gain, outliers and repair.

Every operator takes and gives DataFrames; `by` names the columns of a track
(recording, receiver, antenna). Tracks are shuffled on `by` once, and windows
over the same keys share that exchange.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tracks

MAD_TO_SIGMA = 1.4826


def finite(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows of which every array element is a finite number."""
    ok = F.lit(True)
    for a in arrays:
        ok = ok & F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(ok)


def first_by_time(df: DataFrame, by: list[str], time: str, order: str) -> DataFrame:
    """Of rows with one timestamp in a track, the first by `order`."""
    rank = F.row_number().over(Window.partitionBy(*by, time).orderBy(order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def loss_report(df: DataFrame, by: list[str], seconds: Column, rate: float | None = None, min_count: int = 300, max_loss: float = 0.15) -> DataFrame:
    """by, n, duration, loss, rejected: tracks that are too short or lost too many packets.

    Without a rate, that of the median track is taken, from percentiles that merge.
    """
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), (F.max(seconds) - F.min(seconds)).alias("duration"))
    if rate is None:
        typical = out.where("duration > 0").agg(F.percentile_approx(F.col("n") / F.col("duration"), 0.5, 100_000).alias("rate"))
        out = out.crossJoin(F.broadcast(typical))  # one row
    else:
        out = out.withColumn("rate", F.lit(float(rate)))
    expected = F.col("duration") * F.col("rate")
    out = out.withColumn("loss", F.when(expected > 0, 1 - F.col("n") / expected).otherwise(0.0))
    return out.withColumn("rejected", (F.col("n") < min_count) | (F.col("loss") > max_loss))


def gaps(df: DataFrame, by: list[str], time: str, seconds: Column, factor: float = 3.0, medium: float = 0.03, large: float = 0.1) -> DataFrame:
    """df plus ipi and the flags of a small (over factor x median), medium or large gap before each packet."""
    order = Window.partitionBy(*by).orderBy(time)
    out = df.withColumn("ipi", seconds - F.lag(seconds).over(order))
    middle = F.median("ipi").over(Window.partitionBy(*by))
    out = out.withColumn("gap_small", F.col("ipi") > factor * middle)
    return out.withColumn("gap_medium", F.col("gap_small") | (F.col("ipi") > medium)).withColumn("gap_large", F.col("ipi") > large)


def anchored_groups(df: DataFrame, by: list[str], time: str, item: Column, span: float, width: float | None = None) -> DataFrame:
    """by, group_start, items: packets merged while they lie within `span` of the group's first.

    The anchor is the group's first packet, not the last one, so this is no session
    window. A track is cut into slots of `width` (4096 spans), and three steps mark the
    anchors. Where a slot's first anchor can lie is a matter of the packets within a span
    of its begin; for each of these few, the slot's last anchor is noted. Along a track,
    the notes are chained into the anchor that each slot inherits. With that, every slot
    marks its packets. Packets without a time belong to no group.
    """
    width = width or (4096 * span or 1.0)
    rows = df.where(F.col(time).isNotNull()).select(*by, F.col(time).alias("__t"), item.alias("__item"))
    rows = rows.withColumn("__slot", tracks.slot(F.col("__t"), width))
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    of = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in by)
    kind = kinds["__t"].simpleString()
    times = rows.select(*by, "__slot", "__t")
    notes = tracks.segmented(times, [*by, "__slot"], ["__t"], _slot_notes(by, span, width), f"{of + ', ' if by else ''}__slot long, first array<{kind}>, last array<{kind}>")
    inherited = tracks.segmented(notes, by, ["__slot"], _chained(by, span), f"{of + ', ' if by else ''}__slot long, __t {kind}") if by else None
    if inherited is None:
        inherited = tracks.segmented(notes.withColumn("__all", F.lit(0)), ["__all"], ["__slot"], _chained([], span), f"__slot long, __t {kind}")
    # the inherited anchor is a slot's first row
    marked = rows.withColumn("__own", F.lit(1)).unionByName(inherited.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([*rows.drop("__slot").schema.fields, T.StructField("group_start", kinds["__t"])])
    marked = tracks.segmented(marked, [*by, "__slot"], ["__own", "__t"], _marked(by, span), schema)
    packed = marked.groupBy(*by, "group_start").agg(F.array_sort(F.collect_list(F.struct("__t", "__item"))).alias("__p"))  # one group
    return packed.select(*by, "group_start", F.col("__p.__item").alias("items"))


def _slot_notes(by: list[str], span: float, width: float):
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        all_, slots = rows["__t"].to_pylist(), rows["__slot"].to_pylist()
        first, last = [], []
        for a, b in zip(starts.tolist(), tracks.ends_of(starts, len(all_)).tolist()):
            times, begin = all_[a:b], slots[a] * width
            beyond = span + 1e-9 * (abs(begin) + span)  # of any anchor before the slot, roundings included
            n = next((i for i, t in enumerate(times) if t - begin > beyond), len(times) - 1) + 1
            known: dict[int, int] = {}  # anchor -> the slot's last one
            for i in range(n):
                path, at = [], i
                while at not in known and at < len(times):
                    path.append(at)
                    start, at = times[at], at + 1
                    while at < len(times) and times[at] - start <= span:
                        at += 1
                known |= dict.fromkeys(path, known.get(at, path[-1] if path else 0))
            first.append(times[:n])
            last.append([times[known[i]] for i in range(n)])
        heads = rows.take(pa.array(starts)).select([*by, "__slot"])
        kind = pa.list_(rows["__t"].type)
        return heads.append_column("first", pa.array(first, kind)).append_column("last", pa.array(last, kind))

    return kernel


def _chained(by: list[str], span: float):
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        first, last = rows["first"].to_pylist(), rows["last"].to_pylist()
        begins, out, anchor = set(starts.tolist()), [], None
        for i in range(len(first)):
            anchor = None if i in begins else anchor
            out.append(anchor)
            new = next((x for t, x in zip(first[i], last[i]) if anchor is None or t - anchor > span), None)
            anchor = anchor if new is None else new
        return rows.select([*by, "__slot"]).append_column("__t", pa.array(out, rows["first"].type.value_type))

    return kernel


def _marked(by: list[str], span: float):
    def kernel(rows: pa.Table, starts: np.ndarray) -> pa.Table:
        times, own = rows["__t"].to_pylist(), np.array(rows["__own"].to_pylist(), bool)
        out = []
        for a, b in zip(starts.tolist(), tracks.ends_of(starts, len(times)).tolist()):
            anchor = times[a]  # of the inherited row
            for t in times[a:b]:
                if t is not None and (anchor is None or t - anchor > span):
                    anchor = t
                out.append(anchor)
        marked = rows.select([*by, "__t", "__item"]).append_column("group_start", pa.array(out, rows["__t"].type))
        return marked.filter(pa.array(own))

    return kernel


def gain_normalised(df: DataFrame, by: list[str], magnitudes: str, floor_ratio: float = 1e-3) -> DataFrame:
    """df plus gain (mean magnitude) and normalised magnitudes; gains under floor_ratio x the track's largest count as 1."""
    mean = F.aggregate(magnitudes, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(magnitudes)
    out = df.withColumn("gain", mean).withColumn("__top", F.max("gain").over(Window.partitionBy(*by)))
    safe = F.when(F.col("gain") > F.col("__top") * floor_ratio, F.col("gain")).otherwise(1.0)
    return out.withColumn("__safe", safe).withColumn("normalised", F.transform(magnitudes, lambda x: x / (F.col("__safe") + 1e-8))).drop("__top", "__safe")


def running_median(values: np.ndarray, first: np.ndarray, last: np.ndarray, half: int) -> np.ndarray:
    """Medians over 2 half + 1 neighbours; those beyond a row's segment (places first to last) are its edge, repeated."""
    near = np.clip(np.arange(len(values))[:, None] + np.arange(-half, half + 1), first[:, None], last[:, None])
    return np.partition(values[near], half, axis=1)[:, half]


def outliers(v: np.ndarray, first: np.ndarray, last: np.ndarray, half: int = 7, sigmas: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """(bad, dilated): values far from the running median of their segment, and those beside them."""
    dev = np.abs(v - running_median(v, first, last, half))
    bad, at = dev > sigmas * MAD_TO_SIGMA * running_median(dev, first, last, half), np.arange(len(v))
    return bad, bad | bad[np.minimum(at + 1, last)] | bad[np.maximum(at - 1, first)]


def hampel(df: DataFrame, by: list[str], time: str, value: str, half: int = 7, sigmas: float = 3.0, width: float | None = None, length: int = 1 << 16) -> DataFrame:
    """by, time, value, bad, dilated: outliers against the running median, and the flags spread to both neighbours.

    A row depends on 2 half + 1 places on either side. Tracks are cut into pieces of
    `length` places that overlap by so many, and only own rows are given out; with a
    `width` of time, places are counted without gathering a track. Rows of one time are
    ordered by value; null values count as NaN, above all others.
    """
    rows = df.select(*by, F.col(time), F.col(value).cast("double").alias(value))
    rows = tracks.with_halos(tracks.placed(rows, by, time, [value], width, "__i"), "__i", length, 2 * half + 1)
    keep = [*by, time, value]
    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("bad", T.BooleanType()), T.StructField("dilated", T.BooleanType())])

    def kernel(t: pa.Table, starts: np.ndarray) -> pa.Table:
        n = t.num_rows
        ends = tracks.ends_of(starts, n)
        first, last = np.repeat(starts, ends - starts), np.repeat(ends - 1, ends - starts)
        bad, dilated = outliers(tracks.numbers(t[value]), first, last, half, sigmas)
        out = t.select(keep).append_column("bad", pa.array(bad)).append_column("dilated", pa.array(dilated))
        return out.filter(t["__own"])

    return tracks.segmented(rows, [*by, "__piece"], ["__i"], kernel, schema)


def outlier_verdict(flags: DataFrame, by: list[str], reject: float = 0.5, warn: float = 0.2) -> DataFrame:
    share = F.avg(F.col("dilated").cast("int"))
    return flags.groupBy(*by).agg(share.alias("share")).withColumn("rejected", F.col("share") > reject).withColumn("warned", F.col("share") > warn)


def edge_filled(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Nulls before the first and after the last value take the nearest one; tracks of nulls take 0; inner nulls stay."""
    order = Window.partitionBy(*by).orderBy(time)
    back, all_ = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    ahead = Window.partitionBy(*by).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)  # a running frame from the other end
    before, after = F.last(value, ignorenulls=True).over(back), F.last(value, ignorenulls=True).over(ahead)
    filled = F.when(F.count(value).over(all_) == 0, F.lit(0.0)).when(before.isNull(), after).when(after.isNull(), before).otherwise(F.col(value))
    return df.withColumn("filled", filled)
