"""Seeded random augmentation and class-weighted sampling; every draw depends on (seed, id) alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import shifted


def draw(key: str, seed: int, what: str) -> Column:
    """Uniform in [0, 1), from the digest of id, seed and purpose, so that any engine can draw it again."""
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed)), F.lit(what)))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / float(1 << 48)


def drawn_mask(key: str, seed: int, what: str, n: Column, chance: float, least: int, most: int) -> tuple[Column, Column]:
    """(start, width) of a masked stretch of n places; width 0 where none is drawn."""
    width = F.when(draw(key, seed, f"{what}?") < chance, F.floor(draw(key, seed, f"{what} width") * (most - least + 1)) + least).otherwise(0).cast("int")
    return F.floor(draw(key, seed, what) * (n - width + 1)).cast("int"), width


def masked_bins(df: DataFrame, key: str, values: str, seed: int, what: str = "bins", chance: float = 0.4, least: int = 3, most: int = 9) -> DataFrame:
    """df plus masked: with the given chance a stretch of least to most neighbouring bins is 0."""
    start, width = drawn_mask(key, seed, what, F.size(values), chance, least, most)
    out = df.withColumn("__m", F.struct(start.alias("start"), width.alias("width")))
    return out.withColumn("masked", F.transform(values, lambda x, i: F.when((i >= F.col("__m.start")) & (i < F.col("__m.start") + F.col("__m.width")), 0.0).otherwise(x))).drop("__m")


def masked_spectrogram(df: DataFrame, key: str, values: str, frames: int, bins: int, seed: int) -> DataFrame:
    """df plus masked: 2 to 6 Doppler bins (p .3) and 1 to 3 frames (p .3) of a spectrogram (frames x bins, row by row) are 0."""
    column, columns = drawn_mask(key, seed, "doppler", F.lit(bins), 0.3, 2, 6)
    row, rows = drawn_mask(key, seed, "frames", F.lit(frames), 0.3, 1, 3)
    out = df.withColumn("__m", F.struct(column.alias("c"), columns.alias("cs"), row.alias("r"), rows.alias("rs")))

    def kept(x: Column, i: Column) -> Column:
        c, r = i % bins, F.floor(i / bins)
        hit = ((c >= F.col("__m.c")) & (c < F.col("__m.c") + F.col("__m.cs"))) | ((r >= F.col("__m.r")) & (r < F.col("__m.r") + F.col("__m.rs")))
        return F.when(hit, 0.0).otherwise(x)

    return out.withColumn("masked", F.transform(values, kept)).drop("__m")


def cut_and_mixed(df: DataFrame, batch: str, key: str, values: str, label: str, seed: int, epoch: int, chance: float = 0.3, share: float = 0.2, first: int = 8) -> DataFrame:
    """df plus mixed, partner and weight: from epoch `first` on, with the given chance for a batch, a stretch of up to `share` of the time comes from a shuffled partner of the batch.

    weight is the share of the row's own label; a batch has few rows, so its order is a window.
    """
    by = Window.partitionBy(batch)
    turn = by.orderBy(draw(key, seed + epoch, "order"), key)
    other = F.struct(F.col(key).alias("k"), F.col(values).alias("v"))
    rows = df.withColumn("__o", F.coalesce(F.lead(other).over(turn), F.first(other).over(turn)))
    n = F.size(values)
    width = F.when(F.lit(epoch >= first) & (draw(batch, seed + epoch, "cut?") < chance), F.floor(draw(batch, seed + epoch, "cut width") * F.floor(n * share)) + 1).otherwise(0).cast("int")
    start = F.floor(draw(batch, seed + epoch, "cut") * (n - width + 1)).cast("int")
    rows = rows.withColumn("__m", F.struct(start.alias("start"), width.alias("width")))
    mixed = F.zip_with(F.transform(values, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), F.col("__o.v"), lambda a, o: F.when((a["i"] >= F.col("__m.start")) & (a["i"] < F.col("__m.start") + F.col("__m.width")), o).otherwise(a["x"]))
    return rows.withColumn("mixed", mixed).withColumn("partner", F.col("__o.k")).withColumn("weight", 1 - F.col("__m.width") / n).drop("__o", "__m")


def augmented(df: DataFrame, key: str, values: str, seed: int, shift: int = 30, drop: float = 0.1, noise: float = 0.01) -> DataFrame:
    """df plus augmented: shift (p .5), scaling (p .5, .6 to 1.4), a dropped stretch (p `drop`), noise (p .3)."""
    n = F.size(values)
    by = F.when(draw(key, seed, "shift?") < 0.5, F.floor(draw(key, seed, "shift") * (2 * shift + 1)) - shift).otherwise(0).cast("int")
    out = df.withColumn("__by", by).withColumn("__factor", F.when(draw(key, seed, "scale?") < 0.5, 0.6 + 0.8 * draw(key, seed, "scale")).otherwise(1.0))
    moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(values, F.least(F.greatest(i - F.col("__by"), F.lit(0)), n - 1)) * F.col("__factor"))
    gone, noisy = draw(key, seed, "drop?") < drop, draw(key, seed, "noise?") < 0.3
    start = F.floor(draw(key, seed, "drop") * n)

    def jitter(i: Column) -> Column:
        # the sum of four uniforms, centred: near enough to normal, and a function of (seed, id, i)
        u = sum((F.pmod(F.xxhash64(F.col(key), F.lit(seed + j), i), F.lit(1 << 53)) / float(1 << 53) for j in range(4)), F.lit(0.0))
        return (u - 2.0) * (3.0**0.5) * noise

    final = F.transform(moved, lambda x, i: F.when(gone & (i >= start) & (i < start + n / 4), 0.0).otherwise(x) + F.when(noisy, jitter(i)).otherwise(0.0))
    return out.withColumn("augmented", final).drop("__by", "__factor")


def augmented_joint(df: DataFrame, key: str, rx: str, ant: str, ref: str, re: str, im: str, seed: int, shift: int = 30, receivers: int = 3, antennas: int = 4, noise: float = 0.01) -> DataFrame:
    """df with re and im augmented: rows are one subcarrier of one receiver and antenna in a window, arrays over time.

    Every draw is the window's own: a shift of up to `shift` places with repeated edges (p .5), a
    factor of .6 to 1.4 (p .5), one antenna but the reference replaced by noise (p .2), one
    receiver replaced by noise (p .1), noise on all (p .3).
    """
    on = lambda what, p: draw(key, seed, f"{what}?") < p
    n = F.size(re)
    by = F.when(on("shift", 0.5), F.floor(draw(key, seed, "shift") * (2 * shift + 1)) - shift).otherwise(0).cast("int")
    factor = F.when(on("scale", 0.5), 0.6 + 0.8 * draw(key, seed, "scale")).otherwise(1.0)
    other = F.floor(draw(key, seed, "antenna") * (antennas - 1)).cast("int")
    antenna = F.when(on("antenna", 0.2), other + (other >= F.col(ref)).cast("int"))
    receiver = F.when(on("receiver", 0.1), F.floor(draw(key, seed, "receiver") * receivers).cast("int"))
    gone = F.coalesce(F.col(ant) == antenna, F.lit(False)) | F.coalesce(F.col(rx) == receiver, F.lit(False))
    out = df.withColumn("__d", F.struct(by.alias("by"), factor.alias("factor"), gone.alias("gone"), on("noise", 0.3).alias("noisy")))

    def normal(part: str, i: Column) -> Column:
        # two uniforms by hash to one normal (Box and Muller)
        u = [(F.pmod(F.xxhash64(F.col(key), F.col(rx), F.col(ant), F.lit(part), F.lit(seed + j), i), F.lit(1 << 53)) + 1) / float((1 << 53) + 1) for j in range(2)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(6.283185307179586 * u[1]) * noise

    def moved(part: str) -> Column:
        def at(i: Column) -> Column:
            x = F.get(part, F.least(F.greatest(i - F.col("__d.by"), F.lit(0)), n - 1)) * F.col("__d.factor")
            return F.when(F.col("__d.gone"), normal(part, i)).otherwise(x) + F.when(F.col("__d.noisy"), normal(part, i + n)).otherwise(0.0)

        return F.transform(F.sequence(F.lit(0), n - 1), at)

    return out.withColumns({re: moved(re), im: moved(im)}).drop("__d")


def weighted_sample(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """As many rows as df has, drawn with replacement, each class as likely as any other.

    A slot draws its class by hash, then a row of the class by rank; the join is an
    equi-join on (class, rank). Ranks follow a draw of the row's own; they are counted in
    4096 buckets of it for each class and summed over the buckets, so no task ranks a whole class.
    """
    rows = df.withColumn("__h", draw(key, seed, "rank")).withColumn("__b", F.floor(F.col("__h") * 4096))
    buckets = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(label, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1 + F.col("__start")
    ranked = rows.join(buckets, [label, "__b"]).withColumn("__rank", place.cast("long")).drop("__h", "__b", "__start")
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    classes = F.broadcast(counts.withColumn("__class", F.row_number().over(Window.orderBy(label)) - 1))  # a row for each class
    slots = df.select(F.col(key).alias("slot")).crossJoin(F.broadcast(counts.agg(F.count(F.lit(1)).alias("__k"))))  # one row
    slots = slots.withColumn("__class", F.floor(draw("slot", seed, "class") * F.col("__k")).cast("int"))
    slots = slots.join(classes, "__class").withColumn("__rank", F.floor(draw("slot", seed, "row") * F.col("__n")).cast("long"))
    return slots.select("slot", label, "__rank").join(ranked, [label, "__rank"]).select("slot", key, label)


def batches(df: DataFrame, key: str, size: int, seed: int, drop_last: bool = True) -> DataFrame:
    """df plus batch: rows in an order that (seed, id) gives; ranks are summed over range partitions, not in one task."""
    shuffled = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    bucket = F.shiftrightunsigned(F.col("__h"), 52)
    rows = shuffled.withColumn("__b", bucket)
    before = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    # at most 4096 rows
    before = before.withColumn("__start", F.coalesce(F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key)) - 1 + F.col("__start")
    out = rows.join(F.broadcast(before), "__b").withColumn("batch", F.floor(place / size))
    if drop_last:
        total = F.broadcast(before.agg(F.sum("__n").alias("__total")))
        out = out.crossJoin(total).where((F.col("batch") + 1) * size <= F.col("__total")).drop("__total")
    return out.drop("__h", "__b", "__n", "__start")
