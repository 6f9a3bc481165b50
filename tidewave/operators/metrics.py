"""Classification metrics, losses, calibration and result tables over predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import softmax


def argmax(p: Column) -> Column:
    """The first index of the largest element."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def confusion(pred: DataFrame, classes: int, by: tuple[str, ...] = ()) -> DataFrame:
    """by, truth, pred, n for all classes x classes cells. pred: truth, pred."""
    spark = pred.sparkSession
    grid = spark.range(classes * classes).select((F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("pred"))
    counts = pred.groupBy(*by, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    if by:
        grid = counts.select(*by).distinct().crossJoin(F.broadcast(grid))  # classes^2 fixed rows
    return grid.join(counts, [*by, "truth", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def per_class(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, cls, precision, recall, f1, support, present, from confusion cells; empty denominators give 0."""
    rows = cells.select(*by, F.explode(F.array(F.struct(F.col("truth").alias("cls"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col("pred").alias("cls"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("r"), "n", (F.col("truth") == F.col("pred")).alias("hit"))
    sums = rows.groupBy(*by, F.col("r.cls").alias("cls")).agg(F.sum(F.col("n") * F.col("r.t")).alias("support"), F.sum(F.col("n") * F.col("r.p")).alias("said"), F.sum(F.when(F.col("hit"), F.col("n") * F.col("r.t")).otherwise(0)).alias("tp"))
    over = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select(
        *by, "cls",
        over(F.col("tp"), F.col("said")).alias("precision"),
        over(F.col("tp"), F.col("support")).alias("recall"),
        over(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"),
        "support", (F.col("said") + F.col("support") > 0).alias("present"),
    )


def macro_f1(classes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean F1 over the classes present in truth or prediction."""
    return classes.where("present").groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def calibration_error(pred: DataFrame, bins: int = 10) -> DataFrame:
    """ece over [lo, hi) bins of confidence; a confidence of exactly 1 falls in none but counts in the total."""
    n = Window.partitionBy()
    rows = pred.groupBy(F.floor(F.col("confidence") * bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("conf"), F.avg(F.col("correct").cast("int")).alias("acc"))
    rows = rows.withColumn("total", F.sum("n").over(n)).where(F.col("bin") < bins)  # at most bins + 1 rows
    return rows.agg(F.sum(F.col("n") / F.col("total") * F.abs(F.col("acc") - F.col("conf"))).alias("ece"))


def pooled(pred: DataFrame, by: list[str], probs: str) -> DataFrame:
    """by, probs: the mean probability vector of each recording's windows."""
    each = pred.select(*by, F.posexplode(probs).alias("i", "p")).groupBy(*by, "i").agg(F.avg("p").alias("p"))
    return each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "p"))).alias("x")).select(*by, F.col("x.p").alias(probs))


def row_normalised(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    row = F.sum("n").over(Window.partitionBy(*by, "truth"))
    return cells.withColumn("share", F.coalesce(F.col("n") / F.nullif(row, F.lit(0)), F.lit(0.0)))


def fold_summary(folds: DataFrame, by: list[str], value: str) -> DataFrame:
    return folds.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max_by("fold", F.struct(value, -F.col("fold"))).alias("best_fold"))


def composed(occupied: Column, moving: Column, activities: Column) -> Column:
    """Eight class probabilities of the hierarchical heads: six activities, lying still, empty. They sum to 1."""
    moves = F.transform(activities, lambda a: occupied * moving * a)
    return F.concat(moves, F.array(occupied * (1 - moving), 1 - occupied))


def tempered(probs: Column, temperature: Column | float) -> Column:
    logs = F.transform(probs, lambda p: F.log(F.greatest(p, F.lit(1e-12))))
    return softmax(F.transform(logs, lambda x: x / temperature))


def temperature_grid(pred: DataFrame, probs: str, truth: str, grid: list[float]) -> DataFrame:
    """temperature, nll for each value of a fixed grid; the fit is the least, the smallest on ties."""
    t = pred.select(probs, truth, F.explode(F.array(*map(F.lit, grid))).alias("temperature"))
    p = F.get(tempered(F.col(probs), F.col("temperature")), F.col(truth).cast("int"))
    return t.groupBy("temperature").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("nll"))


def fitted_temperature(pred: DataFrame, probs: str, truth: str, least: float = 0.05, most: float = 20.0, step: float = 0.01) -> float:
    """The temperature of least mean loss, to a step, never below `least`: grids of 20 places, each around the best of the last.

    The loss has one minimum in the temperature, and every grid is one aggregate over the rows.
    """
    lo, hi = round(least / step), round(most / step)
    while True:
        grid = sorted({lo + (hi - lo) * i // 20 for i in range(21)})
        rows = temperature_grid(pred, probs, truth, [g * step for g in grid]).collect()
        best = min(range(len(grid)), key=lambda i: min((r.nll, i) for r in rows if abs(r.temperature - grid[i] * step) < step / 4))
        if len(grid) == hi - lo + 1:
            return round(grid[best] * step, 10)
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)]


def smoothed_loss(probs: Column, truth: Column, weights: list[float], eps: float = 0.05) -> Column:
    """Label-smoothed, class-weighted cross-entropy of one row."""
    n = len(weights)
    terms = F.transform(probs, lambda p, i: (F.when(i == truth, 1 - eps).otherwise(0.0) + eps / n) * F.log(F.greatest(p, F.lit(1e-8))))
    return -F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) * F.get(F.array(*map(F.lit, weights)), truth.cast("int"))


def binary_loss(p: Column, target: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return -(target * F.log(p) + (1 - target) * F.log(1 - p))


def focal_loss(p: Column, gamma: float = 2.0) -> Column:
    p = F.greatest(p, F.lit(1e-8))
    return -F.pow(1 - p, F.lit(gamma)) * F.log(p)


def total_loss(main: Column, parts: list[tuple[float, Column]], epoch: int, ramp: int = 5) -> Column:
    return main + min(epoch / ramp, 1.0) * reduce(lambda a, b: a + b, (w * p for w, p in parts))


def learning_rate(epoch: Column, warm: int = 5, main: int = 50, fine: int = 20) -> Column:
    """The three-phase schedule: linear warm-up, cosine, cosine at a lower level."""
    import math

    cosine = lambda e, n, hi, lo: lo + (hi - lo) * (1 + F.cos(math.pi * e / n)) / 2
    up = 1e-5 + (1e-4 - 1e-5) * epoch / max(warm - 1, 1)
    return F.when(epoch < warm, up).when(epoch < warm + main, cosine(epoch - warm, main, 1e-4, 1e-6)).otherwise(cosine(epoch - warm - main, fine, 1e-5, 1e-7))


def curves(log: DataFrame, phase: str | None = None) -> DataFrame:
    """phase, epoch, loss, f1, rate: the means over folds of a training log, of one phase or all."""
    rows = log if phase is None else log.where(F.col("phase") == phase)
    return rows.groupBy("phase", "epoch").agg(F.avg("loss").alias("loss"), F.avg("f1").alias("f1"), F.max("rate").alias("rate"))


def colour_limits(spectrogram: Column) -> Column:
    """(low, high): the 5th and 95th percentile, by interpolation between neighbours."""
    s = F.sort_array(spectrogram)

    def at(p: float) -> Column:
        place = (F.size(s) - 1) * p
        below = F.floor(place).cast("int")
        low, high = F.get(s, below), F.get(s, F.least(below + 1, F.size(s) - 1))
        return low + (high - low) * (place - below)

    return F.struct(at(0.05).alias("low"), at(0.95).alias("high"))
