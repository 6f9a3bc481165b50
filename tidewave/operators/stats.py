"""Train-only statistics, discriminant scores, reference antennas and sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(df: DataFrame, by: list[str], order: str, length: int = 350, stride: int = 175) -> DataFrame:
    """A row for each sample and full window it lies in: by, window_idx, place, and df's columns.

    Windows are numbered from 0 by track; a track of n samples has
    (n - length) div stride + 1 of them, or none.
    """
    w = Window.partitionBy(*by)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(order)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).where(F.col("__n") >= length)
    last = F.floor((F.col("__n") - length) / stride)
    lo = F.greatest(F.lit(0), F.ceil((F.col("__i") - length + 1) / stride)).cast("long")
    hi = F.least(last, F.floor(F.col("__i") / stride)).cast("long")
    rows = rows.withColumn("__lo", lo).withColumn("__hi", hi).where("__lo <= __hi")
    rows = rows.withColumn("window_idx", F.explode(F.sequence("__lo", "__hi")))
    return rows.withColumn("place", F.col("__i") - F.col("window_idx") * stride).drop("__i", "__n", "__lo", "__hi")


def whole_windows(windows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Windows without null or NaN values, numbered anew by track."""
    bad = F.max((F.col(value).isNull() | F.isnan(value)).cast("int")).over(Window.partitionBy(*by, "window_idx"))
    kept = windows.withColumn("__bad", bad).where("__bad = 0").drop("__bad")
    return kept.withColumn("window_idx", F.dense_rank().over(Window.partitionBy(*by).orderBy("window_idx")) - 1)


def centred(windows: DataFrame, by: list[str], value: str) -> DataFrame:
    """windows plus minus_mean and minus_median within each window."""
    w = Window.partitionBy(*by, "window_idx")
    return windows.withColumn("minus_mean", F.col(value) - F.avg(value).over(w)).withColumn("minus_median", F.col(value) - F.median(value).over(w))


def zscore_fit(df: DataFrame, by: list[str], value: str, eps: float = 1e-8) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mu"), (F.stddev_pop(value) + eps).alias("sigma"))


def zscore_apply(df: DataFrame, stats: DataFrame, by: list[str], value: str) -> DataFrame:
    return df.join(stats, by).withColumn("z", (F.col(value) - F.col("mu")) / F.col("sigma"))


def fisher(df: DataFrame, sub: str, label: str, value: str, eps: float = 1e-12, by: tuple[str, ...] = ()) -> DataFrame:
    """by, sub, score: between-class over within-class scatter."""
    n = F.count(F.lit(1))
    return fisher_of(df.groupBy(*by, sub, label).agg(n.alias("n"), F.avg(value).alias("mean"), (n * F.var_pop(value)).alias("m2")), [*by, sub], eps)


def fisher_of(classes: DataFrame, by: list[str], eps: float = 1e-12) -> DataFrame:
    """by, score from the classes' moments (n, mean, m2)."""
    w = Window.partitionBy(*by)
    per = classes.withColumn("__g", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    between = F.sum(F.col("n") * (F.col("mean") - F.col("__g")) * (F.col("mean") - F.col("__g")))
    return per.groupBy(*by).agg((between / (F.sum("m2") + eps)).alias("score"))


def group_of(sub: Column, size: int, groups: int) -> Column:
    """The group of near-equal contiguous groups that sub falls in; the first size % groups have one more."""
    q, r = divmod(size, groups)
    return F.when(sub < r * (q + 1), F.floor(sub / (q + 1))).otherwise(r + F.floor((sub - r * (q + 1)) / max(q, 1)))


def best_per_group(scores: DataFrame, sub: str, size: int, groups: int = 13, by: tuple[str, ...] = ()) -> DataFrame:
    """by, grp, sub, score: each group's best, the first on ties."""
    ranked = scores.withColumn("grp", group_of(F.col(sub), size, groups))
    return ranked.groupBy(*by, "grp").agg(F.max_by(F.struct(sub, "score"), F.struct("score", -F.col(sub))).alias("b")).select(*by, "grp", f"b.{sub}", "b.score")


def person_moments(windows: DataFrame) -> DataFrame:
    """person, label, place, n, mean, m2, xn, xmean, xm2: what a person's windows of a class add to any fold's statistics.

    windows: person, label, mean and var of every place's centred amplitude (arrays), x
    (a dynamic feature of every subcarrier, an array no longer than mean). One pass: a
    window becomes a row for each place, which is added up before it moves. m2 is the
    sum of squares about the mean: all windows have one length, so that of samples (those
    in two windows counted twice) is the sum of the variances plus that of the means.
    The columns with x are of the subcarrier whose number is the place, null beyond.
    """
    rows = windows.select("person", "label", F.posexplode(F.arrays_zip("mean", "var", "x")).alias("place", "w"))
    n, xn = F.count("w.mean"), F.count("w.x")
    return rows.groupBy("person", "label", "place").agg(
        n.alias("n"), F.avg("w.mean").alias("mean"), (F.sum("w.var") + n * F.var_pop("w.mean")).alias("m2"),
        xn.alias("xn"), F.avg("w.x").alias("xmean"), (xn * F.var_pop("w.x")).alias("xm2"),
    )


def of_all_folds(parts: DataFrame, persons: int, by: list[str], n: str, mean: str, m2: str) -> DataFrame:
    """by, fold, n, mean, m2: moments of all persons but two for every fold, from the moments of each.

    parts: by, k (the person's rank), n, mean, m2. Fold k is tested on person k and
    validated on the next, so its training persons are those before k and those after
    k + 1: two running sums along the ranks, one from either end, and no row for each
    fold and window. Sums are of differences from the mean over all persons, so squares
    of large means do not cancel. Every fold has a row for each value of by that any
    person has; n is 0, and mean and m2 are null, where no training person has it.
    """
    whole = Window.partitionBy(*by)
    p = parts.groupBy(*by, "k").agg(F.collect_list(F.struct(F.col(n).alias("n"), F.col(mean).alias("m"), F.col(m2).alias("s"))).alias("__p"))  # a row for each class at most
    p = p.withColumn("__n", F.aggregate("__p", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    p = p.withColumn("__nm", F.aggregate("__p", F.lit(0.0), lambda a, x: a + x["n"] * F.coalesce(x["m"], F.lit(0.0))))
    p = p.withColumn("__c", F.sum("__nm").over(whole) / F.sum("__n").over(whole))
    p = p.withColumn("__d", F.col("__nm") - F.col("__n") * F.col("__c"))
    p = p.withColumn("__q", F.aggregate("__p", F.lit(0.0), lambda a, x: a + F.coalesce(x["s"] + x["n"] * (x["m"] - F.col("__c")) * (x["m"] - F.col("__c")), F.lit(0.0))))
    cells = p.select(*by, "__c").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(persons - 1))))
    p = cells.join(p.select(*by, "k", "__n", "__d", "__q"), [*by, "k"], "left")
    before = whole.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    after = whole.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -2)

    def others(c: str) -> Column:
        # the last fold is validated on the first person
        first = F.when(F.col("k") == persons - 1, F.sum(F.when(F.col("k") > 0, F.col(c))).over(before)).otherwise(F.sum(c).over(before))
        return F.coalesce(first, F.lit(0)) + F.coalesce(F.sum(c).over(after), F.lit(0))

    p = p.select(*by, F.col("k").alias("fold"), "__c", others("__n").alias("n"), others("__d").alias("d"), others("__q").alias("q"))
    shift = F.when(F.col("n") > 0, F.col("d") / F.col("n"))
    return p.select(*by, "fold", "n", (F.col("__c") + shift).alias("mean"), F.greatest(F.col("q") - F.col("d") * shift, F.lit(0.0)).alias("m2"))


def fold_statistics(moments: DataFrame, ranks: DataFrame, size: int, groups: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What each fold learns from its training persons alone, for all folds at once: three small tables.

    moments: those of person_moments(), which are the only thing read, so write them
    first where windows are dear. ranks: person, k, persons, of split.person_ranks().

    (fold, place, mu, sigma), (fold, sub, score) and (fold, grp, sub, score): z-score
    statistics, Fisher scores, and the best subcarrier of each group. A place or
    subcarrier without training windows in a fold has no row there.
    """
    ranked = moments.join(ranks, "person")
    persons = ranks.first()["persons"]
    z = of_all_folds(ranked, persons, ["place"], "n", "mean", "m2").where("n > 0")
    zscore = z.select("fold", "place", F.col("mean").alias("mu"), (F.sqrt(F.col("m2") / F.col("n")) + 1e-8).alias("sigma"))
    x = ranked.where("xn > 0").withColumnRenamed("place", "sub")
    per = of_all_folds(x, persons, ["sub", "label"], "xn", "xmean", "xm2").where("n > 0")
    scores = fisher_of(per, ["fold", "sub"])
    return zscore, scores, best_per_group(scores, "sub", size, groups, by=("fold",))


def reference_antenna(df: DataFrame, by: list[str], time: str, antenna: str, magnitude: str, floor: float = 0.1) -> DataFrame:
    """by, antenna, variance: the steadiest antenna whose mean exceeds floor x the strongest (any, if none does)."""
    steps = df.groupBy(*by, antenna, time).agg(F.avg(magnitude).alias("m"))
    stats = steps.groupBy(*by, antenna).agg(F.avg("m").alias("mean"), F.var_pop("m").alias("variance"))
    w = Window.partitionBy(*by)
    stats = stats.withColumn("__ok", F.col("mean") > floor * F.max("mean").over(w))
    stats = stats.withColumn("__any", F.max("__ok").over(w)).where("__ok or not __any")
    best = stats.groupBy(*by).agg(F.min_by(F.struct(antenna, "variance"), F.struct("variance", antenna)).alias("b"))
    return best.select(*by, f"b.{antenna}", "b.variance")


def top_variance(df: DataFrame, by: list[str], sub: str, value: str, k: int = 5) -> DataFrame:
    var = df.groupBy(*by, sub).agg(F.var_pop(value).alias("variance"))
    order = Window.partitionBy(*by).orderBy(F.desc("variance"), F.desc(sub)) if by else Window.orderBy(F.desc("variance"), F.desc(sub))
    return var.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def blurpool(df: DataFrame, by: list[str], order: str, value: str, stride: int = 4) -> DataFrame:
    """by, i, value: the [1 4 6 4 1]/16 filter, valid part only, every `stride`-th output."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    total = sum((F.lead(value, j).over(w) * c for j, c in enumerate((1, 4, 6, 4, 1))), F.lit(0.0)) / 16
    rows = rows.withColumn("__v", total).where((F.col("__i") + 4 < F.col("__n")) & (F.col("__i") % stride == 0))
    return rows.select(*by, (F.col("__i") / stride).cast("long").alias("i"), F.col("__v").alias("value"))


def readout(df: DataFrame, by: list[str], order: str, value: str, stride: int = 4) -> DataFrame:
    """by, mean, energy (mean of squares), blurred (the mean of blurpool()'s outputs, null where there is none)."""
    sums = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.avg(F.col(value) * F.col(value)).alias("energy"))
    blurred = blurpool(df, by, order, value, stride).groupBy(*by).agg(F.avg("value").alias("blurred"))
    return sums.join(blurred, by, "left")
