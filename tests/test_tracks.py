"""Operators on tracks that are cut into pieces, against plain loops over whole tracks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels as K
from tidewave.operators import align, clean, tracks


def walk(packets, span):
    """(start, items) of one track."""
    out, start = [], None
    for t, i in sorted(packets):
        if start is None or t - start > span:
            start = t
            out.append((start, []))
        out[-1][1].append(i)
    return [(s, tuple(i)) for s, i in out]


def times(rng, n, span):
    """Dense runs, gaps, ties and exact multiples of the span."""
    t, out = rng.uniform(-50, 50), []
    for _ in range(n):
        t += rng.choice([0, 0, span / 7, span / 3, span, span * 1.0000001, span * 3, span * 40, 0.1])
        out.append(round(t, 3) if rng.random() < 0.5 else t)
    return out


@pytest.mark.parametrize("seed,span", [(0, 1.0), (1, 0.001), (2, 0.3), (3, 0.0)])
def test_anchors_do_not_depend_on_the_slots(spark, seed, span):
    rng = random.Random(seed)
    data = {k: [(t, i) for i, t in enumerate(times(rng, n, span or 0.1))] for k, n in (("a", 300), ("b", 1), ("c", 90), (None, 12))}
    rows = [(k, t, i) for k, ps in data.items() for t, i in ps] + [("a", None, 999), ("only null", None, 5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t double, i long").repartition(5)
    want = sorted(((k, *g) for k, ps in data.items() for g in walk(ps, span)), key=repr)
    for width in (None, 7.3 * (span or 0.1), 1.01 * (span or 0.1), 1000 * (span or 1)):
        got = clean.anchored_groups(df, ["k"], "t", F.col("i"), span, width).collect()
        assert sorted(((r.k, r.group_start, tuple(r["items"])) for r in got), key=repr) == want


def test_one_track_of_the_whole_table(spark):
    df = spark.createDataFrame([(float(t), i) for i, t in enumerate([0, 1, 2, 3, 10, 11])], "t double, i long")
    got = sorted((r.group_start, tuple(r["items"])) for r in clean.anchored_groups(df, [], "t", F.col("i"), 1.0, 2.0).collect())
    assert got == [(0.0, (0, 1)), (2.0, (2, 3)), (10.0, (4, 5))]
    assert clean.anchored_groups(df.limit(0), [], "t", F.col("i"), 1.0).collect() == []


def test_a_long_track_is_marked_by_many_tasks(spark):
    df = spark.range(20_000).select(F.lit("one").alias("k"), (F.col("id") * 0.0004).alias("t"), "id").repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        pieces = tracks.segmented(df.withColumn("s", tracks.slot(F.col("t"), 0.1)), ["k", "s"], ["t"], lambda rows, starts: rows.select(["s"]), "s long")
        sizes = [r["count"] for r in pieces.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) > 8 and max(sizes) < 5000
        got = clean.anchored_groups(df, ["k"], "t", F.col("id"), 0.001, 0.1)
        assert sorted(tuple(r["items"]) for r in got.collect()) == [i for _, i in walk([(i * 0.0004, i) for i in range(20_000)], 0.001)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def flags(values, half=7):
    """Hampel by loops."""
    n = len(values)
    med = lambda x, i: sorted(x[min(max(j, 0), n - 1)] for j in range(i - half, i + half + 1))[half]
    dev = [abs(values[i] - med(values, i)) for i in range(n)]
    bad = [dev[i] > 3 * 1.4826 * med(dev, i) for i in range(n)]
    return [(bad[i], bad[i] or i + 1 < n and bad[i + 1] or i > 0 and bad[i - 1]) for i in range(n)]


def series(rng, n):
    return [rng.gauss(0, 1) + (50 if rng.random() < 0.05 else 0) for _ in range(n)]


@pytest.mark.parametrize("width,length", [(None, 1 << 16), (40.0, 64), (3.0, 16), (1000.0, 5)])
def test_outliers_do_not_depend_on_the_pieces(spark, width, length):
    rng = random.Random(4)
    data = {k: series(rng, n) for k, n in (("a", 400), ("b", 1), ("c", 16), ("d", 33), (None, 20))}
    rows = [(k, i * 0.7, v) for k, vs in data.items() for i, v in enumerate(vs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t double, v double").repartition(4)
    got = sorted(((r.k, r.t, r.v, r.bad, r.dilated) for r in clean.hampel(df, ["k"], "t", "v", width=width, length=length).collect()), key=repr)
    want = [(k, i * 0.7, v, *f) for k, vs in data.items() for i, (v, f) in enumerate(zip(vs, flags(vs)))]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("width", [None, 10.0, 1.0, 57.0])
def test_repair_does_not_depend_on_the_slots(spark, width):
    rng = random.Random(5)
    rows, want = [], []
    for k, n, share in (("a", 200, 0.3), ("b", 50, 0.9), ("c", 3, 0.5), ("d", 120, 0.0), ("e", 30, 1.0), ("f", 80, 0.6)):
        values = np.array(series(rng, n))
        bad = np.array([rng.random() < share for _ in range(n)])
        if k == "f":
            bad[:25] = bad[40:70] = True  # long runs, over several slots, at the edge too
        good = np.flatnonzero(~bad)
        fixed = values.copy()
        if len(good) >= 4 and bad.any():
            inner = np.clip(np.flatnonzero(bad).astype(float), good[0], good[-1])
            fixed[bad] = K.pchip(good.astype(float), values[good][:, None], inner)[:, 0]
        rows += [(k, i, float(v), bool(b)) for i, (v, b) in enumerate(zip(values, bad))]
        want += [(k, i, pytest.approx(float(v), rel=1e-9, abs=1e-12)) for i, v in enumerate(fixed)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i int, v double, b boolean")
    out = align.repaired(df, ["k"], "i", "v", "b", width=width)
    assert out.columns == ["k", "i", "v", "b", "repaired"]
    assert sorted((r.k, r.i, r.repaired) for r in out.collect()) == want


def test_repair_joins_nothing_in_one_slot(spark):
    df = spark.createDataFrame([("a", 0, 1.0, False)], "k string, i int, v double, b boolean")
    plan = align.repaired(df, ["k"], "i", "v", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_places_count_over_slots(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), rng.choice([0.0, 1.5, 2.0, 9.0, rng.uniform(0, 30)]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t double, i long")
    a, b = (sorted(map(tuple, tracks.placed(df, ["k"], "t", ["i"], w, "p").collect())) for w in (None, 2.0))
    assert a == b and [r[3] for r in sorted(a, key=lambda r: (r[0], r[1], r[2])) if r[0] == "a"] == list(range(sum(r[0] == "a" for r in a)))
