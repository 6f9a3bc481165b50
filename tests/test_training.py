"""Joint training of the heads: the loss against the columns' losses, gradients against differences, runs that go on."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import metrics, training as R

D = 5


def rows(rng, n=60):
    y = rng.integers(0, 8, n)
    x = rng.normal(size=(n, D)) + np.eye(8)[y][:, :D] * 2
    return x, y


@pytest.mark.parametrize("epoch", [0, 2, 9])
def test_gradients_equal_differences(epoch):
    rng, plan = np.random.default_rng(1), R.Plan()
    x, y = rows(rng)
    w = rng.normal(size=(R.HEADS, D + 1))
    counts, losses, grads = R.sums(w, x, y, plan)
    whole = R.joint(counts, grads, epoch, plan)
    value = lambda w: R.joint(*R.sums(w, x, y, plan)[:2], epoch, plan)
    for h in range(R.HEADS):
        for f in range(D + 1):
            e = np.zeros_like(w)
            e[h, f] = 1e-6
            assert whole[h, f] == pytest.approx((value(w + e) - value(w - e)) / 2e-6, abs=1e-6)
    assert np.isfinite(R.sums(w * 300, x, y, plan)[2]).all()  # saturated heads


def test_the_loss_is_that_of_the_columns(spark):
    rng, plan = np.random.default_rng(2), R.Plan()
    x, y = rows(rng)
    w = rng.normal(size=(R.HEADS, D + 1))
    counts, losses, _ = R.sums(w, x, y, plan)
    occ, dyn, act, p = R.forward(w, x)
    df = spark.createDataFrame([(int(t), *map(float, (o, m)), a.tolist(), q.tolist()) for t, o, m, a, q in zip(y, occ, dyn, act, p)], "y int, o double, m double, a array<double>, p array<double>")
    flag = lambda c: c.cast("int").cast("double")
    t = F.col("y")
    got = df.agg(
        F.avg(metrics.smoothed_loss(F.col("p"), t, list(plan.class_weights))), F.avg(metrics.binary_loss(F.col("o"), flag(t != 7))),
        F.avg(F.when(t != 7, metrics.binary_loss(F.col("m"), flag(t < 6)))), F.avg(F.when(t < 6, metrics.focal_loss(F.get("a", t)))),
    ).first()
    assert list(got) == pytest.approx((losses / counts).tolist())


def test_partitions_add_up(spark):
    rng, plan = np.random.default_rng(3), R.Plan(batches=3)
    x, y = rows(rng, 200)
    w = rng.normal(size=(R.HEADS, D + 1))
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    dealt = R.in_batches(df, "id", "x", "y", plan)
    found = R.batch_sums(dealt.repartition(7), w, "x", "y", plan)
    assert sorted(found) == [0, 1, 2] and sum(c[0] for c, _, _ in found.values()) == 200
    for b, (counts, losses, grads) in found.items():
        own = dealt.where(F.col("batch") == b).collect()
        want = R.sums(w, np.array([r.x for r in own]), np.array([r.y for r in own]), plan)
        assert np.allclose(counts, want[0]) and np.allclose(losses, want[1]) and np.allclose(grads, want[2])


def test_steps_clip_and_average():
    plan = R.Plan()
    state = R.started(D, plan)
    w = np.array(state.weights)
    g = np.full(w.shape, 3.0)
    R.step(state, g, 0.1, 0.999, plan)
    first = np.array(state.first) / (1 - plan.betas[0])
    assert np.sqrt((first**2).sum()) == pytest.approx(plan.clip, rel=1e-5)
    new = np.array(state.weights)
    assert new == pytest.approx(w * (1 - 0.1 * plan.decay) - 0.1, abs=1e-6)  # Adam's first step has the rate's length
    keep = 2 / 11
    assert np.array(state.averaged) == pytest.approx(keep * w + (1 - keep) * new)


def test_phases():
    plan = R.Plan()
    assert [R.phase_of(e, plan) for e in (0, 4, 5, 54, 55, 74)] == ["warmup", "warmup", "main", "main", "finetune", "finetune"]
    assert [R.rate_of(e, plan) for e in (0, 4, 5, 30, 55)] == pytest.approx([1e-5, 1e-4, 1e-4, 5.05e-5, 1e-5])


def test_a_run_learns_and_goes_on(spark, tmp_path):
    rng = np.random.default_rng(4)
    y = np.arange(400) % 8
    x = rng.normal(size=(400, 8)) * 0.3 + np.eye(8)[y] * 2
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y int")
    train, val = df.where("id div 8 % 4 > 0"), df.where("id div 8 % 4 = 0")
    plan = R.Plan(phases=(1, 4, 1), rate=2000.0, batches=8, accumulate=4)
    whole = R.train_heads(train, val, "id", "x", "y", str(tmp_path / "a"), plan)
    log = spark.read.parquet(str(tmp_path / "a/log")).orderBy("epoch").collect()
    assert len(log) == 6 and log[-1].main < 0.7 * log[0].main and log[-1].total < log[0].total * 1.2
    assert whole.best_f1 == max(r.macro_f1 for r in log) > 0.9 and [r.phase for r in log] == ["warmup", *["main"] * 4, "finetune"]
    R.train_heads(train, val, "id", "x", "y", str(tmp_path / "b"), plan, epochs=2)
    again = R.train_heads(train, val, "id", "x", "y", str(tmp_path / "b"), plan)
    assert again.epoch == 6 and np.allclose(again.weights, whole.weights) and again.steps == whole.steps == 12
    assert R.macro_f1(again.best, val, "x", "y") == pytest.approx(whole.best_f1)
    pred = R.predict(whole.best, val, "x")
    assert pred.where(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, p: a + p) - 1) > 1e-9).isEmpty()
