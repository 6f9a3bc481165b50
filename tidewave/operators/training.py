"""Joint training of the heads: one loss over presence, motion and activity, by mini-batches.

Rows stay in Spark. They are dealt into batches once, written by batch, so an epoch
reads each row once; a step sums the gradients of its batches over all partitions and
only sums of the model's size reach the driver, where the weights are. A batch is a
share of the table, not a count, so the number of jobs does not grow with the rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folds import append_log
from . import metrics

#: Rows of the weights: presence, motion, then six activities; the last column is the bias.
HEADS = 8
TERMS = ("main", "presence", "motion", "activity")


@dataclass
class Plan:
    """What a run does. Weights of the classes, smoothing and shares of the loss; the schedule; the optimizer."""

    class_weights: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 1.5, 3.0)
    smoothing: float = 0.05
    gamma: float = 2.0
    share: float = 0.3
    ramp: int = 5
    phases: tuple[int, int, int] = (5, 50, 20)
    rate: float = 1.0  # times the schedule's
    decay: float = 1e-4
    betas: tuple[float, float] = (0.9, 0.999)
    average: tuple[float, float] = (0.999, 0.9999)  # of the weights, and in the last phase
    batches: int = 64
    accumulate: int = 4
    clip: float = 1.0
    seed: int = 42


@dataclass
class State:
    """All that a run goes on from; arrays as nested lists, so it is one line of JSON."""

    weights: list
    first: list
    second: list
    averaged: list
    steps: int = 0
    epoch: int = 0
    best_f1: float = -1.0
    best: list = field(default_factory=list)


# ---------------------------------------------------------------- the loss and its gradient
def forward(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(presence, motion, activities, probabilities of the eight classes) of rows x."""
    z = x @ w[:, :-1].T + w[:, -1]
    occ, dyn = (1 / (1 + np.exp(-np.clip(z[:, i], -500, 500))) for i in (0, 1))
    e = np.exp(z[:, 2:] - z[:, 2:].max(axis=1, keepdims=True))
    act = e / e.sum(axis=1, keepdims=True)
    return occ, dyn, act, np.column_stack([(occ * dyn)[:, None] * act, occ * (1 - dyn), 1 - occ])


def sums(w: np.ndarray, x: np.ndarray, y: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows x of classes y, by term: counts, losses, and gradients (terms, heads, features + 1)."""
    occ, dyn, act, p = forward(w, x)
    n, one = len(x), np.eye(8)[y]
    soft = (1 - plan.smoothing) * one + plan.smoothing / 8
    weight = np.array(plan.class_weights)[y][:, None]
    there, moving = y != 7, y < 6
    losses, counts = np.zeros(4), np.array([n, n, there.sum(), moving.sum()], float)
    d = np.zeros((4, n, HEADS))  # by logit

    safe = np.maximum(p, 1e-8)
    losses[0] = -(weight * soft * np.log(safe)).sum()
    g = np.where(p > 1e-8, -weight * soft / safe, 0.0)
    by_occ = (g[:, :6] * act).sum(1) * dyn + g[:, 6] * (1 - dyn) - g[:, 7]
    by_dyn = ((g[:, :6] * act).sum(1) - g[:, 6]) * occ
    d[0, :, 0], d[0, :, 1] = by_occ * occ * (1 - occ), by_dyn * dyn * (1 - dyn)
    by_act = g[:, :6] * (occ * dyn)[:, None]
    d[0, :, 2:] = act * (by_act - (by_act * act).sum(1, keepdims=True))

    for term, q, target, rows, head in ((1, occ, there, np.ones(n, bool), 0), (2, dyn, moving, there, 1)):
        inner = (q > 1e-7) & (q < 1 - 1e-7)
        r = np.clip(q, 1e-7, 1 - 1e-7)
        losses[term] = -np.where(target, np.log(r), np.log(1 - r))[rows].sum()
        d[term, :, head] = np.where(rows & inner, q - target, 0.0)

    k = np.minimum(y, 5)
    own = act[np.arange(n), k]
    safe = np.maximum(own, 1e-8)
    losses[3] = (-((1 - safe) ** plan.gamma) * np.log(safe))[moving].sum()
    slope = plan.gamma * (1 - safe) ** (plan.gamma - 1) * np.log(safe) - (1 - safe) ** plan.gamma / safe
    slope = np.where(moving & (own > 1e-8), slope * own, 0.0)
    d[3, :, 2:] = slope[:, None] * (np.eye(6)[k] - act)

    return counts, losses, np.einsum("tnh,nf->thf", d, np.column_stack([x, np.ones(n)]))


def batch_sums(rows: DataFrame, w: np.ndarray, vector: str, truth: str, plan: Plan) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """sums() of each batch, over all partitions; rows: batch, vector, truth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            number, y = b.column(0).to_numpy(), b.column(2).to_numpy()
            x = np.array(b.column(1).to_pylist(), float)
            for k in np.unique(number):
                own = number == k
                part = np.concatenate([a.ravel() for a in sums(w, x[own], y[own], plan)])
                totals[int(k)] = totals.get(int(k), 0.0) + part
        for k, v in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], ["batch", "i", "v"])

    parts = rows.select(F.col("batch").cast("int"), vector, F.col(truth).cast("int")).mapInArrow(run, "batch int, i int, v double")
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("batch", "i").agg(F.sum("v").alias("v")).collect():  # the model's size, for each batch of a step
        out.setdefault(r.batch, np.zeros(8 + 4 * w.size))[r.i] = r.v
    return {k: (v[:4], v[4:8], v[8:].reshape(4, *w.shape)) for k, v in out.items()}


def joint(counts: np.ndarray, parts: np.ndarray, epoch: int, plan: Plan) -> np.ndarray:
    """The joint loss (or its gradient) of a batch from sums by term; terms without rows count nothing."""
    ramp = min(epoch / max(plan.ramp, 1), 1.0)
    scale = np.array([1.0, *[ramp * plan.share] * 3]) / np.maximum(counts, 1.0)
    return np.tensordot(scale, parts, 1)


# ---------------------------------------------------------------- steps
def phase_of(epoch: int, plan: Plan) -> str:
    """The phase of an epoch, counted from 0."""
    warm, main, _ = plan.phases
    return "warmup" if epoch < warm else "main" if epoch < warm + main else "finetune"


def rate_of(epoch: int, plan: Plan) -> float:
    warm, main, fine = plan.phases
    if epoch < warm:
        return plan.rate * (1e-5 + (1e-4 - 1e-5) * epoch / max(warm - 1, 1))
    cosine = lambda e, n, hi, lo: lo + (hi - lo) * (1 + math.cos(math.pi * e / n)) / 2
    return plan.rate * (cosine(epoch - warm, main, 1e-4, 1e-6) if epoch < warm + main else cosine(epoch - warm - main, fine, 1e-5, 1e-7))


def step(state: State, gradient: np.ndarray, rate: float, keep: float, plan: Plan) -> None:
    """One step of Adam with decoupled decay on the clipped gradient; then the weights' average follows."""
    norm = float(np.sqrt((gradient**2).sum()))
    if norm > plan.clip:
        gradient = gradient * (plan.clip / (norm + 1e-6))
    state.steps += 1
    b1, b2 = plan.betas
    w, m, v, a = (np.array(x) for x in (state.weights, state.first, state.second, state.averaged))
    m, v = b1 * m + (1 - b1) * gradient, b2 * v + (1 - b2) * gradient**2
    w = w * (1 - rate * plan.decay) - rate * (m / (1 - b1**state.steps)) / (np.sqrt(v / (1 - b2**state.steps)) + 1e-8)
    keep = min(keep, (1 + state.steps) / (10 + state.steps))
    a = keep * a + (1 - keep) * w
    state.weights, state.first, state.second, state.averaged = (x.tolist() for x in (w, m, v, a))


def started(features: int, plan: Plan) -> State:
    w = np.random.default_rng(plan.seed).normal(0, 0.01, (HEADS, features + 1))
    w[:, -1] = 0
    return State(w.tolist(), np.zeros_like(w).tolist(), np.zeros_like(w).tolist(), w.tolist())


def predict(weights, df: DataFrame, vector: str) -> DataFrame:
    """df plus probs (eight classes, summing to 1) and pred."""
    w = np.array(weights)

    @F.pandas_udf("array<double>")
    def probs(x):
        import pandas as pd

        return pd.Series(list(forward(w, np.stack(x.to_numpy()))[3]) if len(x) else [], dtype=object)

    out = df.withColumn("probs", probs(vector))
    return out.withColumn("pred", metrics.argmax(F.col("probs")))


def macro_f1(weights, rows: DataFrame, vector: str, truth: str) -> float:
    cells = metrics.confusion(predict(weights, rows, vector).select(F.col(truth).cast("int").alias("truth"), "pred"), 8)
    return float(metrics.macro_f1(metrics.per_class(cells)).first().macro_f1 or 0.0)


# ---------------------------------------------------------------- a run
def in_batches(df: DataFrame, key: str, vector: str, truth: str, plan: Plan) -> DataFrame:
    """batch, vector, truth: rows dealt out by the key's hash."""
    return df.select(F.pmod(F.xxhash64(F.lit(plan.seed), key), F.lit(plan.batches)).cast("int").alias("batch"), vector, F.col(truth).cast("int").alias(truth))


def saved(spark, path: str) -> State | None:
    """The state after the last epoch that was written whole."""
    try:
        last = spark.read.parquet(f"{path}/state").orderBy(F.desc("epoch")).first()
    except AnalysisException:
        return None
    return State(**json.loads(last.state)) if last else None


def train_heads(train: DataFrame, val: DataFrame, key: str, vector: str, truth: str, path: str, plan: Plan | None = None, epochs: int | None = None) -> State:
    """Train on train, choose the epoch of the best macro F1 on val by averaged weights; goes on from what path holds.

    Under path: batches (train, by batch), state (a row for each epoch) and log (epoch,
    phase, losses of the terms, macro_f1, rate). epochs: stop after so many in all.
    """
    plan = plan or Plan()
    spark = train.sparkSession
    state = saved(spark, path)
    if state is None:
        in_batches(train, key, vector, truth, plan).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{path}/batches")
        state = started(len(train.select(vector).first()[0]), plan)
    rows = spark.read.parquet(f"{path}/batches")
    there = sorted(r.batch for r in rows.select("batch").distinct().collect())  # batches, not rows
    stop = sum(plan.phases) if epochs is None else min(epochs, sum(plan.phases))
    while state.epoch < stop:
        epoch = state.epoch
        rate, keep = rate_of(epoch, plan), plan.average[phase_of(epoch, plan) == "finetune"]
        order = np.random.default_rng([plan.seed, epoch]).permutation(there)
        losses = np.zeros(5)
        for i in range(0, len(order), plan.accumulate):
            wanted = order[i : i + plan.accumulate].tolist()
            found = batch_sums(rows.where(F.col("batch").isin(wanted)), np.array(state.weights), vector, truth, plan)
            gradient = sum(joint(c, g, epoch + 1, plan) for c, _, g in found.values()) / plan.accumulate
            losses += sum(np.append(loss / np.maximum(c, 1), joint(c, loss, epoch + 1, plan)) for c, loss, _ in found.values())
            step(state, gradient, rate, keep, plan)
        f1 = macro_f1(state.averaged, val, vector, truth)
        state.epoch += 1
        if f1 > state.best_f1:
            state.best_f1, state.best = f1, state.averaged
        names = [*TERMS, "total"]
        row = [(state.epoch, phase_of(epoch, plan), *(losses / max(len(order), 1)).tolist(), f1, rate)]
        append_log(spark.createDataFrame(row, "epoch int, phase string, " + ", ".join(f"{n} double" for n in names) + ", macro_f1 double, rate double"), f"{path}/log")
        spark.createDataFrame([(state.epoch, json.dumps(asdict(state)))], "epoch int, state string").coalesce(1).write.mode("append").parquet(f"{path}/state")
    return state
