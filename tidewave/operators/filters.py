"""Zero-phase filters over tracks of any length, cut into pieces that are filtered side by side.

A recursive filter is a linear system: over a piece of n samples its state goes from
s to A^n s + f, where f depends on the samples alone, and the output is that from rest
plus that of the state at the piece's begin. Pieces note n and f, the notes of a track
are chained, and with its own begin each piece is filtered by two matrix products.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels as K
from . import tracks


class System:
    """State-space matrices of second-order sections in a row, for pieces of up to `length` samples."""

    def __init__(self, sos: np.ndarray, length: int):
        n = 2 * len(sos)
        # columns: the unit states with no input, then rest with input 1
        states, x = np.hstack([np.eye(n), np.zeros((n, 1))]), np.append(np.zeros(n), 1.0)
        after = np.empty_like(states)
        for i, (b0, b1, b2, a1, a2) in enumerate(sos):
            s0, s1 = states[2 * i : 2 * i + 2]
            y = b0 * x + s0
            after[2 * i], after[2 * i + 1] = b1 * x - a1 * y + s1, b2 * x - a2 * y
            x = y
        self.a, self.b, self.length = after[:, :n], after[:, n], length
        #: output i places on of the state at the begin, and of an input
        self.of_state = np.empty((length, n))
        row = x[:n]
        for i in range(length):
            self.of_state[i], row = row, row @ self.a
        echo = np.append(x[n], self.of_state[:-1] @ self.b)
        at = np.arange(length)
        self.of_input = np.where(at[:, None] >= at, echo[np.maximum(at[:, None] - at, 0)], 0.0)
        #: what an input leaves in the state after the last place of a whole piece
        self.left = np.empty((length, n))
        column = self.b
        for i in range(length - 1, -1, -1):
            self.left[i], column = column, self.a @ column
        self.steady = K.steady_state(sos).ravel()

    @functools.cached_property
    def over_piece(self) -> np.ndarray:
        return np.linalg.matrix_power(self.a, self.length)


@functools.lru_cache(maxsize=8)
def system(sos: tuple, length: int) -> System:
    return System(np.array(sos), length)


def butterworth_sections(kind: str, rate: float = 350.0) -> tuple:
    """The low-pass (30 Hz) or band-pass (0.5 to 80 Hz) of order 4."""
    sos = K.sections(*K.butterworth(4, (30.0,) if kind == "low" else (0.5, 80.0), rate))
    return tuple(map(tuple, sos.tolist()))


def _padded(x: np.ndarray, starts: np.ndarray, length: int, right: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments as rows of equal length, zeros after them or before; and where each sample went."""
    sizes = np.diff(np.append(starts, len(x)))
    row = np.repeat(np.arange(len(starts)), sizes)
    column = np.arange(len(x)) - np.repeat(starts, sizes)
    column = column if right else column + np.repeat(length - sizes, sizes)
    out = np.zeros((len(starts), length))
    out[row, column] = x
    return out, row, column


def _pass(df: DataFrame, by: list[str], place: str, x: str, out: str, sos: tuple, length: int) -> DataFrame:
    """df plus out: x filtered along place, from the steady state of its first sample."""
    rows = df.withColumn("__piece", F.floor(F.col(place) / length))
    fields = {f.name: f for f in rows.schema.fields}
    names = [fields[c] for c in [*by, "__piece"]]
    state = T.StructField("__state", T.ArrayType(T.DoubleType()))

    def note(t: pa.Table, starts: np.ndarray) -> pa.Table:
        own = system(sos, length)
        values = tracks.numbers(t[x])
        states = _padded(values, starts, length, right=False)[0] @ own.left
        heads = t.take(pa.array(starts)).select([*by, "__piece"])
        heads = heads.append_column("__n", pa.array(np.diff(np.append(starts, len(values))), pa.int64())).append_column("__first", pa.array(values[starts]))
        return heads.append_column("__state", pa.array(list(states), pa.list_(pa.float64())))

    def chain(t: pa.Table, starts: np.ndarray) -> pa.Table:
        own = system(sos, length)
        n, first, forced = t["__n"].to_pylist(), t["__first"].to_pylist(), t["__state"].to_pylist()
        begins, out, s = set(starts.tolist()), [], None
        for i in range(len(n)):
            s = own.steady * first[i] if i in begins else s
            out.append(s)
            s = (own.over_piece if n[i] == length else np.linalg.matrix_power(own.a, n[i])) @ s + forced[i]
        return t.select([*by, "__piece"]).append_column("__state", pa.array(out, pa.list_(pa.float64())))

    def run(t: pa.Table, starts: np.ndarray) -> pa.Table:
        own = system(sos, length)
        states = np.array(t["__state"].take(pa.array(starts)).to_pylist())
        kept = np.ones(t.num_rows, bool)
        kept[starts] = False  # the row with the state
        samples = t.filter(pa.array(kept)).drop_columns(["__state", "__mark"])
        padded, row, column = _padded(tracks.numbers(samples[x]), starts - np.arange(len(starts)), length, right=True)
        y = padded @ own.of_input.T + states @ own.of_state.T
        return samples.append_column(out, pa.array(y[row, column]))

    notes = tracks.segmented(rows.select(*by, "__piece", place, x), [*by, "__piece"], [place], note, T.StructType([*names, T.StructField("__n", T.LongType()), T.StructField("__first", T.DoubleType()), state]))
    begins = tracks.segmented(notes, by, ["__piece"], chain, T.StructType([*names, state]))
    marked = rows.withColumn("__mark", F.lit(1)).unionByName(begins.withColumn("__mark", F.lit(0)), allowMissingColumns=True)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])
    return tracks.segmented(marked, [*by, "__piece"], ["__mark", place], run, schema).drop("__piece")


def zero_phase(df: DataFrame, by: list[str], time: str, value: str, sos: tuple, order: tuple[str, ...] = (), width: float | None = None, length: int = 256) -> DataFrame:
    """by, time, order, value, filtered: forward and backward along each track, with an odd extension at both ends.

    The extension has three samples for each coefficient of the whole filter; tracks that
    are no longer than that have null for filtered. Pieces have `length` samples, and with
    a `width` of time no task gathers a track.
    """
    lead = 3 * (2 * len(sos) + 1)
    rows = df.select(*by, time, *order, F.col(value).cast("double").alias(value))
    rows = tracks.placed(rows, by, time, list(order), width, "__i")
    ends = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.min_by(value, "__i").alias("__first"), F.max_by(value, "__i").alias("__last"))
    rows = tracks.joined(rows, ends, by)
    i, n, v = F.col("__i"), F.col("__n"), F.col(value)
    spot = lambda at, x, own: F.struct(at.cast("long").alias("at"), x.alias("x"), F.lit(own).alias("own"))
    left = F.when((i >= 1) & (i <= lead), spot(lead - i, 2 * F.col("__first") - v, False))
    right = F.when((i <= n - 2) & (i >= n - 1 - lead), spot(lead + 2 * (n - 1) - i, 2 * F.col("__last") - v, False))
    whole = rows.where(n > lead).withColumn("__s", F.explode(F.array_compact(F.array(spot(lead + i, v, True), left, right))))
    whole = whole.select(*by, time, *order, value, (n + 2 * lead).alias("__n"), F.col("__s.at").alias("__at"), F.col("__s.x").alias("__x"), F.col("__s.own").alias("__own"))
    there = _pass(whole, by, "__at", "__x", "__y", sos, length).withColumn("__back", F.col("__n") - 1 - F.col("__at"))
    back = _pass(there, by, "__back", "__y", "filtered", sos, length).where("__own")
    short = rows.where(n <= lead).withColumn("filtered", F.lit(None).cast("double"))
    columns = [*by, time, *order, value, "filtered"]
    return back.select(*columns).unionByName(short.select(*columns))
