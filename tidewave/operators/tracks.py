"""Long tracks in pieces: places along a track, halos of neighbours, kernels over whole segments.

A track (recording, receiver, antenna) is usually some seconds long and fits anywhere.
These helpers are for those that do not: nothing here gathers a track in one task when
a width is given.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slot(x: Column, width: float | None) -> Column:
    """The piece of a track that x falls in; one piece without a width."""
    return F.lit(0).cast("long") if width is None else F.floor(x / F.lit(float(width))).cast("long")


def placed(df: DataFrame, by: list[str], time: str, order: list[str], width: float | None, name: str) -> DataFrame:
    """df plus name: the place of each row in its track, from 0, by time and then by order.

    With a width, rows are ranked in slots of time, and each slot starts at the count of
    the rows in those before it, of which a track has a few.
    """
    rows = df.withColumn("__slot", slot(F.col(time), width))
    own = F.row_number().over(Window.partitionBy(*by, "__slot").orderBy(time, *order)) - 1
    if width is None:
        return rows.withColumn(name, own.cast("long")).drop("__slot")
    counts = rows.groupBy(*by, "__slot").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, "__slot", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"))
    return joined(rows, counts, [*by, "__slot"]).withColumn(name, (own + F.col("__before")).cast("long")).drop("__slot", "__before")


def joined(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """df with other's columns, joined on keys of which null equals null."""
    names = {k: f"__key_{k}" for k in keys}
    other = other.withColumnsRenamed(names)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()))
    return df.join(other, same).drop(*names.values())


def with_halos(df: DataFrame, place: str, length: int, halo: int) -> DataFrame:
    """df plus __piece and __own: rows in pieces of `length` places (halo at least), those within `halo` of another piece there too."""
    at, size = F.col(place), F.lit(max(length, halo))
    pieces = F.array_distinct(F.array(F.floor(at / size), F.floor(F.greatest(at - halo, F.lit(0)) / size), F.floor((at + halo) / size)))
    rows = df.withColumn("__piece", F.explode(pieces))
    return rows.withColumn("__own", F.col("__piece") == F.floor(at / size))


def segmented(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """kernel(rows, starts) over whole segments of rows with equal keys, sorted by order; many small segments share a call.

    Rows of a segment that Arrow batches cut are held until it ends, so segments, and not
    tracks, must fit in memory.
    """

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if not rows.num_rows:
                continue
            starts = np.flatnonzero(_changes(rows, keys))
            held = rows.slice(starts[-1])
            if len(starts) > 1:
                yield from kernel(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1]).to_batches()
        if held is not None:
            yield from kernel(held.combine_chunks(), np.zeros(1, np.int64)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _changes(rows: pa.Table, keys: list[str]) -> np.ndarray:
    out = np.zeros(rows.num_rows, bool)
    out[0] = True
    for key in keys:
        column = rows[key].combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        null = pc.xor(pc.is_null(a), pc.is_null(b))
        out[1:] |= pc.or_(pc.fill_null(pc.not_equal(a, b), False), null).to_numpy(zero_copy_only=False)
    return out


def ends_of(starts: np.ndarray, n: int) -> np.ndarray:
    return np.append(starts[1:], n)


def numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Doubles, null as NaN."""
    return pc.cast(column, pa.float64()).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.cast(pa.float64()).to_numpy()
