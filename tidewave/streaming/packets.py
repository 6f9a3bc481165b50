"""Streams of packets (an extension: the batch operators have no streaming counterpart in the blueprint).

Built-in windows carry late data under a watermark; the anchored merge keeps
the open group of each recording as state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def window_statistics(stream: DataFrame, by: list[str], time: str, value: str, length: str, slide: str, late: str) -> DataFrame:
    """by, start, n, mean, variance for overlapping event-time windows; packets later than `late` are dropped."""
    g = stream.withWatermark(time, late).groupBy(*by, F.window(time, length, slide).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance")).select(*by, F.col("w.start").alias("start"), "n", "mean", "variance")


def merged_packets(stream: DataFrame, key: str, time: str, item: str, span: float, late: str) -> DataFrame:
    """key, group_start, items: packets within `span` seconds of their group's first, as in the batch merge.

    Packets wait until the watermark passes them, so that they are merged in
    order of time; a group is given out once a packet beyond it has come or the
    watermark has passed its end. `item` is a long column.
    """
    schema = f"{key} string, group_start double, items array<long>"
    # state: parallel arrays of waiting packets, the open group's start and items
    held = "times array<double>, waiting array<long>, start double, items array<long>"

    def run(name, batches, state: GroupState):
        times, waiting, start, items = state.get if state.exists else ([], [], None, [])
        packets = list(zip(times, waiting))
        for pdf in batches:
            packets += zip(pdf["__t"].tolist(), pdf[item].tolist())
        packets.sort()
        mark = state.getCurrentWatermarkMs() / 1000
        out = []
        ready = [p for p in packets if p[0] <= mark]
        items = list(items or [])
        for t, x in ready:
            if start is not None and t - start <= span:
                items.append(x)
            else:
                if start is not None:
                    out.append((name[0], start, items))
                start, items = t, [x]
        if start is not None and start + span < mark:
            out.append((name[0], start, items))
            start, items = None, []
        rest = packets[len(ready) :]
        if rest or start is not None:
            state.update(([t for t, _ in rest], [x for _, x in rest], start, items))
            due = min([t for t, _ in rest[:1]] + ([start + span] if start is not None else []))
            state.setTimeoutTimestamp(max(int(due * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[key, "group_start", "items"])

    timed = stream.withWatermark(time, late).select(F.col(key).cast("string").alias(key), time, F.col(item).cast("long").alias(item), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("__t"))
    return timed.groupBy(key).applyInPandasWithState(run, schema, held, "append", GroupStateTimeout.EventTimeTimeout)
