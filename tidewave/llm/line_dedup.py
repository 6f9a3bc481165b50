"""Lines that many documents share: kept in one document, dropped from the others.

Line hashes are range-partitioned with the document as second key, so that a line
of a third of all documents spreads over tasks, and sorted within each task by
hash, document (largest first) and position. A stream over the sorted rows then
keeps the first document of each run. Only the runs at a task's edges may go on
in the next task: these carry a summary (two a task), and are decided after the
summaries are added. Decisions come back as compressed bitmaps of lines to keep;
texts are never sorted.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"
DROP, OPEN, RUN = 0, 1, 2
_FLAT = "kind tinyint, h1 long, h2 long, doc_id long, text_key long, at long"
_NAMES = ["kind", "h1", "h2", "doc_id", "text_key", "at"]


def _documents(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, doc_id, text_key, at: the 128-bit hash and place of every line whose key has min_chars code points."""
    lines = _documents(docs).select("doc_id", "text_key", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = F.translate(F.btrim("line", F.lit(_BLANKS)), _UPPER, _UPPER.lower())
    keys = lines.select("doc_id", "text_key", F.col("at").cast("long").alias("at"), key.alias("key")).where(F.length("key") >= min_chars)
    return keys.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc_id", "text_key", "at")


def _stream(min_docs: int):
    """Over rows sorted by h1, h2, doc_id (descending, null last): rows to drop, rows of edge runs, summaries of edge runs."""

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        doc = batch.column(2)
        own = [batch.column(i).to_numpy() for i in (0, 1)]
        return [*own, doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy(), *(batch.column(i).to_numpy() for i in (3, 4))]

    def emitted(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
        h1, h2, null, doc, key, at = cols
        arrays = [np.full(len(h1), kind, np.int8), h1, h2, pa.array(doc, mask=null), key, at]
        return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], _NAMES)

    def run(batches):
        first = None  # hash of the task's first run
        in_first, first_docs, first_top, last = True, 0, None, None
        cur, seen, top, held = None, 0, None, None  # the run that the last batch ended in, its documents so far, its largest one, its undecided rows
        for batch in batches:
            cols = columns(batch)
            if not len(cols[0]):
                continue
            if in_first:
                if first is None:
                    first, first_top = (cols[0][0], cols[1][0]), (cols[2][0], cols[3][0])
                same = (cols[0] == first[0]) & (cols[1] == first[1])
                n = len(same) if same.all() else int(same.argmin())
                if n:
                    null, doc = cols[2][:n], cols[3][:n]
                    new = np.ones(n, bool)
                    new[1:] = (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
                    new[0] = last != (null[0], doc[0])
                    first_docs, last = first_docs + int(new.sum()), (null[-1], doc[-1])
                    yield emitted(OPEN, [c[:n] for c in cols])
                if n == len(same):
                    continue
                in_first, cols = False, [c[n:] for c in cols]
            if held is not None:
                cols, cur = [np.concatenate(pair) for pair in zip(held, cols)], None
            h1, h2, null, doc = cols[:4]
            start = np.ones(len(h1), bool)
            start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new = start.copy()
            new[1:] |= (doc[1:] != doc[:-1]) | (null[1:] != null[:-1])
            goes_on = cur == (h1[0], h2[0])
            if goes_on:
                new[0] = last != (null[0], doc[0])
            which = np.cumsum(start) - 1
            begins = np.flatnonzero(start)
            count = np.cumsum(new)
            base = count[begins] - 1
            if goes_on:
                base[0] = -seen
            place = count - base[which]  # of the row's document in its run, from 1
            total = place[np.append(begins[1:], len(h1)) - 1]
            gone = (total[which] >= min_docs) & (place > 1)
            if gone.any():
                yield emitted(DROP, [c[gone] for c in cols])
            if not (goes_on and len(begins) == 1):
                top = null[begins[-1]], doc[begins[-1]]
            cur, seen, last = (h1[-1], h2[-1]), int(total[-1]), (null[-1], doc[-1])
            held = [c[begins[-1] :] for c in cols] if seen < min_docs else None
        if held is not None:
            yield emitted(OPEN, held)
        for hashes, docs, (null, doc) in ([(first, first_docs, first_top)] if first else []) + ([(cur, seen, top)] if not in_first else []):
            yield emitted(RUN, [np.array([x]) for x in (*hashes, bool(null), doc, 0, docs)])

    return run


@F.pandas_udf(T.BinaryType())
def _packed(places: pd.Series) -> pd.Series:
    """Places to drop -> a compressed bitmap, a set bit for each line to keep; lines beyond its end are kept."""

    def pack(dropped) -> bytes:
        keep = np.ones(int(max(dropped)) // 8 * 8 + 8, bool)
        keep[np.asarray(dropped)] = False
        return zlib.compress(np.packbits(keep).tobytes())

    return places.map(pack)


def kept_lines(text: str, keep: bytes) -> str:
    lines = text.split("\n")
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)].astype(bool)
    return "\n".join([line for line, bit in zip(lines, bits) if bit] + lines[len(bits) :])


@F.pandas_udf(T.StringType())
def _thinned(text: pd.Series, keep: pd.Series) -> pd.Series:
    return pd.Series([None if k is None else kept_lines(t, k) for t, k in zip(text, keep)], dtype=object)


def line_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text_key, n_dropped, keep: the texts that lose lines, and which lines they keep (written).

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at
    least min_chars code points in at least min_docs documents stay in the largest
    doc_id alone. Rows of one doc_id count as one document; null ids are one document
    below all others. text_key is the text's hash, so rows of one doc_id with several
    texts keep their own bitmaps and equal rows share one. Null and empty texts are one
    empty line; an empty table gives no bitmaps; long texts are so many more rows.
    """
    lines = cut(line_hashes(docs, min_chars))
    dealt = lines.repartitionByRange("h1", "h2", F.desc_nulls_last("doc_id")).sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "text_key", "at")
    found = cut(dealt.mapInArrow(_stream(min_docs), _FLAT))
    drop(lines)
    # two summaries a task at most
    runs = found.where(F.col("kind") == RUN).groupBy("h1", "h2").agg(F.sum("at").alias("n"), F.max("doc_id").alias("top"))
    late = found.where(F.col("kind") == OPEN).join(F.broadcast(runs), ["h1", "h2"]).where((F.col("n") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("top")))
    gone = found.where(F.col("kind") == DROP).select("doc_id", "text_key", "at").unionByName(late.select("doc_id", "text_key", "at"))
    places = gone.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("places"))  # lines of one text
    out = cut(places.select("doc_id", "text_key", F.size("places").cast("long").alias("n_dropped"), _packed("places").alias("keep")))
    drop(found)
    return out


def thinned(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, text, n_lines (before dropping), n_dropped: a row for each row of docs, texts without the lines that bitmaps drop.

    Other columns of docs are not read, so their names cannot clash.
    """
    b = bitmaps.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "n_dropped", "keep")
    # each text moves once, or not at all where Spark finds the bitmaps small enough to send
    both = _documents(docs).join(b, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    # texts that keep all their lines stay in the JVM
    text = F.coalesce(_thinned(F.when(F.col("keep").isNotNull(), F.col("text")), "keep"), "text")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", text.alias("text"), n_lines.cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, text, n_lines, n_dropped of every row: line_bitmaps() applied by thinned()."""
    return thinned(docs, line_bitmaps(docs, min_chars, min_docs))
