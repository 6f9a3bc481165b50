"""Shared pieces of the text operators: table access, checkpoints, word hashing.

Hashing works on whole Arrow buffers with numpy, so a batch of texts costs a
few vector passes and no per-word Python work.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: short lineage that outlives executors.

    Spark is asked to remove the shuffle files of the write when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewave-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    _WRITTEN[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() whose successors are written."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path in _WRITTEN:
            _delete(_WRITTEN.pop(path), path)


def written() -> set[str]:
    """The tables of cut() that there are, for drop_since()."""
    return set(_WRITTEN)


def drop_since(before: set[str], *keep: DataFrame) -> None:
    """Delete the tables written since, but those to keep."""
    for path in set(_WRITTEN) - before - {df._cut_path for df in keep}:
        _delete(_WRITTEN.pop(path), path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session is gone; nothing is left to clean
            return


# ---------------------------------------------------------------- hashing
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_MULT = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow = {"n": 0}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        size = max(n, 1 << 20)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            a = np.full(size, np.uint64(base), np.uint64)
            a[0] = 1
            _pow[key] = np.multiply.accumulate(a)
        _pow["n"] = size
    return _pow["up"], _pow["down"]


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of an Arrow string array; null counts as empty."""
    import pyarrow as pa

    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offs, data = array.buffers()
    offs = np.frombuffer(offs, np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of all texts, and n+1 word offsets by text."""
    n = len(offs) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    word = ~_WS[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOW[data]] * up[: len(data)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return h, np.searchsorted(starts, offs).astype(np.int64)


def shingle_sets(array, k: int, chunk: int = 1 << 20):
    """Yield for each text the sorted distinct 64-bit hashes of its k-word shingles.

    A text of 1 to k-1 words has its whole sequence as one shingle; one
    without words, or null, has the empty set.
    """
    at = 0
    lengths = np.diff(buffers(array)[1])
    while at < len(array):
        end, size = at, 0
        while end < len(array) and (end == at or size + lengths[end] <= chunk):
            size += lengths[end]
            end += 1
        h, w = word_hashes(*buffers(array.slice(at, end - at)))
        padded = np.concatenate([h, np.zeros(k, np.uint64)])
        whole = np.full(len(h), np.uint64(k), np.uint64)
        for j in range(k):
            whole += padded[j : j + len(h)] * _MULT[j]
        whole = mix(whole)
        for i in range(end - at):
            a, b = w[i], w[i + 1]
            if b - a >= k:
                yield np.unique(whole[a : b - k + 1])
            elif b > a:
                yield mix(np.array([sum(int(x) * int(_MULT[32 + j]) for j, x in enumerate(h[a:b])) + int(b - a) & 2**64 - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
        at = end
