"""Array files (.npy, .npz, .mat) as frame rows."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import matlab

FRAMES = "path string, t_idx int, rx int, ant int, re array<double>, im array<double>"
# Names under which array files hold their samples, in the order of the search; else the first that has no leading '_'.
NPZ_KEYS = ("csi",)
MAT_KEYS = {"narrow": ("csi_trace", "csi", "data", "WiFiCSI"), "wide": ("csi", "CSI", "data")}


def load(content: bytes, name: str, shape: str = "narrow") -> np.ndarray:
    if name.lower().endswith(".mat"):
        data, keys = matlab.variables(content), MAT_KEYS[shape]
    else:
        data, keys = np.load(io.BytesIO(content), allow_pickle=False), NPZ_KEYS
    if not isinstance(data, np.ndarray):
        names = [*data]
        key = next((k for k in keys if k in names), next((k for k in names if not k.startswith("_")), None))
        if key is None:
            raise ValueError(f"{name} holds no array")
        data = data[key]
    return data.astype(np.complex128)


def narrow(a: np.ndarray, bins: int = 30) -> np.ndarray | None:
    """(T, F, M, A) from (T,1,M,A,F), (T,M,A,F), (T,F,M,A) or (T, F*9); None for other shapes."""
    if a.ndim == 5:
        a = a[:, 0]
    if a.ndim == 4:
        if a.shape[1] == bins:
            return a
        return np.moveaxis(a, 3, 1) if a.shape[3] == bins else None
    return a.reshape(len(a), bins, 3, 3) if a.ndim == 2 and a.shape[1] == bins * 9 else None


def wide(a: np.ndarray, bins: int = 2048) -> np.ndarray | None:
    """(T, F, A) of one receiver from (T, F), (T, F, A), (T, A, F), (T, 1, F, A) or (T, streams, antennas, F); None for other ranks."""
    if a.ndim == 4:
        a = a.reshape(len(a), -1, a.shape[-1])
        return a if a.shape[1] == bins else np.moveaxis(a, 2, 1)
    if a.ndim == 2:
        return a[:, :, None]
    if a.ndim != 3:
        return None
    return np.moveaxis(a, 2, 1) if a.shape[2] > a.shape[1] else a


def fitted(a: np.ndarray, axis: int, size: int) -> np.ndarray:
    """Cut to, or filled with zeros up to, size along an axis."""
    a = np.take(a, range(min(size, a.shape[axis])), axis)
    return np.pad(a, [(0, size - a.shape[axis]) if i == axis else (0, 0) for i in range(a.ndim)])


def read_arrays(spark: SparkSession, path: str, shape: str = "narrow", antennas: int = 4, receiver: int = 0, rate: float | None = None) -> DataFrame:
    """One row for each (file, t_idx, rx, ant), with ts if a rate is given. Files that cannot be read, or of other shapes, give no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                try:
                    a = load(content, name, shape)
                except (ValueError, OSError, zipfile.BadZipFile):
                    continue
                a = narrow(a) if shape == "narrow" else wide(a)
                if a is None:
                    continue
                a = fitted(a if a.ndim == 4 else a[:, :, None], 3, antennas)
                t, _, m, n = a.shape
                for at in range(0, t, 512):
                    part = np.moveaxis(a[at : at + 512], 1, 3).reshape(-1, a.shape[1])
                    index = np.indices((len(part) // (m * n), m, n)).reshape(3, -1)
                    yield pd.DataFrame({"path": name, "t_idx": index[0] + at, "rx": index[1] + (receiver if shape == "wide" else 0), "ant": index[2], "re": list(part.real), "im": list(part.imag)})

    frames = files.mapInPandas(run, FRAMES)
    return frames if rate is None else timed(frames, rate)


def timed(frames: DataFrame, rate: float) -> DataFrame:
    """frames plus ts: seconds from the file's begin, at a constant rate; array files have no times of their own."""
    return frames.withColumn("ts", F.col("t_idx") / rate)


def array_recordings(files: DataFrame, classes: tuple[tuple[str, int], ...], root: str = "") -> DataFrame:
    """path -> recording_id, person, room, class_id: array files by activity folder, or by a label in the name where no folder has one.

    The folder's name is the activity; files right under root have none. Person is the stem before the first '_'.
    """
    from ..operators.split import mapped_class

    rows = files.select("path").where(F.lower("path").rlike(r"\.(npy|npz|mat)$"))
    inner = F.substring(F.col("path"), F.lit(len(root) + 1), F.length("path"))
    rows = rows.withColumn("folder", F.regexp_extract(inner, r"^/?([^/]+)/[^/]+$", 1)).withColumn("recording_id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1))
    named = mapped_class(rows.withColumn("folder", F.nullif("folder", F.lit(""))), "folder", classes, blanks=" ")
    flat = F.coalesce(*(F.when(F.lower("recording_id").contains(name.replace(" ", "_")), value) for name, value in classes))
    any_ = named.agg(F.coalesce(F.max(F.col("class_id").isNotNull()), F.lit(False)).alias("any")).first()[0]
    found = named if any_ else named.withColumn("class_id", flat)
    person = F.element_at(F.split("recording_id", "_"), 1)
    return found.where("class_id is not null").select("path", "recording_id", person.alias("person"), F.lit("default").alias("room"), "class_id")
