"""Sinks and their readers: fold tables, statistics, summaries, logs."""

from __future__ import annotations

import json
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Splits that every fold has, with or without rows.
SPLITS = ("train", "val", "test")


def store(spark: SparkSession, path: str):
    """The file system of path, and the path, by Spark's own classes."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _text(fs, path) -> str:
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def committed(spark: SparkSession, path: str) -> dict[int, dict]:
    """The manifest of every fold that was written whole: fold, attempt, schema, splits (recordings and windows by split), attributes."""
    fs, root = store(spark, f"{path}/_manifests")
    out = {}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        if status.getPath().getName().endswith(".json"):
            try:
                found = json.loads(_text(fs, status.getPath()))
            except ValueError:  # being written
                continue
            out[found["fold"]] = found
    return out


def stage_fold(df: DataFrame, path: str) -> str:
    """Write df under path as an attempt that no reader sees; its name. If the job fails, what it wrote goes."""
    attempt = uuid.uuid4().hex
    try:
        df.write.partitionBy("fold", "split").option("compression", "zstd").parquet(f"{path}/attempt={attempt}")
    except BaseException:
        discard(df.sparkSession, f"{path}/attempt={attempt}")
        raise
    return attempt


def discard(spark: SparkSession, path: str) -> None:
    fs, p = store(spark, path)
    fs.delete(p, True)


def commit_folds(spark: SparkSession, path: str, attempt: str, overwrite: bool = False, **attributes) -> list[int]:
    """Give the folds of an attempt their manifests, last of all; the folds that are this attempt's now.

    The first manifest of a fold stays: another attempt's rows for it are deleted, unless
    asked to overwrite, when the earlier attempt's are.
    """
    try:
        rows = spark.read.option("basePath", path).parquet(f"{path}/attempt={attempt}")
    except AnalysisException:  # no rows at all
        discard(spark, f"{path}/attempt={attempt}")
        return []
    n = F.countDistinct("recording_id") if "recording_id" in rows.columns else F.lit(None).cast("long")
    counts = rows.groupBy("fold", "split").agg(n.alias("recordings"), F.count(F.lit(1)).alias("windows")).collect()  # splits of folds
    schema = rows.drop("attempt", "fold", "split").schema.json()
    earlier, won = committed(spark, path), []
    for fold in sorted({r.fold for r in counts}):
        splits = {s: {"recordings": 0, "windows": 0} for s in SPLITS} | {r.split: {"recordings": r.recordings, "windows": r.windows} for r in counts if r.fold == fold}
        text = json.dumps({"fold": fold, "attempt": attempt, "schema": json.loads(schema), "splits": splits, "attributes": attributes})
        fs, p = store(spark, f"{path}/_manifests/fold={fold}.json")
        try:
            stream = fs.create(p, overwrite)
        except Py4JJavaError:
            if not fs.exists(p):
                raise
            discard(spark, f"{path}/attempt={attempt}/fold={fold}")
            continue
        stream.write(bytearray(text.encode()))
        stream.close()
        won.append(fold)
        if overwrite and fold in earlier:
            discard(spark, f"{path}/attempt={earlier[fold]['attempt']}/fold={fold}")
    return won


def write_fold(df: DataFrame, path: str, overwrite: bool = False, **attributes) -> list[int]:
    """Window features by fold and split; folds that were written whole stay unless asked, others are added. The folds written.

    An attempt is staged, then committed, so a job that fails leaves nothing to readers,
    and of two writers of one fold the first to commit stays.
    """
    spark = df.sparkSession
    there = [] if overwrite else sorted(committed(spark, path))
    attempt = stage_fold(df.where(~F.col("fold").isin(there)) if there else df, path)
    return commit_folds(spark, path, attempt, overwrite, **attributes)


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the folds that were written whole."""
    found = committed(spark, path)
    if not found:
        raise FileNotFoundError(f"no folds at {path}")
    paths = [f"{path}/attempt={m['attempt']}/fold={fold}" for fold, m in sorted(found.items())]
    return spark.read.option("basePath", path).parquet(*paths).drop("attempt")


def write_statistics(spark: SparkSession, path: str, **tables: DataFrame) -> None:
    """A fold's statistics, a small Parquet table for each name."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_statistics(spark: SparkSession, path: str, name: str, fold: int | None = None) -> DataFrame:
    df = spark.read.parquet(f"{path}/{name}")
    return df if fold is None else df.where(F.col("fold") == fold)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to a log of metrics. The first rows fix the columns: later ones lack none (null) and add none (dropped)."""
    try:
        columns = rows.sparkSession.read.parquet(path).schema
    except AnalysisException:
        rows.write.parquet(path)
        return
    has = set(rows.columns)
    rows.select(*((F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType).alias(f.name) for f in columns)).write.mode("append").parquet(path)


def csv_log(log: DataFrame, path: str) -> None:
    """The log as CSV with a header."""
    log.write.mode("overwrite").option("header", "true").csv(path)


def read_fold(spark: SparkSession, path: str, fold: int, split: str) -> DataFrame:
    """One split of one fold; others are not listed. A split without rows is an empty table of the same columns."""
    found = committed(spark, path)[fold]
    columns = T.StructType([*T.StructType.fromJson(found["schema"]).fields, T.StructField("fold", T.IntegerType()), T.StructField("split", T.StringType())])
    if not found["splits"].get(split, {"windows": 0})["windows"]:
        return spark.createDataFrame([], columns)
    place = f"{path}/attempt={found['attempt']}"
    return spark.read.schema(columns).option("basePath", place).parquet(f"{place}/fold={fold}/split={split}")


def write_manifest(df: DataFrame, path: str, **attributes) -> None:
    """Counts of recordings and windows by fold and split, with constant attributes."""
    counts = df.groupBy("fold", "split").agg(F.countDistinct("recording_id").alias("recordings"), F.count(F.lit(1)).alias("windows"))
    counts.select("*", *(F.lit(v).alias(k) for k, v in attributes.items())).write.mode("overwrite").json(path)


def summary_json(folds: DataFrame, by: list[str]) -> DataFrame:
    """by, json: mean, std and the folds' values as one document each."""
    return folds.groupBy(*by).agg(F.to_json(F.struct(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"), F.array_sort(F.collect_list(F.struct("fold", "macro_f1"))).alias("per_fold"))).alias("json"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame | None:
    """Summary documents; a warning and None where the path is missing."""
    try:
        spark.read.text(path)
    except AnalysisException:
        warnings.warn(f"no summaries at {path}", stacklevel=2)
        return None
    return spark.read.option("multiLine", "true").json(path)


def read_log(spark: SparkSession, path: str, phase: str | None = None) -> DataFrame:
    """A training log with a header; rows of one phase, or all."""
    rows = spark.read.csv(path, header=True, inferSchema=True)
    return rows if phase is None else rows.where(F.col("phase") == phase)


def text_table(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """line: the columns right-aligned to fixed widths."""
    return df.select(F.concat_ws(" | ", *(F.lpad(F.col(c).cast("string"), w, " ") for c, w in widths.items())).alias("line"))


def latex_rows(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.concat_ws(" & ", *(F.col(c).cast("string") for c in df.columns)), F.lit(" \\\\")).alias("line"))


def merged_config(base: dict, over: dict) -> dict:
    """base with over's values, nested dicts merged, over winning."""
    return {**base, **{k: merged_config(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}}
