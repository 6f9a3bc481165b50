"""Fold tables: staged attempts, manifests last, two writers, failing tasks, empty splits; readers of logs and summaries."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tidewave.sources import folds


def windows(spark, of=(0, 1), v=1):
    rows = spark.range(12).select(F.col("id").cast("string").alias("recording_id"), F.explode(F.array(*map(F.lit, of))).alias("fold"), F.when(F.col("id") < 8, "train").otherwise("test").alias("split"), F.lit(v).alias("v"))
    return rows.withColumn("fold", F.col("fold").cast("int"))


def values(spark, path):
    return {r.fold: (r.n, r.v) for r in folds.read_folds(spark, path).groupBy("fold").agg(F.count("v").alias("n"), F.max("v").alias("v")).collect()}


def attempts(path):
    return sorted(f"{a}/{f}" for a in os.listdir(path) if a.startswith("attempt=") for f in os.listdir(f"{path}/{a}") if f.startswith("fold="))


def test_a_second_fold_is_added_and_the_first_stays(spark, tmp_path):
    path = str(tmp_path / "f")
    assert folds.committed(spark, path) == {}
    assert folds.write_fold(windows(spark, [0]), path, dataset="own") == [0]
    assert folds.write_fold(windows(spark, [0, 1], 2), path) == [1]
    assert values(spark, path) == {0: (12, 1), 1: (12, 2)}
    assert folds.write_fold(windows(spark, [0, 1], 5), path) == []
    assert folds.write_fold(windows(spark, [1], 3), path, overwrite=True) == [1]
    assert values(spark, path) == {0: (12, 1), 1: (12, 3)} and len(attempts(path)) == 2
    assert folds.committed(spark, path)[0]["attributes"] == {"dataset": "own"}
    with pytest.raises(FileNotFoundError):
        folds.read_folds(spark, str(tmp_path / "none"))


def test_empty_splits_have_a_place(spark, tmp_path):
    path = str(tmp_path / "f")
    folds.write_fold(windows(spark), path)
    assert folds.committed(spark, path)[1]["splits"] == {"train": {"recordings": 8, "windows": 8}, "val": {"recordings": 0, "windows": 0}, "test": {"recordings": 4, "windows": 4}}
    val, test = (folds.read_fold(spark, path, 1, s) for s in ("val", "test"))
    assert val.schema == test.schema and val.count() == 0 and test.count() == 4
    assert {(r.fold, r.split) for r in test.collect()} == {(1, "test")}
    assert folds.write_fold(windows(spark).limit(0), str(tmp_path / "e")) == [] and folds.committed(spark, str(tmp_path / "e")) == {}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "f")
    folds.write_fold(windows(spark, [0]), path)
    broken = windows(spark, [1]).repartition(3).withColumn("v", F.when(F.col("recording_id") == "7", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        folds.write_fold(broken, path)
    assert values(spark, path) == {0: (12, 1)} and len(attempts(path)) == 1
    assert folds.write_fold(windows(spark, [1], 4), path) == [1] and values(spark, path) == {0: (12, 1), 1: (12, 4)}


def test_of_two_writers_the_first_to_commit_stays(spark, tmp_path):
    path = str(tmp_path / "f")
    a, b = folds.stage_fold(windows(spark, [0, 1], 1), path), folds.stage_fold(windows(spark, [1, 2], 2), path)
    assert folds.committed(spark, path) == {}  # nothing is seen before a manifest
    assert folds.commit_folds(spark, path, b) == [1, 2]
    assert folds.commit_folds(spark, path, a) == [0]
    assert values(spark, path) == {0: (12, 1), 1: (12, 2), 2: (12, 2)} and len(attempts(path)) == 3


def test_a_manifest_being_written_is_none(spark, tmp_path):
    path = str(tmp_path / "f")
    folds.write_fold(windows(spark), path)
    (tmp_path / "f/_manifests/fold=9.json").write_text('{"fold": 9, "att')
    assert sorted(folds.committed(spark, path)) == [0, 1]


def test_summaries_are_read_back(spark, tmp_path):
    f = spark.createDataFrame([("own", 0, 0.5), ("own", 1, 0.7), ("other", 0, 0.2)], "dataset string, fold long, macro_f1 double")
    for r in folds.summary_json(f, ["dataset"]).collect():
        (tmp_path / "s").mkdir(exist_ok=True)
        (tmp_path / f"s/{r.dataset}_summary.json").write_text(json.dumps(json.loads(r.json), indent=2))
    got = folds.read_summaries(spark, str(tmp_path / "s")).orderBy("mean").collect()
    assert [(round(r["mean"], 9), round(r["std"], 9), [tuple(p) for p in r.per_fold]) for r in got] == [(0.2, 0.0, [(0, 0.2)]), (0.6, 0.1, [(0, 0.5), (1, 0.7)])]
