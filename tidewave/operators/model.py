"""A trainable analogue of the hierarchical heads: presence, motion and activity by logistic regressions.

The neural encoders are out of scope here (no deep learning library); the heads'
composition is the same, so probabilities of the eight classes sum to 1.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folds import committed, read_folds, write_fold
from .metrics import argmax, composed
from .split import person_ranks, split_of


def fit(train: DataFrame, vector: str, truth: str, max_iter: int = 30):
    """(presence, motion, activity) models; activity learns on classes 0 to 5 alone."""
    rows = train.withColumn("__x", array_to_vector(vector))

    def one(df: DataFrame, label: Column, family: str):
        lr = LogisticRegression(featuresCol="__x", labelCol="__y", maxIter=max_iter, regParam=0.01, family=family)
        return lr.fit(df.withColumn("__y", label.cast("double")))

    t = F.col(truth)
    return one(rows, t != 7, "binomial"), one(rows.where(t != 7), t < 6, "binomial"), one(rows.where(t < 6), t, "multinomial")


def predict(models, df: DataFrame, vector: str) -> DataFrame:
    """df plus probs (eight classes) and pred."""
    out = df.withColumn("__x", array_to_vector(vector))
    for name, m in zip(("__occ", "__dyn", "__act"), models):
        m = m.setProbabilityCol(name).setRawPredictionCol(name + "_raw").setPredictionCol(name + "_pred")
        out = m.transform(out).withColumn(name, vector_to_array(name)).drop(name + "_raw", name + "_pred")
    acts = F.concat("__act", F.array_repeat(F.lit(0.0), F.greatest(F.lit(6) - F.size("__act"), F.lit(0))))
    out = out.withColumn("probs", composed(F.col("__occ")[1], F.col("__dyn")[1], acts)).drop("__x", "__occ", "__dyn", "__act")
    return out.withColumn("pred", argmax(F.col("probs")))


def fit_and_predict(df: DataFrame, key: str, vector: str, truth: str, test: Column) -> DataFrame:
    models = fit(df.where(~test), vector, truth)
    return predict(models, df.where(test), vector).select(key, truth, "pred", "probs")


def save(models, path: str) -> None:
    for name, m in zip(("presence", "motion", "activity"), models):
        m.write().overwrite().save(f"{path}/{name}")


def load(path: str):
    return tuple(LogisticRegressionModel.load(f"{path}/{name}") for name in ("presence", "motion", "activity"))


def leave_one_out(df: DataFrame, person: str, key: str, vector: str, truth: str, path: str | None = None) -> DataFrame:
    """fold, key, truth, pred, probs: each person's rows, predicted by the models of the training persons.

    With a path, models and predictions of each fold are written there, and folds that
    are there already are not fitted again. Persons are few; each fold is jobs of its own.
    """
    ranks = person_ranks(df, person)
    n = ranks.agg(F.max("persons")).first()[0]
    rows, out = df.join(ranks, person), []
    done = set(committed(df.sparkSession, f"{path}/predictions")) if path else set()
    if path and len(done) < n:
        rows.select("k", "persons", key, vector, truth).write.mode("overwrite").parquet(f"{path}/rows")  # read by every fold and model
        rows = df.sparkSession.read.parquet(f"{path}/rows")
    for fold in range(n):
        own = rows.withColumn("fold", F.lit(fold)).withColumn("split", split_of(F.col("k"), F.col("fold"), F.col("persons")))
        if fold not in done:
            models = fit(own.where("split = 'train'"), vector, truth)
            pred = predict(models, own.where("split = 'test'"), vector).select("fold", "split", key, truth, "pred", "probs")
            if path:
                save(models, f"{path}/models/{fold}")
                write_fold(pred, f"{path}/predictions")
            else:
                out.append(pred)
    if path:
        return read_folds(df.sparkSession, f"{path}/predictions").select("fold", key, truth, "pred", "probs")
    return reduce(DataFrame.unionByName, out).drop("split")
