"""Leave-one-subject-out splits, leakage audits, class maps and receiver triplets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Up to so many persons are sent to all executors; more are joined by a shuffle.
BROADCAST_PERSONS = 100_000

# Activity names of the 30-subcarrier set and their classes, in the order of the search.
CLASSES_30 = (
    ("walking", 0), ("walk", 0), ("running", 1), ("run", 1), ("standing up", 2), ("standup", 2), ("stand_up", 2), ("sitting down", 3), ("sitdown", 3), ("sit_down", 3), ("picking up", 4), ("pickup", 4),
    ("pick_up", 4), ("falling down", 5), ("fall", 5), ("falling", 5), ("fallen", 5), ("lying down", 6), ("lying", 6), ("lying_still", 6), ("sleeping", 6), ("no person", 7), ("empty", 7), ("background", 7),
)
# The same of the 2048-subcarrier set.
CLASSES_2048 = (
    ("walking", 0), ("walk", 0), ("running", 1), ("run", 1), ("standing", 2), ("stand", 2), ("standing up", 2), ("sitting", 3), ("sitting down", 3), ("sit", 3), ("bending", 4), ("bend", 4), ("picking", 4),
    ("falling", 5), ("fall", 5), ("lying", 6), ("lie", 6), ("lying still", 6), ("empty", 7), ("no one", 7), ("background", 7), ("gesturing", 4), ("other", 7),
)


def person_ranks(df: DataFrame, person: str) -> DataFrame:
    """person, k, persons: places in the sorted list of persons, from 0. At least three are needed, else test and validation meet.

    Folds times persons is what a split asks for, so one task can rank them.
    """
    people = df.select(person).distinct()
    n = people.count()
    if n < 3:
        raise ValueError("leave-one-subject-out needs three persons")
    ranked = people.select(person, (F.dense_rank().over(Window.orderBy(person)) - 1).alias("k"), F.lit(n).alias("persons"))
    return F.broadcast(ranked) if n <= BROADCAST_PERSONS else ranked


def split_of(k: Column, fold: Column, persons: Column) -> Column:
    """test for the fold's own person, val for the next (cyclic), train for the rest."""
    return F.when(k == fold, "test").when(k == (fold + 1) % persons, "val").otherwise("train")


def subject_folds(df: DataFrame, person: str) -> DataFrame:
    """fold, person, split for all folds."""
    return with_folds(df.select(person).distinct(), person).select("fold", person, "split")


def with_folds(df: DataFrame, person: str) -> DataFrame:
    """Each row of df once for every fold, with fold and split; the split is arithmetic on the person's rank, no table of folds x persons."""
    rows = df.join(person_ranks(df, person), person)
    rows = rows.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col("persons") - 1)))
    return rows.withColumn("split", split_of(F.col("k"), F.col("fold"), F.col("persons"))).drop("k", "persons")


def leakage(splits: DataFrame, unit: str) -> DataFrame:
    """fold, pair, shared: units that two splits of a fold have in common; all zero in sound splits."""
    of = splits.groupBy("fold", unit).agg(F.collect_set("split").alias("s"))
    pairs = [("test", "train"), ("test", "val"), ("train", "val")]
    found = [F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"{a}/{b}") for a, b in pairs]
    wide = of.groupBy("fold").agg(*found)
    return wide.unpivot("fold", [f"{a}/{b}" for a, b in pairs], "pair", "shared")


def mapped_class(df: DataFrame, name: str, classes: list[tuple[str, int]], blanks: str = "_") -> DataFrame:
    """df plus class_id: the exact key, else the first key that contains the name or is contained in it, else null.

    Names are trimmed and lower-cased, their blanks replaced. The map is a bounded list, searched within the row, so this is no join.
    """
    key = F.replace(F.lower(F.trim(name)), F.lit(" "), F.lit(blanks))
    known = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in classes))

    def found(key: Column) -> Column:
        exact, part = F.filter(known, lambda c: c["k"] == key), F.filter(known, lambda c: key.contains(c["k"]) | c["k"].contains(key))
        return F.coalesce(F.get(exact, 0)["v"], F.get(part, 0)["v"])

    return df.withColumn("class_id", F.get(F.transform(F.array(key), found), 0))


def activity_of(path: Column, names: tuple[str, ...], rule: str = "last") -> Column:
    """The activity that a path names, or null; cases and underscores do not count.

    last: the last part of the path that contains a name counts, and of several names
    in it the last of the list. stem: only the file's stem counts, and the first name of
    the list that it contains. The list is bounded and searched within the row.
    """
    keys = [name.lower().replace("_", "") for name in names]
    named = F.array(*map(F.lit, names))

    def last(part: Column) -> Column:
        return F.greatest(*(F.when(part.contains(k), i).otherwise(-1) for i, k in enumerate(keys)), F.lit(-1))

    plain = F.replace(F.lower(path), F.lit("_"), F.lit(""))
    if rule == "stem":
        stem = F.regexp_extract(plain, r"([^/]*?)(?:\.[^./]*)?$", 1)
        return F.coalesce(*(F.when(stem.contains(k), F.lit(name)) for name, k in zip(names, keys)), F.lit(None).cast("string"))
    if rule != "last":
        raise ValueError("rule is last or stem")
    found = F.filter(F.transform(F.split(plain, "/"), last), lambda i: i >= 0)
    return F.get(named, F.element_at(F.when(F.size(found) > 0, found), F.lit(-1)))


def receiver_triplets(df: DataFrame, by: list[str], receiver: str, item: str, fallback: bool = False) -> DataFrame:
    """by, rx0, rx1, rx2, copied: groups with all three receivers; with `fallback` rx0 stands in where rx1 is missing."""
    wide = df.groupBy(*by).agg(*(F.min(F.when(F.col(receiver) == i, F.col(item))).alias(f"rx{i}") for i in range(3)))
    wide = wide.withColumn("copied", F.lit(fallback) & F.col("rx1").isNull())
    if fallback:
        wide = wide.withColumn("rx2", F.when(F.col("copied"), F.col("rx0")).otherwise(F.col("rx2"))).withColumn("rx1", F.when(F.col("copied"), F.col("rx0")).otherwise(F.col("rx1")))
    return wide.where("rx0 is not null and rx1 is not null and rx2 is not null")
