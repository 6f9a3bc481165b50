"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-grams of all texts are joined on their hashes with the
k-grams of the license templates. Each hit votes for the diagonal (its place in
the text less its place in the template); votes are summed, neighbouring
diagonals of one stretch of text merged, so that small insertions do not split
a notice, and a span is verified if it holds enough of the template's k-grams
within a span of about its length. Of a merged run the best such window counts, and
each of the template's k-grams once, so that a phrase repeated inside a notice
neither stretches it nor makes up for what is missing.

Base labels come from phrases whose words stand consecutively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import let
from .url_filter import lower_ascii

K = 3
#: A span is verified with this share of the template's k-grams ...
COVER = 0.6
#: ... within this many times its words.
STRETCH = 2.0
DRIFT = 3
# Phrases and labels of the base rule.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices of public licenses as words, with labels.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase, words counted from 0."""

    def here(i: Column) -> Column:
        ok = F.lit(True)
        for j, w in enumerate(phrase.split()):
            ok = ok & (F.get(words, i + j) == w)
        return ok

    first = phrase.split()[0]
    at = F.filter(F.transform(words, lambda w, i: F.when(w == first, i)), lambda i: i.isNotNull())
    return F.filter(at, lambda i: F.coalesce(here(i), F.lit(False)))


def _base(words: Column) -> Column:
    found = [F.struct(_places(words, phrase).alias("at"), F.lit(label).alias("label")) for phrase, label in PHRASES]
    return let(F.array(*found), lambda f: F.struct(F.flatten(F.transform(f, lambda x: x["at"])).alias("at"), F.transform(F.filter(f, lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("labels")))


def _template_grams(spark) -> DataFrame:
    rows = [(t, label, text.split()) for t, (label, text) in enumerate(TEMPLATES)]
    t = spark.createDataFrame(rows, "template int, label string, words array<string>")
    grams = t.select("template", "label", F.size("words").alias("n"), F.posexplode(_grams(F.col("words"))).alias("at", "gram"))
    return grams.withColumn("total", F.col("n") - K + 1)


def _grams(words: Column) -> Column:
    return F.when(F.size(words) < K, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(words) - K + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(K)))))


def spans(keyed: DataFrame) -> DataFrame:
    """key, template, label, start, length, cover of verified spans. keyed: key, text."""
    templates = F.broadcast(_template_grams(keyed.sparkSession))  # a constant of this module
    grams = keyed.select("key", F.posexplode(let(_words(F.col("text")), _grams)).alias("place", "gram"))
    hits = grams.join(templates, "gram").select("key", "template", "label", "n", "total", "place", "at").distinct()
    hits = hits.withColumn("diagonal", F.col("place") - F.col("at"))
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    hits = hits.withColumn("run", F.sum(F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > DRIFT).cast("int"), F.lit(1))).over(by))
    merged = Window.partitionBy("key", "template", "run")
    hits = hits.withColumn("votes", F.count(F.lit(1)).over(merged)).where(F.col("votes") >= COVER * F.col("total"))
    # the best window of a run: from each hit on, the template's places within the allowed length; no more than the longest template's
    ahead = F.collect_set(F.struct("place", "at")).over(merged.orderBy("place").rangeBetween(0, int(STRETCH * max(len(text.split()) for _, text in TEMPLATES))))
    inside = F.filter(ahead, lambda h: h["place"] + K <= F.col("place") + STRETCH * F.col("n"))
    found = hits.withColumn("inside", inside)
    cover = F.size(F.array_distinct(F.transform("inside", lambda h: h["at"]))) / F.col("total")
    length = F.array_max(F.transform("inside", lambda h: h["place"])) - F.col("place") + K
    found = found.select("key", "template", "label", "run", "place", length.alias("length"), cover.alias("cover")).where(F.col("cover") >= COVER)
    best = found.groupBy("key", "template", "label", "run").agg(F.max(F.struct("cover", -F.col("length"), -F.col("place"))).alias("b"))
    return best.select("key", "template", "label", (-F.col("b.col3")).alias("start"), (-F.col("b.col2")).alias("length"), F.col("b.cover").alias("cover"))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; a row for each input row.

    score: 1 if a base phrase stands in the text, else the largest cover of a
    verified span, else 0. Null texts count as empty: no words, no labels.
    Repeated rows stay, with equal results; very long texts are scanned whole; an
    empty table gives no rows. Of equal windows the shortest, then the first counts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    keyed = docs.withColumn("key", F.struct(F.xxhash64("text"), F.md5("text").substr(1, 8), F.length("text")).cast("string"))
    maybe = F.lower("text").contains("license") | F.lower("text").contains("cc")
    none = F.struct(F.array().cast("array<int>").alias("at"), F.array().cast("array<string>").alias("labels"))
    own = let(_words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.when(maybe, _base(w)).otherwise(none).alias("base")))
    rows = keyed.select("doc_id", "key", own.alias("o")).select("doc_id", "key", "o.n_words", "o.base")
    found = spans(keyed.select("key", "text")).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))  # at most the templates' labels
    out = rows.join(found, "key", "left")
    at = F.col("base.at")
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).cast("long").alias("first_word"),
        F.array_max(at).cast("long").alias("last_word"),
        joined(F.col("base.labels")).alias("base_labels"),
        joined(F.concat("base.labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score"),
    )
