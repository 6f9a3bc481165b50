"""The pipeline against a plain version of each stage's decision, on its own input."""

import pytest

import corpus_pipeline
from tidewave.llm import pii
from tidewave.llm.quality_rules import judge
from tidewave.llm.sentencepiece_codec import MODEL, Codec, read_model

from .helpers import DOCS, labels, no_docs, odd_docs
from .test_native_operators import plain_quality
from .test_ngram_join import brute

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns, marks = docs.columns, spark.read.parquet(f"{D}/labels.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, seen[-1], D).collect(), stage(spark, seen[-1], D).schema)
        if name != "token_ids":
            assert out.columns == columns
        seen.append(out)
    rows = [{r.doc_id: r for r in df.collect()} for df in seen]
    assert set(rows[1]) == {r.doc_id for r in judge(docs, marks).where("kept").collect()} and len(rows[1]) < len(rows[0])
    links = brute([(i, r.text) for i, r in rows[1].items()], 5, 80)
    assert set(rows[2]) == {i for i, _, c in links if i == c} and len(rows[2]) < len(rows[1])
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        assert pii.base_spans(r.text) == [] and r.n_chars == len(r.text)
        assert r.text == pii.masked(rows[2][i].text, pii.base_spans(rows[2][i].text))  # so small a table teaches no pattern
    assert set(rows[4]) < set(rows[3]) and all(rows[4][i].text == rows[3][i].text for i in rows[4])
    codec = Codec(read_model(MODEL))
    assert {i: r.ids for i, r in rows[5].items()} == {i: codec.encode(r.text).tolist() for i, r in rows[4].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, D).select("doc_id", "ids_sha256").collect())) == sorted((i, r.ids_sha256) for i, r in rows[5].items())


def test_rules_keep_what_the_plain_rules_keep(spark):
    """At this size no stratum has labels enough for a step, so the base rule decides, counted here by loops."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, D).select("doc_id").collect()}
    measured = {r.doc_id: plain_quality(r.text) for r in docs.select("doc_id", "text").collect()}
    assert kept == {i for i, (n, *_, repeated) in measured.items() if n >= 20 and 100 * repeated <= 30 * n}


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_and_empty_tables(spark, tmp_path, rows):
    text = lambda a: " ".join(f"word{a}x{j}" for j in range(60))
    clean = [(20, text(1), None, "s0"), (21, text(1), "en", None), (None, text(1) + " more", "de", "s1"), (22, text(2) + " mail a@b.org", "en", "s1"), (22, text(2) + " mail a@b.org", "en", "s1"), (23, text(3), "en", "")]
    odd = odd_docs(spark).unionByName(spark.createDataFrame([(*r, None, "k", "c", "s", "n") for r in clean], DOCS))
    docs = odd if rows == "odd" else no_docs(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [seen.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, str(tmp_path))
        assert name == "token_ids" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(seen.count())
    assert counts == sorted(counts, reverse=True) and counts[1:3] == ([6, 3] if rows == "odd" else [0, 0])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == counts[-1]
