"""The corpus pipeline: quality rules, near duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.llm.common import cut, table
from tidewave.llm.mixing import keep_mixed
from tidewave.llm.ngram_join import keep_one_each
from tidewave.llm.pii import mask_personal_data
from tidewave.llm.quality_rules import keep_good
from tidewave.llm.sentencepiece_codec import encode_decode
from tidewave.shipping import ship

#: Of the tokens that come so far, the share that the mixture draws.
SHARE = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the risk-controlled rules reject go.

    Null and wordless texts fail the base rule; null languages have the base rule
    alone; repeated rows share their fate; an empty table stays empty.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at Jaccard 0.8 over five-word shingles the smallest doc_id stays, null ids last.

    Of equal rows one stays; wordless and null texts are no duplicates and all stay.
    """
    ship(spark)
    return keep_one_each(docs, k=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans are replaced by their kind's name; n_chars follows the text. Null texts stay null, with null n_chars."""
    ship(spark)
    return mask_personal_data(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn with raked probabilities; texts without tokens, or null, are not drawn; rows of one doc_id share a draw."""
    return keep_mixed(docs, SHARE)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and what encode_decode() adds: a row for each document, null and empty texts with no ids."""
    ship(spark)
    return encode_decode(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Personal data and tokens have no SQL; tests/llm holds each stage against a plain version of its decision, where it has one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
