"""All registered queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Query name -> identifiers of the blueprint's operator inventory that it covers.
COVERS: dict[str, str] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register a query (spark, sf_dir) -> DataFrame with its DuckDB oracle."""

    def add(f):
        QUERIES[name] = f
        COVERS[name] = covers
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from .plans import queries_clean, queries_features, queries_learning, queries_sources, queries_tracks  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
