"""The catalogue of linkage queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import decide
from kinlink.plans import fixtures, linkage_queries, storage_queries, table_queries, text_queries

MODULES = (text_queries, table_queries, linkage_queries, storage_queries)
Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and addresses to tokens, cosine top-K candidates, each query's best entity."""
    return decide.assign(fixtures.scores(spark, sf_dir), 0.2).select("q_rid", "e_rid", F.round("p", 6).alias("p"))


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {"flagship": flagship}
    for m in MODULES:
        found |= m.QUERIES
    return found


def oracles() -> dict[str, str]:
    found = {"flagship": fixtures.with_sql("SELECT q_rid, e_rid, round(p, 6) AS p FROM best WHERE p >= 0.2", "best")}
    for m in MODULES:
        found |= m.ORACLES
    return found
