"""Incremental repair: one country's records normalised anew, what they touch scored again and put in place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.operators.relational import keyed_upsert, replace_by_key
from kinlink.plans.linkage import normalise

NORMALISED = ["name_full", "core", "core_sk", "legal", "alt", "addr", "nums", "state"]


def renormalise(rec: DataFrame, country: str) -> DataFrame:
    """rec with the normalised columns of one country's records made again; their rid stays."""
    own = rec.where(F.lower("country") == country.lower())
    raw = own.select("rid", "entity_id", "business_name", "business_address", "country", "src")
    return keyed_upsert(rec, normalise(raw).select("rid", *NORMALISED), "rid")


def affected(cand: DataFrame, rec: DataFrame, country: str) -> DataFrame:
    """(q_rid): queries of that country, or with a candidate of it."""
    own = rec.where(F.lower("country") == country.lower()).select("rid")
    as_query = cand.join(own.withColumnRenamed("rid", "q_rid"), "q_rid", "left_semi").select("q_rid")
    as_entity = cand.join(own.withColumnRenamed("rid", "e_rid"), "e_rid", "left_semi").select("q_rid")
    return as_query.unionByName(as_entity).distinct()


def repair(rec: DataFrame, cand: DataFrame, scores: DataFrame, country: str, score: Callable[[DataFrame, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Records and scores after the repair; score(pairs, records) gives (q_rid, e_rid, p)."""
    fresh = renormalise(rec, country)
    queries = affected(cand, rec, country)
    again = score(cand.join(queries, "q_rid", "left_semi"), fresh).select(*scores.columns)
    return fresh, replace_by_key(scores, again, "q_rid")
