"""Deterministic samples, folds, splits and simulated crowding; the same rows on any partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.operators.relational import dense_rid


def hash_bucket(key: Column, n: int, seed: int) -> Column:
    """key, a whole number, in one of n buckets; integer arithmetic that other engines share."""
    return F.pmod(F.pmod(key, F.lit(1_000_003)) * (2 * seed + 7919) + 104_729 * (seed + 1), F.lit(1_000_003)) % n


def sample(df: DataFrame, key: str, percent: int, seed: int) -> DataFrame:
    return df.where(hash_bucket(F.col(key), 100, seed) < percent)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df with place: where a row stands (from 0) in an order that seed alone sets, for keys that are unique."""
    mixed = df.withColumn("__mix", hash_bucket(F.col(key), 1_000_003, seed))
    return dense_rid(mixed, ["__mix", key]).withColumnRenamed("rid", "place").drop("__mix")


def folds(df: DataFrame, key: Column, n: int = 5, seed: int = 7) -> DataFrame:
    return df.withColumn("fold", hash_bucket(key, n, seed).cast("int"))


def split_design(entities: DataFrame, cand: DataFrame, gt: DataFrame, percent: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Held-out entities (e_rid), held-out queries and training queries (q_rid).

    A query is held out if it truly matches a held-out entity, or has one among its first candidates.
    """
    held = sample(entities.select(F.col("rid").alias("e_rid")), "e_rid", percent, seed)
    true_q = gt.join(held.withColumnRenamed("e_rid", "true_e"), "true_e", "left_semi").select("q_rid")
    near = cand.where("br_f <= 2 or br_n <= 1").join(held, "e_rid", "left_semi").select("q_rid")
    held_q = true_q.unionByName(near).distinct()
    train_q = cand.select("q_rid").distinct().join(held_q, "q_rid", "left_anti")
    return held, held_q, train_q


def further_split(entities: DataFrame, cand: DataFrame, gt: DataFrame, earlier: list[DataFrame], train_q: DataFrame, percent: int, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """Another disjoint set of held-out entities and its queries; entities that training queries match are left out."""
    used = reduce(DataFrame.unionByName, [e.select("e_rid") for e in earlier])
    trained = gt.join(train_q, "q_rid", "left_semi").select(F.col("true_e").alias("e_rid"))
    pool = entities.select(F.col("rid").alias("e_rid")).join(used, "e_rid", "left_anti").join(trained, "e_rid", "left_anti")
    held = sample(pool, "e_rid", percent, seed)
    q = gt.join(held.withColumnRenamed("e_rid", "true_e"), "true_e", "left_semi").select("q_rid")
    q = q.unionByName(cand.where("br_f <= 2 or br_n <= 1").join(held, "e_rid", "left_semi").select("q_rid")).distinct()
    return held, q.join(train_q, "q_rid", "left_anti")


def label(pairs: DataFrame, gt: DataFrame) -> DataFrame:
    """pairs with y: 1 for true pairs, else 0."""
    truth = gt.select("q_rid", F.col("true_e").alias("e_rid"), F.lit(1).alias("y"))
    return pairs.join(truth, ["q_rid", "e_rid"], "left").withColumn("y", F.coalesce("y", F.lit(0)))


def with_copies(scores: DataFrame, gt: DataFrame, n: int) -> DataFrame:
    """scores and n copies of the rows of queries that match nothing, under new ids; orig keeps the old one."""
    base = scores.agg((F.max("q_rid") + 1).alias("base"))
    copies = scores.join(gt, "q_rid", "left_anti").join(F.broadcast(base)).select(
        *[F.col(c) for c in scores.columns if c != "q_rid"], F.col("q_rid").alias("orig"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("copy"), "base"
    )
    copies = copies.select((F.col("orig") + F.col("base") * F.col("copy")).alias("q_rid"), *[c for c in scores.columns if c != "q_rid"], "orig")
    return scores.withColumn("orig", F.col("q_rid")).unionByName(copies)
