"""Evaluation: macro F0.5, recall at K, threshold sweeps, error buckets and what repairing one would gain."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinlink.operators.decide import assign, odds_shift
from kinlink.operators.splits import with_copies
from kinlink.operators.windows import first_of


def entity_f05(pred: DataFrame, gt: DataFrame, entities: DataFrame) -> DataFrame:
    """np, nt, tp and f of each entity (e_rid); pred has (q_rid, e_rid), gt (q_rid, true_e)."""
    truth = gt.select("q_rid", F.col("true_e").alias("e_rid"))
    tp = pred.join(truth, ["q_rid", "e_rid"]).groupBy("e_rid").agg(F.count("*").alias("tp"))
    n_pred = pred.groupBy("e_rid").agg(F.count("*").alias("np"))
    n_true = truth.groupBy("e_rid").agg(F.count("*").alias("nt"))
    d = entities.select("e_rid").join(n_pred, "e_rid", "left").join(n_true, "e_rid", "left").join(tp, "e_rid", "left").na.fill(0, ["np", "nt", "tp"])
    p, r = F.col("tp") / F.greatest("np", F.lit(1)), F.col("tp") / F.greatest("nt", F.lit(1))
    f = F.when((F.col("np") == 0) & (F.col("nt") == 0), 1.0).when(F.col("tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return d.withColumn("f", f)


def macro_f05(pred: DataFrame, gt: DataFrame, entities: DataFrame) -> DataFrame:
    return entity_f05(pred, gt, entities).agg(F.avg("f").alias("f05"))


def recall_at_k(cand: DataFrame, gt: DataFrame, ks: tuple[int, ...] = (1, 2, 3, 5, 10, 20)) -> DataFrame:
    """k, and the share of true pairs within rank k of the full index, the name index, and either."""
    x = gt.select("q_rid", F.col("true_e").alias("e_rid")).join(cand, ["q_rid", "e_rid"], "left").select(F.coalesce("br_f", F.lit(99)).alias("f"), F.coalesce("br_n", F.lit(99)).alias("n"), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    hit = lambda c: F.avg(c.cast("double"))
    return x.groupBy("k").agg(hit(F.col("f") <= F.col("k")).alias("r_full"), hit(F.col("n") <= F.col("k")).alias("r_name"), hit(F.least("f", "n") <= F.col("k")).alias("r_any"))


def threshold_sweep(scores: DataFrame, gt: DataFrame, entities: DataFrame, start: int = 20, stop: int = 95, step: int = 5) -> DataFrame:
    """thr and macro F0.5 of assign() at each threshold (in hundredths), in one pass.

    Only entities with a prediction or a true match are counted for each threshold; the others score 1.
    """
    best = assign(scores, -1.0)
    grid = best.select("q_rid", "e_rid", F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("t"), "p").where(F.col("p") >= F.col("t") / 100)
    truth = gt.select("q_rid", F.col("true_e").alias("e_rid"))
    hits = grid.join(truth.withColumn("y", F.lit(1)), ["q_rid", "e_rid"], "left").join(entities.select("e_rid"), "e_rid", "left_semi")
    per = hits.groupBy("t", "e_rid").agg(F.count("*").alias("np"), F.count("y").alias("tp"))
    n_true = truth.join(entities.select("e_rid"), "e_rid", "left_semi").groupBy("e_rid").agg(F.count("*").alias("nt"))
    every = n_true.select("e_rid", "nt", F.explode(F.sequence(F.lit(start), F.lit(stop), F.lit(step))).alias("t"))
    d = every.join(per, ["t", "e_rid"], "full").na.fill(0, ["np", "tp", "nt"])
    p, r = F.col("tp") / F.greatest("np", F.lit(1)), F.col("tp") / F.greatest("nt", F.lit(1))
    f = F.when(F.col("tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    n = entities.agg(F.count("*").alias("n"))
    sums = d.groupBy("t").agg(F.sum(f).alias("f"), F.count("*").alias("seen"))
    return sums.join(F.broadcast(n)).select((F.col("t") / 100).alias("thr"), ((F.col("f") + F.col("n") - F.col("seen")) / F.col("n")).alias("f05"))


def error_buckets(queries: DataFrame, gt: DataFrame, scores: DataFrame, cand: DataFrame, pred: DataFrame) -> DataFrame:
    """queries (q_rid) with true_e, pred_e and the bucket that tells what happened to each."""
    top = first_of(scores.select("q_rid", F.col("e_rid").alias("top_e"), "p"), "q_rid", [F.desc("p"), F.asc("top_e")]).drop("p")
    q = (
        queries.select("q_rid")
        .join(gt, "q_rid", "left")
        .join(pred.select("q_rid", F.col("e_rid").alias("pred_e")), "q_rid", "left")
        .join(cand.select("q_rid", F.col("e_rid").alias("true_e"), F.lit(1).alias("in_cand")), ["q_rid", "true_e"], "left")
        .join(scores.select("q_rid", F.col("e_rid").alias("true_e"), F.col("p").alias("p_true")), ["q_rid", "true_e"], "left")
        .join(top, "q_rid", "left")
    )
    bucket = (
        F.when(F.col("pred_e").isNull() & F.col("true_e").isNull(), F.lit("ok"))
        .when(F.col("pred_e") == F.col("true_e"), F.lit("ok"))
        .when(F.col("true_e").isNull(), F.lit("confuser_matched"))
        .when(F.col("pred_e").isNotNull(), F.lit("wrong_entity"))
        .when(F.col("in_cand").isNull(), F.lit("blocking_miss"))
        .when(F.col("p_true").isNull(), F.lit("pruned_s1"))
        .when(F.col("top_e") != F.col("true_e"), F.lit("outranked_below_thr"))
        .otherwise(F.lit("below_thr"))
    )
    return q.select("q_rid", "true_e", "pred_e", bucket.alias("bucket"))


def repaired(pred: DataFrame, buckets: DataFrame, bucket: str) -> DataFrame:
    """pred with the queries of one bucket set right."""
    own = buckets.where(F.col("bucket") == bucket)
    fixed = own.where("true_e is not null").select("q_rid", F.col("true_e").alias("e_rid"))
    return pred.select("q_rid", "e_rid").join(own, "q_rid", "left_anti").unionByName(fixed)


SHIFTS = (1.0, 0.7, 0.5, 0.35, 0.25)


def prior_shift_search(scores: DataFrame, gt: DataFrame, entities: DataFrame, decision: Callable[[DataFrame], DataFrame], shifts: tuple[float, ...] = SHIFTS, copies: int = 1, truth: DataFrame | None = None) -> DataFrame:
    """(r, f05, chosen): macro F0.5 of the decision on crowded scores whose odds are multiplied by each r.

    Queries that match nothing in gt are copied `copies` times first; truth (gt, if None) is what F0.5 is measured by. The r of the greatest F0.5 is chosen, of equal
    ones the greatest.
    """
    crowd = with_copies(scores.select("q_rid", "e_rid", "p"), gt, copies)
    found = []
    for r in shifts:
        pred = decision(crowd.withColumn("p", odds_shift(F.col("p"), r))).join(entities.select("e_rid"), "e_rid", "left_semi")
        found.append(macro_f05(pred, gt if truth is None else truth, entities).select(F.lit(r).alias("r"), "f05"))
    grid = reduce(DataFrame.unionByName, found).withColumn("f05", F.round("f05", 12))
    return grid.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("f05"), F.desc("r"))) == 1)  # a row a shift
