"""Smoothed match rates of extra name words and of the ways in which pairs differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions.textnorm import canonical_number, words


def smoothed_rate(df: DataFrame, keys: list[str], y: str = "y", smooth: int = 20, least: int = 20) -> DataFrame:
    """keys, n and rate = (sum y + smooth * prior) / (n + smooth) of keys seen `least` times; prior: mean of y over df."""
    prior = df.agg(F.avg(F.col(y).cast("double")).alias("prior"))
    groups = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(y).alias("ys")).where(F.col("n") >= least)
    return groups.join(F.broadcast(prior)).select(*keys, "n", ((F.col("ys") + smooth * F.col("prior")) / (F.col("n") + smooth)).alias("rate"))


def extra_word_rates(pairs: DataFrame, smooth: int = 20, least: int = 20) -> DataFrame:
    """(w, side, n, rate) from pairs (tq, te: word arrays, y): rates of words that one side only has.

    A word counts where the other side has no extra word of its own.
    """
    p = pairs.select("y", F.array_except("tq", "te").alias("xq"), F.array_except("te", "tq").alias("xe"))
    out = None
    for side, own, other in (("q", "xq", "xe"), ("e", "xe", "xq")):
        seen = p.where(F.size(other) == 0).select("y", F.explode(own).alias("w"))
        rates = smoothed_rate(seen, ["w"], smooth=smooth, least=least).select("w", F.lit(side).alias("side"), "n", "rate")
        out = rates if out is None else out.unionByName(rates)
    return out


def first_numbers(nums: Column) -> Column:
    """Canonical numbers of a text of numbers, in order."""
    return F.transform(F.filter(words(nums), lambda w: w.rlike("^[0-9]+$")), canonical_number)


def number_edit_kind(nq: Column, ne: Column) -> Column:
    """How the first numbers of two arrays of canonical numbers differ."""
    a, b = F.get(nq, 0), F.get(ne, 0)
    edits = F.levenshtein(a, b)
    digits = lambda x: F.array_sort(F.split(x, ""))
    near = (F.length(a) < 10) & (F.length(b) < 10) & (F.abs(a.try_cast("bigint") - b.try_cast("bigint")) <= 20)
    return (
        F.when(a.isNull() & b.isNull(), "none")
        .when(a.isNull(), "noq")
        .when(b.isNull(), "noe")
        .when(a == b, "same")
        .when((F.abs(F.length(a) - F.length(b)) == 1) & (edits == 1), "drop")
        .when((F.length(a) == F.length(b)) & (digits(a) == digits(b)), "swap")
        .when((F.length(a) == F.length(b)) & (edits == 1), "1dig")
        .when(near, "shift")
        .when(F.array_contains(ne, a), "inother")
        .otherwise("other")
    )


def signatures(cq: Column, ce: Column, nq: Column, ne: Column, legal_q: Column, legal_e: Column, country: Column) -> tuple[Column, Column]:
    """Fine and coarse text of how a pair differs; cq and ce are word arrays, nq and ne arrays of numbers."""
    kind = number_edit_kind(nq, ne)
    added = F.least(F.size(F.array_except(cq, ce)), F.lit(2)).cast("string")
    removed = F.least(F.size(F.array_except(ce, cq)), F.lit(2)).cast("string")
    form = lambda x: F.when(F.coalesce(x, F.lit("")) == "", F.lit("-")).otherwise(x)
    coarse = F.concat(kind, F.lit("|a"), added, F.lit("|r"), removed)
    fine = F.concat(F.lower(country), F.lit("|"), kind, F.lit("|"), form(legal_q), F.lit(">"), form(legal_e), F.lit("|a"), added, F.lit("|r"), removed)
    return fine, coarse


def signature_rates(pairs: DataFrame, smooth: int = 20, least: int = 20) -> DataFrame:
    """(sig, kind, n, rate) from pairs (fine, coarse, y)."""
    out = None
    for kind in ("fine", "coarse"):
        rates = smoothed_rate(pairs.select(F.col(kind).alias("sig"), "y"), ["sig"], smooth=smooth, least=least).select("sig", F.lit(kind).alias("kind"), "n", "rate")
        out = rates if out is None else out.unionByName(rates)
    return out
