"""The 34 fine features of a pair: aligned words, legal forms, titles, number edits, learned rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions import tables as t
from kinlink.functions.strsim import best_word_many
from kinlink.functions.textnorm import skeleton, words
from kinlink.operators.rates import first_numbers, signatures
from kinlink.operators.simjoin import met_pairs, pair_cells

ALIGN = ["un", "unidf", "unfrac", "unlen", "worst"]
FINE = [
    *[f"fq_{c}" for c in ALIGN], *[f"fe_{c}" for c in ALIGN],
    "f_first_eq", "f_legal_qonly", "f_legal_eonly", "f_title_diff", "f_title_shared",
    "f_hn_eq", "f_hn_dmin", "f_hn_dfirst", "f_num_eonly",
    "f_hn_ed", "f_hn_led", "f_hn_drop", "f_hn_1dig", "f_hn_shift", "f_hn_swap",
    "f_xq_min", "f_xq_max", "f_xq_unk", "f_xe_min", "f_xe_max", "f_xe_unk",
    "f_sig_rate", "f_sig_logn", "f_sig2_rate",
]


def skeleton_df(entities: DataFrame) -> DataFrame:
    """(sk, df): in how many entity names each skeleton word is."""
    return entities.select(F.explode(F.array_distinct(words(F.col("core_sk")))).alias("sk")).groupBy("sk").agg(F.count("*").alias("df"))


def number_edits(nq: Column, ne: Column) -> list[Column]:
    """Features of the first numbers of two arrays of canonical numbers; -1 if either is empty."""
    a, b = F.get(nq, 0), F.get(ne, 0)
    none = a.isNull() | b.isNull()
    edits, same = F.levenshtein(a, b), F.length(a) == F.length(b)
    gap = F.abs(a.try_cast("bigint") - b.try_cast("bigint"))
    shift = (edits > 1) & (F.length(a) < 10) & (F.length(b) < 10) & (gap <= 20)
    digits = lambda x: F.array_sort(F.split(x, ""))
    feature = lambda c, name: F.when(none, -1.0).otherwise(F.coalesce(c.cast("double"), F.lit(0.0))).alias(name)
    return [
        feature(edits, "f_hn_ed"),
        feature(F.array_min(F.transform(ne, lambda x: F.levenshtein(a, x))), "f_hn_led"),
        feature((F.abs(F.length(a) - F.length(b)) == 1) & (edits == 1), "f_hn_drop"),
        feature(same & (edits == 1), "f_hn_1dig"),
        feature(shift, "f_hn_shift"),
        feature(same & (a != b) & (digits(a) == digits(b)), "f_hn_swap"),
    ]


def number_gaps(nq: Column, ne: Column) -> list[Column]:
    """Equality and log distances of the first numbers; those of ten digits or more are left out."""
    q, e = (F.transform(F.filter(n, lambda x: F.length(x) < 10), lambda x: x.cast("bigint")) for n in (nq, ne))
    a, b = F.get(q, 0), F.get(e, 0)
    none = a.isNull() | b.isNull()
    return [
        F.when(none, -1.0).otherwise((a == b).cast("double")).alias("f_hn_eq"),
        F.when(none, -1.0).otherwise(F.log1p(F.array_min(F.transform(e, lambda x: F.abs(x - a))).cast("double"))).alias("f_hn_dmin"),
        F.when(none, -1.0).otherwise(F.log1p(F.abs(a - b).cast("double"))).alias("f_hn_dfirst"),
        F.when(none, F.size(e)).otherwise(F.size(F.array_except(e, q))).cast("double").alias("f_num_eonly"),
    ]


def legal_words(full: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(full, F.lit("")), F.lit("([a-z0-9]+)"), 1), lambda w: w.isin(sorted({*t.LEGAL, *t.LEGAL_EXTRA}))))


def title_words(full: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(full, F.lit("")), F.lit("([a-z0-9]+)"), 1), lambda w: w.isin(t.TITLES)))


def lacking(words_: Column, other: Column) -> Column:
    return F.filter(words_, lambda r: ~F.array_contains(other, r.w))


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ALIGN]))
def alignment(own: pd.Series, sks: pd.Series, idfs: pd.Series, other: pd.Series, other_sks: pd.Series) -> pd.DataFrame:
    """Five figures on the words of `own` (with skeletons and idf) that `other` lacks; without words 0, the worst score 100.

    A word is there if its skeleton is, else by its best ratio with a word of the other side (under 75: not).
    """
    sizes = own.map(len).to_numpy(int)
    row = np.repeat(np.arange(len(own)), sizes)
    flat = lambda column: [x for part in column for x in part]
    words_, idf = flat(own), np.array(flat(idfs), float)
    found = [sk in these for part, these in zip(sks, map(set, other_sks), strict=True) for sk in part]
    score = np.full(len(row), 100.0)
    joined = [" ".join(part) for part in other]
    unsure = np.flatnonzero(~np.array(found, bool))
    place: dict[tuple[str, str], int] = {}
    at = [place.setdefault((words_[i], joined[row[i]]), len(place)) for i in unsure.tolist()]
    if place:
        score[unsure] = best_word_many([w for w, _ in place], [o for _, o in place])[at]
    out = score < 75
    total = lambda x: np.bincount(row, x, len(own))
    un, unidf, longest, worst = total(out.astype(float)), total(np.where(out, idf, 0.0)), np.zeros(len(own)), np.full(len(own), 100.0)
    np.maximum.at(longest, row, np.where(out, np.fromiter(map(len, words_), float, len(words_)), 0.0))
    np.minimum.at(worst, row, score)
    return pd.DataFrame({"un": un, "unidf": unidf, "unfrac": unidf / np.maximum(total(idf), 1e-6), "unlen": longest, "worst": worst}, index=own.index)


def extra_rates(extra: Column, prefix: str) -> list[Column]:
    """The least and greatest rate among extra words (w, rate), -1 if there is none, and how many have none."""
    rates = F.transform(extra, lambda r: r.rate)
    return [
        F.coalesce(F.array_min(rates), F.lit(-1.0)).alias(f"{prefix}_min"),
        F.coalesce(F.array_max(rates), F.lit(-1.0)).alias(f"{prefix}_max"),
        F.size(F.filter(rates, lambda r: r.isNull())).cast("double").alias(f"{prefix}_unk"),
    ]


def record_words(records: DataFrame, word_rates: DataFrame) -> DataFrame:
    """What the features need of each record: words of its name with skeletons, idf and rates, and its legal words, titles and numbers."""
    entities = records.where("src = 1")
    df, n = skeleton_df(entities), entities.agg(F.count("*").alias("n"))
    one = records.select("rid", F.posexplode(words(F.col("core"))).alias("at", "w")).withColumn("sk", skeleton(F.col("w")))
    rate = lambda side: word_rates.where(F.col("side") == side).select("w", F.col("rate").alias(f"rate_{side}"))
    one = one.join(df, "sk", "left").join(F.broadcast(n)).join(rate("q"), "w", "left").join(rate("e"), "w", "left")
    idf = F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))
    listed = one.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("at", "w", "sk", idf.alias("idf"), "rate_q", "rate_e"))).alias("all"))
    kept = F.filter("all", lambda r: ~r.w.isin(t.LEGAL_EXTRA))
    part = lambda rows, name, kind: F.coalesce(F.transform(rows, lambda r: r[name]), F.array().cast(f"array<{kind}>"))
    rated = lambda side: F.coalesce(F.array_distinct(F.transform("all", lambda r: F.struct(r.w.alias("w"), r[f"rate_{side}"].alias("rate")))), F.array().cast("array<struct<w:string,rate:double>>"))
    return records.join(listed, "rid", "left").select(
        "rid", F.col("rid").alias("there"), F.coalesce("legal", F.lit("")).alias("legal"), F.coalesce("country", F.lit("")).alias("country"), part("all", "w", "string").alias("t"),
        part(kept, "w", "string").alias("w"), part(kept, "sk", "string").alias("sk"), part(kept, "idf", "double").alias("idf"), rated("q").alias("rq"), rated("e").alias("re"),
        first_numbers(F.coalesce("nums", F.lit(""))).alias("n"), legal_words(F.col("name_full")).alias("l"), title_words(F.col("name_full")).alias("h"),
    )


COLUMNS = {"q": ["there", "legal", "country", "t", "w", "sk", "idf", "rq", "n", "l", "h"], "e": ["there", "legal", "t", "w", "sk", "idf", "re", "n", "l", "h"]}


def fine_features(pairs: DataFrame, records: DataFrame, word_rates: DataFrame, sig_rates: DataFrame, block_rows: int = 200_000) -> DataFrame:
    """(q_rid, e_rid) and FINE for pairs among records; pairs of records that aren't there are left out.

    What a feature needs of a record is put together once for each record and dealt as in met_pairs(), so a pair's words aren't shuffled.
    Signatures are few (kinds of edits, legal forms, countries), so their rates are broadcast.
    """
    keys, c = pairs.select("q_rid", "e_rid"), F.col
    cells = pair_cells(pairs.sparkSession, keys.select("q_rid").distinct().count(), records.where("src = 1").count(), block_rows)
    x = met_pairs(keys, record_words(records, word_rates), cells, list(dict.fromkeys(COLUMNS["q"] + COLUMNS["e"]))).where("there_q is not null and there_e is not null")
    sig = signatures(c("t_q"), c("t_e"), c("n_q"), c("n_e"), c("legal_q"), c("legal_e"), c("country_q"))
    aligned = lambda a, b: alignment(f"w_{a}", f"sk_{a}", f"idf_{a}", f"w_{b}", f"sk_{b}").alias(f"f{a}")
    x = x.select(
        "q_rid", "e_rid",
        F.coalesce(((F.get("w_q", 0) == F.get("w_e", 0)) | (F.get("sk_q", 0) == F.get("sk_e", 0))).cast("double"), F.lit(0.0)).alias("f_first_eq"),
        F.size(F.array_except("l_q", "l_e")).cast("double").alias("f_legal_qonly"),
        F.size(F.array_except("l_e", "l_q")).cast("double").alias("f_legal_eonly"),
        (F.size(F.array_except("h_q", "h_e")) + F.size(F.array_except("h_e", "h_q"))).cast("double").alias("f_title_diff"),
        F.arrays_overlap("h_q", "h_e").cast("double").alias("f_title_shared"),
        *number_gaps(c("n_q"), c("n_e")),
        *number_edits(c("n_q"), c("n_e")),
        *extra_rates(lacking(c("rq_q"), c("t_e")), "f_xq"),
        *extra_rates(lacking(c("re_e"), c("t_q")), "f_xe"),
        sig[0].alias("fine"), sig[1].alias("coarse"), aligned("q", "e"), aligned("e", "q"),
    )
    rate = lambda kind, name: sig_rates.where(F.col("kind") == kind).select(F.col("sig").alias(kind), F.col("rate").alias(name), F.col("n").alias(f"{kind}_n"))
    out = x.join(F.broadcast(rate("fine", "r_fine")), "fine", "left").join(F.broadcast(rate("coarse", "r_coarse")), "coarse", "left")
    out = out.select("*", *[F.col(f"f{side}.{k}").alias(f"f{side}_{k}") for side in "qe" for k in ALIGN])
    out = out.withColumns(
        {
            "f_sig_rate": F.coalesce("r_fine", "r_coarse", F.lit(-1.0)),
            "f_sig_logn": F.when(F.col("r_fine").isNotNull(), F.log1p(F.col("fine_n").cast("double"))).otherwise(0.0),
            "f_sig2_rate": F.coalesce("r_coarse", F.lit(-1.0)),
        }
    )
    return out.select("q_rid", "e_rid", *FINE)
