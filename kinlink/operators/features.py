"""The 66 features of a candidate pair for the first model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinlink.functions import strsim as s
from kinlink.functions.textnorm import words
from kinlink.operators.simjoin import VIEWS, view_dots
from kinlink.operators.tokens import tokenize, view_of
from kinlink.operators.windows import gap_to_best_other

GROUPED = ["n_tset", "n_ratio", "cos_name", "cos_addr", "cos_num", "a_tset", "bs_f"]
FEATURES = [
    "bs_f", "br_f", "bs_n", "br_n",
    *[f"{k}_{v}" for v in VIEWS for k in ("cos", "covq", "cove", "nq", "ne")],
    "n_ratio", "n_tsort", "n_tset", "n_partial", "n_jw", "n_despace", "n_despace_part",
    "sk_ratio", "sk_tset", "full_tsort", "a_ratio", "a_tset", "a_tsort", "a_partial_tset",
    "n_alt", "num_nq", "num_ne", "num_shared", "num_first_eq", "num_first_in", "legal_eq",
    "state_eq", "q_noaddr", "q_native", "len_cq", "len_ce", "ntok_cq", "len_aq", "len_ae",
    "q_src3", "q_ncand", "num_covq", "num_qonly",
    *[f"{c}_{k}" for c in GROUPED for k in ("gap", "rk")],
]


def three_valued(a: Column, b: Column) -> Column:
    """1 if equal, -1 if not, 0 if either is ''."""
    return F.when((a == "") | (b == ""), 0).when(a == b, 1).otherwise(-1)


def native_script(text: Column) -> Column:
    """Whether text has a character beyond the Latin blocks."""
    return text.rlike("[^\\x00-\\x{024F}]")


def number_features(nq: Column, ne: Column) -> list[Column]:
    """Counts, overlap and agreement of two arrays of number strings."""
    first_q, first_e = F.get(nq, 0), F.get(ne, 0)
    shared = F.size(F.array_intersect(nq, ne))
    return [
        F.size(nq).cast("double").alias("num_nq"),
        F.size(ne).cast("double").alias("num_ne"),
        shared.cast("double").alias("num_shared"),
        F.coalesce((first_q == first_e).cast("double"), F.lit(-1.0)).alias("num_first_eq"),
        F.when(first_q.isNull(), -1.0).otherwise(F.coalesce(F.array_contains(ne, first_q), F.lit(False)).cast("double")).alias("num_first_in"),
        (shared / F.greatest(F.size(nq), F.lit(1))).alias("num_covq"),
        (F.size(nq) - shared).cast("double").alias("num_qonly"),
    ]


def text_features() -> list[Column]:
    """Features of the texts of a pair; columns end in _q and _e, cq and ce are the names that count."""
    c = F.col
    flat = lambda x: F.regexp_replace(x, " ", "")
    return [
        s.ratio(c("cq"), c("ce")).alias("n_ratio"),
        s.token_sort_ratio(c("cq"), c("ce")).alias("n_tsort"),
        s.token_set_ratio(c("cq"), c("ce")).alias("n_tset"),
        s.partial_ratio(c("cq"), c("ce")).alias("n_partial"),
        s.jaro_winkler(c("cq"), c("ce")).alias("n_jw"),
        s.ratio(flat(c("cq")), flat(c("ce"))).alias("n_despace"),
        s.partial_ratio(flat(c("cq")), flat(c("ce"))).alias("n_despace_part"),
        s.ratio(c("core_sk_q"), c("core_sk_e")).alias("sk_ratio"),
        s.token_set_ratio(c("core_sk_q"), c("core_sk_e")).alias("sk_tset"),
        s.token_sort_ratio(c("name_full_q"), c("name_full_e")).alias("full_tsort"),
        s.ratio(c("addr_q"), c("addr_e")).alias("a_ratio"),
        s.token_set_ratio(c("addr_q"), c("addr_e")).alias("a_tset"),
        s.token_sort_ratio(c("addr_q"), c("addr_e")).alias("a_tsort"),
        s.partial_token_set_ratio(c("addr_q"), c("addr_e")).alias("a_partial_tset"),
        s.alt_score(c("alt_q"), c("cq"), c("alt_e"), c("ce")).alias("n_alt"),
        *number_features(words(c("nums_q")), words(c("nums_e"))),
        three_valued(c("legal_q"), c("legal_e")).cast("double").alias("legal_eq"),
        three_valued(c("state_q"), c("state_e")).cast("double").alias("state_eq"),
        (F.length("addr_q") == 0).cast("double").alias("q_noaddr"),
        F.coalesce(native_script(c("business_name_q")).cast("double"), F.lit(0.0)).alias("q_native"),
        F.length("cq").cast("double").alias("len_cq"),
        F.length("ce").cast("double").alias("len_ce"),
        F.regexp_count("cq", F.lit(" ")).cast("double").alias("ntok_cq"),
        F.length("addr_q").cast("double").alias("len_aq"),
        F.length("addr_e").cast("double").alias("len_ae"),
        (c("src_q") == 3).cast("double").alias("q_src3"),
    ]


RECORD_COLUMNS = ["src", "business_name", "name_full", "core", "core_sk", "legal", "alt", "addr", "nums", "state"]


def texts_filled(records: DataFrame, columns: list[str]) -> DataFrame:
    """rid and columns of records; texts that are null are ''."""
    texts = [n for n, kind in records.dtypes if kind == "string" and n != "business_name"]
    return records.na.fill("", texts).select("rid", *columns)


def stage1_features(pairs: DataFrame, records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(q_rid, e_rid), FEATURES and the columns keep for candidates (with bs_f, br_f, bs_n, br_n) among records; pairs of records that aren't there are left out.

    Both sides' columns come with the sums over tokens, so pairs are shuffled once, by query, when their features are figures.
    """
    tokens = tokenize(records).withColumn("view", view_of(F.col("tok")))
    known = texts_filled(records, RECORD_COLUMNS).withColumn("rid_", F.col("rid"))
    x = view_dots(pairs.select("q_rid", "e_rid", "bs_f", "br_f", "bs_n", "br_n", *keep), tokens, records.where("src = 1"), known, [*RECORD_COLUMNS, "rid_"])
    x = x.where("rid__q is not null and rid__e is not null")
    named = lambda side: F.when(F.length(f"core_{side}") > 0, F.col(f"core_{side}")).otherwise(F.col(f"name_full_{side}")).alias(f"c{side}")
    x = x.select("*", named("q"), named("e"))
    plain = ["bs_f", "br_f", "bs_n", "br_n", *[f"{k}_{v}" for v in VIEWS for k in ("cos", "covq", "cove", "nq", "ne")]]
    x = x.select("q_rid", "e_rid", *keep, *plain, *text_features())
    x = x.select("*", F.count("*").over(Window.partitionBy("q_rid")).cast("double").alias("q_ncand"))
    return gap_to_best_other(x, GROUPED, ranks=True).select("q_rid", "e_rid", *keep, *[F.col(c).cast("double").alias(c) for c in FEATURES])
