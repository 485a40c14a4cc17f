"""Window features: gaps to the best other, ranks and statistics of partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_to_best_other(df: DataFrame, cols: list[str], key: str = "q_rid", ranks: bool = False) -> DataFrame:
    """df with col_gap (and col_rk): how far a row is over the best other row of its key; tied tops get 0."""
    w = Window.partitionBy(key)
    top = df.select("*", *[F.max(c).over(w).alias(f"__{c}_top") for c in cols])
    more = top.select(
        "*",
        *[F.sum((F.col(c) == F.col(f"__{c}_top")).cast("int")).over(w).alias(f"__{c}_n") for c in cols],
        *[F.coalesce(F.max(F.when(F.col(c) < F.col(f"__{c}_top"), F.col(c))).over(w), F.lit(0.0)).alias(f"__{c}_next") for c in cols],
    )
    out = []
    for c in cols:
        alone = (F.col(c) == F.col(f"__{c}_top")) & (F.col(f"__{c}_n") == 1)
        out.append((F.col(c) - F.when(alone, F.col(f"__{c}_next")).otherwise(F.col(f"__{c}_top"))).alias(f"{c}_gap"))
        if ranks:
            out.append(F.rank().over(Window.partitionBy(key).orderBy(F.desc(c))).cast("double").alias(f"{c}_rk"))
    return more.select(*df.columns, *out)


def query_context(scores: DataFrame) -> DataFrame:
    """scores (q_rid, e_rid, p, …) with q_max, q_gap, q_sum, q_n10, q_rank and the e_ columns."""
    wq, we = Window.partitionBy("q_rid"), Window.partitionBy("e_rid")
    x = gap_to_best_other(scores, ["p"]).withColumnRenamed("p_gap", "q_gap").select(
        "*",
        F.max("p").over(wq).alias("q_max"),
        F.sum("p").over(wq).alias("q_sum"),
        F.sum((F.col("p") > 0.1).cast("double")).over(wq).alias("q_n10"),
        F.rank().over(wq.orderBy(F.desc("p"))).cast("double").alias("q_rank"),
    )
    win = ((F.col("q_rank") == 1) & (F.col("p") > 0.5)).cast("double")
    return x.select(
        "*",
        (F.sum(win).over(we) - win).alias("e_nwin_other"),
        F.sum("p").over(we).alias("e_psum"),
        F.count("*").over(we).cast("double").alias("e_ncand"),
        F.rank().over(we.orderBy(F.desc("p"))).cast("double").alias("e_rank"),
        F.max("p").over(we).alias("e_pmax"),
    )


def first_of(df: DataFrame, key: str, order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each key; their place (from 1) in column rank, if named."""
    place = rank or "__place"
    out = df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(place) <= n)
    return out if rank else out.drop(place)
