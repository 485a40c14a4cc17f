"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.common import shared_dir


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of an edge except the roots; root is the least node of its component.

    Rounds grow with the logarithm of the largest component; the last one is the first that changes no edge.
    Each round's edges are checkpointed in the shared folder, so a lost executor costs no more than a round.

    Edge cases: null ends and loops link nothing; repeated edges count once; without edges there is no row.
    """
    shared_dir(edges.sparkSession)
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct().checkpoint()
    size = now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        count = new.count()
        # both sets are distinct: of one size, they are the same if one lies in the other
        if count == size and new.join(now, ["u", "v"], "left_anti").isEmpty():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, size = new, count
