"""Keyed updates and other table operations that the pipelines use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def keyed_upsert(full: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """full, with the non-null values of new where the key is in both."""
    changed = [c for c in new.columns if c != key]
    fresh = new.select(key, *[F.col(c).alias(f"__{c}") for c in changed])
    return full.join(fresh, key, "left").select(*[F.coalesce(f"__{c}", c).alias(c) if c in changed else F.col(c) for c in full.columns])


def replace_by_key(full: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """full without the keys of new, and new."""
    return full.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def union_ragged(*tables: DataFrame) -> DataFrame:
    """All rows; columns that a table lacks are null."""
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def dense_rid(records: DataFrame, order: list[str]) -> DataFrame:
    """records with rid: places from 0 in the order of the columns.

    Ranges of the order are sorted apart; each adds the number of rows in the ranges before it, so no task
    sees more than a range.
    """
    ranged = records.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__at", place).join(F.broadcast(before), "__part").withColumn("rid", F.col("__at") + F.col("__before")).drop("__part", "__at", "__before")


def chunked(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with chunk: in which run of `size` rows, in the order of the columns, a row is."""
    return dense_rid(df, order).withColumn("chunk", F.floor(F.col("rid") / size).cast("long")).drop("rid")


def cast_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of schema in its order and types; those that df lacks are null, others are left out."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def suffixed(df: DataFrame, suffix: str) -> DataFrame:
    """df with suffix at the end of every column's name."""
    return df.select(*[F.col(c).alias(f"{c}{suffix}") for c in df.columns])


def join_in_order(df: DataFrame, key: str, items: str, table: DataFrame, item: str, value: str) -> DataFrame:
    """(key, value): for each row of df the value of each of its items in table (null without), in the items' order."""
    one = df.select(key, F.posexplode(items).alias("__at", item)).join(table.select(item, value), item, "left")
    lists = one.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("__at", value))).alias("__all"))
    return lists.select(key, F.transform("__all", lambda v: v[value]).alias(value))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def joined_lists(pairs: DataFrame, entities: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Every entity with its distinct values, sorted as text and joined by commas; '' without any."""
    lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias(name))
    return entities.join(lists, key, "left").withColumn(name, F.coalesce(name, F.lit("")))
