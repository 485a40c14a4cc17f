"""Sources and sinks: TSV and Parquet scans, resumable part writes, result lists, configurations."""

from __future__ import annotations

import gc
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.operators.relational import joined_lists

RAW = T.StructType([T.StructField(n, T.StringType()) for n in ("entity_id", "business_name", "business_address", "country")])
TRUTH = T.StructType([T.StructField(n, T.StringType()) for n in ("source1_entity_id", "matched_entity_ids")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Tab-separated text with a header, without quoting; all columns are strings and '' is null."""
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "").option("emptyValue", "").option("inferSchema", False)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Never quoted; '' and null are written as nothing, spaces as they are."""
    df.write.mode("overwrite").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("nullValue", "").csv(path)


def truth_pairs(truth: DataFrame, records: DataFrame) -> DataFrame:
    """(q_rid, true_e) from a list of matched ids an entity; ids that no record has are left out."""
    ids = records.select("entity_id", "rid")
    flat = truth.select("source1_entity_id", F.explode(F.split("matched_entity_ids", ",")).alias("qid")).where("qid is not null and qid <> ''")
    return flat.join(ids.select(F.col("entity_id").alias("qid"), F.col("rid").alias("q_rid")), "qid").join(ids.select(F.col("entity_id").alias("source1_entity_id"), F.col("rid").alias("true_e")), "source1_entity_id").select("q_rid", "true_e")


def write_lists(pairs: DataFrame, records: DataFrame, name: str, path: str) -> DataFrame:
    """One line an entity with the ids of its queries; returns what was written."""
    ids = pairs.join(records.select(F.col("rid").alias("q_rid"), F.col("entity_id").alias("qid")), "q_rid")
    entities = records.where("src = 1").select(F.col("rid").alias("e_rid"), F.col("entity_id").alias("source1_entity_id"))
    out = joined_lists(ids, entities, "e_rid", "qid", name).select("source1_entity_id", name)
    write_tsv(out, path)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether path is there, in whatever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_parts(df: DataFrame, key: str, path: str, n: int = 16) -> DataFrame:
    """df in n buckets of key under path; buckets that an earlier run finished aren't written again.

    df is read once for all buckets that are missing. A bucket is complete once its file of `done` is there, which
    is written after its rows, so a run that was stopped goes on where it was.
    """
    spark = df.sparkSession
    missing = [k for k in range(n) if not exists(spark, f"{path}/done/{k}/_SUCCESS")]
    if missing:
        bucket = F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        rows = df.withColumn("bucket", bucket).where(F.col("bucket").isin(missing))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
        for k in missing:
            spark.range(0).write.mode("overwrite").parquet(f"{path}/done/{k}")
    return spark.read.parquet(f"{path}/rows").select(*df.columns)


def drop_part(spark: SparkSession, path: str, k: int) -> None:
    """Takes the mark of part k away, so that write_parts() makes it again."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done/{k}")
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cached(df_of, spark: SparkSession, base: str, name: str, **params) -> DataFrame:
    """The table that df_of() makes, kept under a name of its parameters, so that other settings make another."""
    tag = hashlib.sha256(json.dumps(params, sort_keys=True).encode()).hexdigest()[:12]
    path = f"{base}/{name}-{tag}"
    if not exists(spark, f"{path}/_SUCCESS"):
        df_of().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shared_path(spark: SparkSession, stem: str) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names.

    Only where a local session names none a temporary folder is set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="kinlink-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/kinlink-{stem}-{uuid.uuid4().hex}"


#: Paths of what is settled while settled_alone() makes a table, by nesting.
_within: list[list[str]] = []


def settled(df: DataFrame) -> DataFrame:
    """df as a table of the shared folder: later plans begin there.

    Spark removes the shuffle files of what is written when the driver collects its garbage, so that is asked for; plans
    that Python still holds in cycles of references are let go first.
    """
    path = shared_path(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    if _within:
        _within[-1].append(path)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_alone(make: Callable[[], DataFrame | tuple[DataFrame, ...]]) -> DataFrame | tuple[DataFrame, ...]:
    """settled() of each table of make(); what was settled on the way is removed, but for what inner calls of this have made."""
    _within.append([])
    try:
        made = make()
        way = list(_within[-1])
        found = tuple(map(settled, made)) if isinstance(made, tuple) else settled(made)
    finally:
        _within.pop()
    spark = (found[0] if isinstance(found, tuple) else found).sparkSession
    for path in way:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return found


def write_table(df: DataFrame, path: str) -> None:
    """df as Parquet with the usual compression, in place of what is there."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def id_range(df: DataFrame, key: str, first: int, end: int) -> DataFrame:
    """The rows of df with a key from first to end (exclusive), by a filter that reaches the scan."""
    return df.where((F.col(key) >= first) & (F.col(key) < end))


def save_config(spark: SparkSession, config: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def backup(spark: SparkSession, path: str, tag: str) -> str:
    """A copy of the table at path beside it, made once: a patch that runs again keeps the first one."""
    copy = f"{path.rstrip('/')}_{tag}"
    if not exists(spark, f"{copy}/_SUCCESS"):
        spark.read.parquet(path).write.mode("overwrite").parquet(copy)
    return copy
