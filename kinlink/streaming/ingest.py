"""Records that arrive as files: normalised as a stream and appended to Parquet, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinlink.plans.linkage import normalise
from kinlink.sources.tables import RAW


def read_stream(spark: SparkSession, path: str, src: int) -> DataFrame:
    """Normalised records of the TSV files that come into path."""
    raw = spark.readStream.schema(RAW).option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "").csv(path)
    return normalise(raw.withColumn("src", F.lit(src)))


def append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes what there is now, then ends; called again it takes only what is new."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
