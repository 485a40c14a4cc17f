"""What the corpus operators share: shared storage, staged tables and Arrow row maps."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where a local session names none (tests) a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="kinlink-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df written once to the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/kinlink-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffles_back(spark: SparkSession) -> None:
    """Shuffle files of plans that nothing refers to any more are removed: Python's references end first, then Java's."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes of an Arrow batch that Python reads at once; lists of its strings take several times as much.
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of Arrow batches to BATCH_BYTES, unless it is lower."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


#: What a Python worker keeps from one task to the next: one object at most, by key.
_held: dict[str, object] = {}


def held(key: str, make: Callable[[], object]) -> object:
    """The object of key, made once in a worker, as long as its tasks ask for the same key."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Memory that Arrow and the C library hold but don't use goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:  # glibc
        trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType, key: str | None = None) -> DataFrame:
    """mapInArrow with small batches; memory is given back when a task ends.

    A task drops what tasks of another key than its own have held in its worker.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _held:
            _held.clear()
        yield from run(batches)
        give_back()

    small_batches(df.sparkSession)
    return df.mapInArrow(task, schema)


def map_rows(df: DataFrame, rows: Callable[[Iterator[dict[str, list]]], Iterable[dict[str, list]]], schema: T.StructType, key: str | None = None) -> DataFrame:
    """mapInArrow over column lists: rows gets {column: values} a batch and yields the same for schema."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in rows({n: b.column(n).to_pylist() for n in b.schema.names} for b in batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return map_batches(df, run, schema, key)


def _marked(df: DataFrame, key: str, keys: DataFrame, bits: int) -> tuple[DataFrame, Column]:
    """df beside a bitmap of the hashes of keys, and whether its row's bit is set.

    The bitmap has a fixed size and is broadcast (bits / 8 bytes at most, in rows of 4 KB). Callers use it only
    for keys that leave most of its bits unset.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    chunk, bit = F.bitmap_bucket_number(slot), F.bitmap_bit_position(slot)
    marks = keys.groupBy(chunk.alias("__chunk")).agg(F.bitmap_construct_agg(bit).alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__bit div 8) + 1, 1)")), 16, 10).cast("int")
    isset = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, int(__bit % 8))")) != 0, F.lit(False))
    return df.withColumns({"__chunk": chunk, "__bit": bit}).join(F.broadcast(marks), "__chunk", "left"), isset


def semi(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """df joined with keys (staged) by key (long, unique in keys).

    Rows that a bitmap rules out aren't shuffled. Keys for more than half of its bits are joined without.
    """
    if keys.count() > bits // 2:
        return df.join(keys, key)
    beside, isset = _marked(df, key, keys, bits)
    return beside.where(isset).select(*df.columns).join(keys, key)


def anti(df: DataFrame, key: str, keys: DataFrame, bits: int = 1 << 26) -> DataFrame:
    """The rows of df whose key isn't in keys (staged).

    Only rows that a bitmap can't rule out are shuffled. Keys for more than half of its bits are joined without.
    """
    if keys.count() > bits // 2:
        return df.join(keys, key, "left_anti")
    beside, isset = _marked(df, key, keys, bits)
    return beside.where(~isset).select(*df.columns).unionByName(beside.where(isset).select(*df.columns).join(keys, key, "left_anti"))


class Spans:
    """Spans of a text, merged, to ask whether another one overlaps any of them in logarithmic time."""

    def __init__(self, spans: Iterable[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlap(self, a: int, b: int) -> bool:
        n = bisect_left(self.starts, b) - 1
        return n >= 0 and self.ends[n] > a

    def add(self, a: int, b: int) -> None:
        """Adds a span that overlaps none."""
        n = bisect_left(self.starts, a)
        self.starts.insert(n, a)
        self.ends.insert(n, b)


def schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_text(batch: pa.RecordBatch, text: str, values: list[str | None], n_chars: str | None) -> pa.RecordBatch:
    """batch with another text column, and n_chars (where there is one) counted again."""
    columns = {n: batch.column(n) for n in batch.schema.names}
    columns[text] = pa.array(values, batch.schema.field(text).type)
    if n_chars and n_chars in columns and pa.types.is_integer(batch.schema.field(n_chars).type):
        columns[n_chars] = pa.array([None if v is None else len(v) for v in values], batch.schema.field(n_chars).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)
