"""MinHash bands: links between texts whose shingle sets are likely alike, without their pairs.

A signature has `bands` times `rows` minima, each under a function of its own; texts of equal values in a whole band
meet in a bucket. A pair of Jaccard similarity s does so with a probability of 1 - (1 - s ** rows) ** bands.
Every member of a bucket is linked with its first one, so links grow with the members and no pair is made;
members that one batch has in a bucket are put together before the shuffle, so a hot bucket has a row a batch.

Edge cases: an empty set has a signature of its own and meets only other empty sets; nodes without a bucket
mate have no link; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import map_batches, schema


def probability(similarity: float, bands: int, rows: int) -> float:
    """How likely a pair of that similarity meets in a bucket."""
    return 1 - (1 - similarity**rows) ** bands


class Signature:
    """Band keys of a set of 64-bit hashes."""

    def __init__(self, bands: int, rows: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor, self.shift, self.mix = (rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (bands * rows, bands * rows, bands * rows))

    def keys(self, hashes: np.ndarray, chunk: int = 2048) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), chunk):
            least = np.minimum(least, (hashes[at : at + chunk, None] * self.factor + self.shift).min(0))
        least ^= least >> np.uint64(29)
        return ((least * self.mix).reshape(self.bands, self.rows)).sum(1, dtype=np.uint64).view(np.int64)


LINKS = schema(u=T.LongType(), v=T.LongType())
BUCKETS = schema(key=T.LongType(), node=T.LongType(), others=T.ArrayType(T.LongType()))


def links(nodes: DataFrame) -> DataFrame:
    """Links (u, v) of nodes (node: long, keys: array of long) with the first node of each of their buckets."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column("keys").flatten().to_numpy(zero_copy_only=False)
            node = np.repeat(b.column("node").to_numpy(zero_copy_only=False), len(keys) // b.num_rows)
            order = np.lexsort((node, keys))
            keys, node = keys[order], node[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            first = np.zeros(len(keys), bool)
            first[starts] = True
            ends = np.cumsum(np.diff(np.r_[starts, len(keys)]) - 1)
            others = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(node[~first]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[starts]), pa.array(node[starts]), others], names=BUCKETS.names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_node = None, None
        for b in batches:
            if not b.num_rows:
                continue
            key, node = (b.column(n).to_numpy(zero_copy_only=False) for n in ("key", "node"))
            new = np.r_[last_key is None or key[0] != last_key, key[1:] != key[:-1]]
            group = np.cumsum(new) - 1  # -1: the bucket that the last batch left open
            firsts = node[new]
            head = np.where(group < 0, last_node if last_node is not None else 0, firsts[np.maximum(group, 0)] if len(firsts) else 0)
            sizes = np.diff(b.column("others").offsets.to_numpy())
            others = b.column("others").flatten().to_numpy(zero_copy_only=False)
            u = np.r_[node, others].astype(np.int64)
            v = np.r_[head, np.repeat(head, sizes)].astype(np.int64)
            last_key, last_node = key[-1], head[-1]
            apart = u != v
            yield pa.RecordBatch.from_arrays([pa.array(u[apart]), pa.array(v[apart])], names=LINKS.names)

    dealt = map_batches(nodes.select("node", "keys"), deal, BUCKETS)
    return map_batches(dealt.repartition("key").sortWithinPartitions("key", "node"), meet, LINKS).groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).agg(F.lit(1)).select("u", "v")
