"""Vector best-fit packing of tokenised documents into sequences.

A piece needs tokens, one document place and attention cost (its length squared); a bin has a residual
capacity of each. Pieces go by falling length to the feasible bin that the rule prefers: the least
weighted norm of what would remain, or the greatest weighted dot product of need and residual.

Pieces of one length are alike, so the packing runs over the histogram of lengths (no more rows than a
sequence has tokens): bins in the same state form a group of consecutive numbers, and a step places as
many pieces as the rule would put there one after the other. Its result, a short list of placements
(length, ranks, bins, offset), is exact for any number of pieces. Ranks within a length come from counts
of each input partition, so no single task ever sees all pieces.

Edge cases: a null or empty text is its end mark alone; documents longer than a sequence are cut, others
never; repeated rows are packed each; an empty table gives no pieces.
"""

from __future__ import annotations

import math
import os
import string
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from kinlink.llm.common import held, map_batches, map_rows, schema, staged


class Encoder:
    """Token ids of a text as packed little-endian uint32, by a public tokenizer file that lowers case.

    The tokenizer never joins across a space or a line end, so ids are kept by chunk, in two generations
    of at most `kept` chunks. Between a letter or digit and the marks that end a chunk it splits as well,
    and a chunk of ASCII letters has the ids of its lower-case form, so few chunks need to be encoded.
    """

    def __init__(self, path: str, end: int = 0, kept: int = 800_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end, self.kept = array("I", [end]).tobytes(), kept
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def parts(chunk: str) -> tuple[str, ...]:
        """Pieces of chunk whose ids in a row are its ids."""
        if "<|" in chunk:  # may be a special token
            return (chunk,)
        core = chunk.rstrip(string.punctuation)
        tail = chunk[len(core) :]
        if core.isascii():
            core = core.lower()
        # a letter whose composed small form ends in a mark joins what follows
        last = core[-1:] if core.isascii() else unicodedata.normalize("NFC", core[-1]).lower()[-1]
        return (core, tail) if tail and last.isalnum() else (core + tail,)

    def _learn(self, chunks: set[str]) -> None:
        young, old = self.young, self.old
        cuts: dict[str, tuple[str, ...]] = {}
        missing = set()
        for c in chunks:
            known = old.get(c)
            if known is not None:
                young[c] = known
                continue
            cut = cuts[c] = (c.lower() if c.isascii() else c,) if c.isalnum() else self.parts(c)
            for p in cut:
                if p not in young:
                    known = old.get(p)
                    if known is None:
                        missing.add(p)
                    else:
                        young[p] = known
        order = list(missing)
        for c, found in zip(order, self.tokenizer.encode_batch(order, add_special_tokens=False) if order else (), strict=True):
            young[c] = array("I", found.ids).tobytes()
        for c, cut in cuts.items():
            young[c] = b"".join([young[p] for p in cut])

    def encode(self, text: str | None) -> bytes:
        chunks = (text or "").replace("\n", " ").split(" ")
        missing = {c for c in chunks if c not in self.young}
        if missing:
            if len(self.young) + len(missing) > self.kept:
                self.old, self.young, missing = self.young, {}, set(chunks)
            self._learn(missing)
        return b"".join([self.young[c] for c in chunks]) + self.end


def plan(histogram: dict[int, int], tokens: int = 2048, documents: int | None = None, attention: int | None = None, rule: str = "residual_norm", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)) -> np.ndarray:
    """Placements (length, first rank, pieces a bin, first bin, offset), sorted by length and rank."""
    cap = np.array([tokens, documents or tokens, attention or tokens * tokens], float)
    w = np.array(weights)
    if rule not in ("residual_norm", "dot_product"):
        raise ValueError(f"no rule {rule}")
    left = np.empty((1024, 3))  # residual capacity of each group of bins
    first, count = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    used = bins = 0
    out: list[tuple[int, int, int, int, int]] = []

    def add(residual: np.ndarray, start: int, n: int) -> None:
        nonlocal left, first, count, used
        if n == 0 or residual[0] < 1 or residual[1] < 1:
            return
        if used == len(first):
            left, first, count = np.concatenate([left, np.empty_like(left)]), np.concatenate([first, first * 0]), np.concatenate([count, count * 0])
        left[used], first[used], count[used] = residual, start, n
        used += 1

    for length in sorted(histogram, reverse=True):
        need, todo, rank = np.array([length, 1, length * length], float), histogram[length], 0
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no bin")
        while todo:
            ok = np.flatnonzero((left[:used] >= need).all(1))
            if len(ok):
                score = -(w * ((left[ok] - need) / cap) ** 2).sum(1) if rule == "residual_norm" else (w * need * left[ok] / cap**2).sum(1)
                g = ok[score.argmax()]
                residual, start, n = left[g].copy(), int(first[g]), int(count[g])
                used -= 1  # the group is taken out; what remains of it is added again
                left[g], first[g], count[g] = left[used], first[used], count[used]
            else:
                residual, start, n = cap.copy(), bins, math.inf
            most = int((residual // need).min())
            each = most if rule == "residual_norm" or n == math.inf else 1  # a filled bin stays the tightest
            whole = min(n, todo // each)
            part = todo - whole * each if whole < n and todo - whole * each < each else 0
            for pieces, size in ((each, whole), (part, 1 if part else 0)):
                if size:
                    out.append((length, rank, pieces, start, int(tokens - residual[0])))
                    add(residual - pieces * need, start, int(size))
                    rank, todo, start = rank + pieces * size, todo - pieces * size, start + int(size)
            if n == math.inf:
                bins = start
            else:
                add(residual, start, n - int(whole) - bool(part))
    return np.array(sorted(out), np.int64).reshape(-1, 5)


PIECES = schema(doc_id=T.LongType(), piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType(), part=T.LongType(), rank=T.LongType())
PACKED = schema(doc_id=T.LongType(), piece=T.IntegerType(), start=T.LongType(), length=T.LongType(), ids_crc32=T.LongType(), sequence_id=T.LongType(), offset=T.LongType())


def pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, size: int, kept: int) -> DataFrame:
    """Pieces with their rank among those of the same length in their partition.

    A Python worker keeps its encoder for all tasks, so later ones find its chunks known.
    """
    key = f"encoder {kept} {tokenizer}"

    def rows(batches: Iterator[dict[str, list]]):
        encoder, seen, part = held(key, lambda: Encoder(tokenizer, kept=kept)), Counter(), TaskContext.get().partitionId()
        for b in batches:
            out = {f.name: [] for f in PIECES}
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                ids = encoder.encode(text)
                for n, at in enumerate(range(0, len(ids), 4 * size)):
                    body = ids[at : at + 4 * size]
                    length = len(body) // 4
                    for name, value in zip(out, (doc_id, n, at // 4, length, zlib.crc32(body), part, seen[length]), strict=True):
                        out[name].append(value)
                    seen[length] += 1
            yield out

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, PIECES, key)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", tokens: int = 2048, documents: int | None = None, attention: int | None = None, rule: str = "residual_norm", weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6), kept: int = 800_000) -> DataFrame:
    """The pieces of docs with the sequence and the offset that each has.

    kept bounds the chunks whose ids a worker remembers (about 250 bytes each, in two generations).
    """
    size = min(tokens, math.isqrt(attention or tokens * tokens))
    cut = staged(pieces(docs, tokenizer, id_col, text_col, size, kept), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `size` rows
    placed = plan(histogram, tokens, documents, attention, rule, weights)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = cut.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    keys = placed[:, 0] * (1 << 44) + placed[:, 1]  # lengths stay under 2**19, ranks under 2**44

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            p = placed[np.searchsorted(keys, length * (1 << 44) + rank, side="right") - 1] if len(placed) else np.zeros((0, 5), np.int64)
            nth = rank - p[:, 1]
            columns = [b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(p[:, 3] + nth // p[:, 2]), pa.array(p[:, 4] + nth % p[:, 2] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=PACKED.names)

    return map_batches(ranked, run, PACKED)


def op6_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens, by pack()."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
