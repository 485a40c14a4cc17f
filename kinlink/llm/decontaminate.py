"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

A window is `size` consecutive words of an item (all of a shorter item). A document contains a window
when the window's words stand in it in a row, so of the window's words, ordered by rarity over all
documents, the first (the rarest) must occur: for a containment of 1 the necessary prefix is one word.
A document word that is such a prefix proposes every window with it at the offset it has there;
positional bounds (the window must begin and end inside the document, whose length bounds it) prune,
and the words of the span are then compared one by one.

The items are taken in blocks of bounded size, one block at a time on the driver; each is one pass over
the documents, and no document is ever compared with all items. Two passes read the documents for a block: one
counts the items' words over all documents, one joins. With more than one block only hits are kept between them, and
they are put together by document at the end.

Edge cases: a null text or item has no words, an empty one too; an item without words has no window;
items that repeat, also under one id, hit the same words and count once an id; windows of an item with a
null id count like others, but the item isn't named or counted; repeated documents give repeated rows; an
empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import map_batches, map_rows, schema, staged

#: Upper to lower case, other characters than letters and digits to a space; bytes of 0x80 and over stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of a-z, 0-9 and non-ASCII characters after A-Z is lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Windows:
    """The distinct windows of a block of items."""

    def __init__(self, items: list[tuple[str | None, str | None]], size: int) -> None:
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item_id, text in items:
            w = words(text)
            for n in range(max(1, len(w) - size + 1) if w else 0):
                owners[tuple(w[n : n + size])].update(() if item_id is None else (item_id,))
        self.owners = dict(owners)
        self.vocabulary = {w for window in owners for w in window}

    def by_prefix(self, frequency: dict[bytes, int]) -> dict[bytes, list[tuple[int, list[bytes], list[str]]]]:
        """Rarest word -> offset of it, window, owners; ties go to the word of the lower bytes."""
        out = defaultdict(list)
        for window, ids in self.owners.items():
            rarest = min(window, key=lambda w: (frequency.get(w, 0), w))
            out[rarest].append((window.index(rarest), list(window), sorted(ids)))
        return dict(out)


def blocks(benchmark: DataFrame, size: int, block_chars: int) -> Iterator[Windows]:
    """Items in blocks of at most block_chars characters (or one item), streamed to the driver."""
    held, chars = [], 0
    for item_id, text in benchmark.toLocalIterator():
        if held and chars + len(text or "") > block_chars:
            yield Windows(held, size)
            held, chars = [], 0
        held.append((item_id, text))
        chars += len(text or "")
    if held:
        yield Windows(held, size)


def document_frequency(docs: DataFrame, text_col: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """In how many documents each word of vocabulary occurs; the result is no larger than vocabulary."""

    def rows(batches):
        seen: Counter[bytes] = Counter()
        for b in batches:
            for text in b["text"]:
                seen.update(vocabulary.intersection(words(text)))
        yield {"word": list(seen), "n": list(seen.values())}

    counts = map_rows(docs.select(F.col(text_col).cast("string").alias("text")), rows, schema(word=T.BinaryType(), n=T.LongType()))
    return {bytes(w): n for w, n in counts.groupBy("word").agg(F.sum("n")).toLocalIterator()}


def hits(w: list[bytes], index: dict[bytes, list[tuple[int, list[bytes], list[str]]]]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged spans of words that windows cover, and the items whose windows occur."""
    spans, found = [], set()
    if index.keys().isdisjoint(w):
        return spans, found
    for at, word in enumerate(w):
        for offset, window, ids in index.get(word, ()):
            start = at - offset
            if start >= 0 and start + len(window) <= len(w) and w[start : start + len(window)] == window:
                spans.append((start, start + len(window)))
                found.update(ids)
    return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
FOUND = schema(doc_id=T.LongType(), n_words=T.LongType(), spans=T.ArrayType(_SPAN), items=T.ArrayType(T.StringType()))
HITS = schema(row=T.LongType(), spans=T.ArrayType(_SPAN), items=T.ArrayType(T.StringType()))


def _spans(spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"start": s, "end": e} for s, e in spans]


def contain(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """For each document its words, the word spans that item windows cover, and those items' ids."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    waiting = blocks(benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")), size, block_chars)
    first, second = next(waiting, None) or Windows([], size), next(waiting, None)

    def indexed(block: Windows) -> dict:
        return block.by_prefix(document_frequency(docs, "text", block.vocabulary) if block.vocabulary else {})

    if second is None:
        index = indexed(first)

        def rows(batches):
            for b in batches:
                texts = [words(t) for t in b["text"]]
                found = [hits(w, index) for w in texts]
                yield {"doc_id": b["doc_id"], "n_words": [len(w) for w in texts], "spans": [_spans(s) for s, _ in found], "items": [sorted(i) for _, i in found]}

        return map_rows(docs, rows, FOUND)

    marked = docs.withColumn("row", F.monotonically_increasing_id())

    def hit(index: dict) -> DataFrame:
        def rows(batches):
            for b in batches:
                found = [(row, *hits(words(t), index)) for row, t in zip(b["row"], b["text"], strict=True)]
                found = [(row, spans, items) for row, spans, items in found if spans]
                yield {"row": [r for r, _, _ in found], "spans": [_spans(s) for _, s, _ in found], "items": [sorted(i) for _, _, i in found]}

        return map_rows(marked.select("row", "text"), rows, HITS)

    parts = [staged(hit(indexed(first)), "hits"), staged(hit(indexed(second)), "hits")]
    del first, second
    parts += [staged(hit(indexed(block)), "hits") for block in waiting]
    found = reduce(DataFrame.unionByName, parts).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def sizes(batches):
        for b in batches:
            yield {"row": b["row"], "doc_id": b["doc_id"], "n_words": [len(words(t)) for t in b["text"]]}

    def together(batches):
        for b in batches:
            spans = [merged([(x["start"], x["end"]) for x in s or []]) for s in b["spans"]]
            yield {"doc_id": b["doc_id"], "n_words": b["n_words"], "spans": [_spans(s) for s in spans], "items": [sorted(i or []) for i in b["items"]]}

    counted = map_rows(marked, sizes, schema(row=T.LongType(), doc_id=T.LongType(), n_words=T.LongType()))
    return map_rows(counted.join(found, "row", "left").drop("row"), together, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_chars: int = 16_000_000) -> DataFrame:
    """The rows of docs, whole and with all their columns, in which no item window occurs."""
    out = docs
    for block in blocks(benchmark.select(F.col(item_id).cast("string"), F.col(item_text).cast("string")), size, block_chars):
        if not block.vocabulary:
            continue
        index = block.by_prefix(document_frequency(docs, text_col, block.vocabulary))

        def run(batches, index=index):
            for b in batches:
                keep = [not hits(words(t), index)[0] for t in b.column(text_col).to_pylist()]
                yield b if all(keep) else b.filter(pa.array(keep))

        out = map_batches(out, run, docs.schema)
    return out


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, by contain()."""
    found = contain(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (win) WHERE dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
