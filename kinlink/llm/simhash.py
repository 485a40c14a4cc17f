"""SimHash near duplicates by pigeonring filtering.

A fingerprint of 64 bits is cut into distance + 1 segments on a ring. If two fingerprints differ in at
most `distance` bits, some segment starts a chain whose first l segments differ in no more than
l * distance / (distance + 1) bits for every l; the first of them is thus equal. Distinct fingerprints
meet in buckets of an equal segment; there a chain is followed segment by segment, and only what stays
within the budgets gets the full Hamming check. A bucket yields a spanning forest of its links, never
its pairs. Buckets over `bucket_rows` are cut into blocks and all pairs of blocks are taken, so none is
dropped and none grows without bound.

Edge cases: a null text is an empty one; texts without words have fingerprint zero and link like any
other; shorter texts than a shingle are one shingle; repeated rows share their fingerprint; a null id
takes part in links, and its class is the least other id (null if there is none). An empty table gives
an empty result. Other columns, of any name, are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm import bands
from kinlink.llm.bands import Signature
from kinlink.llm.common import anti, free_name, map_batches, map_rows, schema, semi, staged
from kinlink.llm.components import components

BITS, SEED = 64, 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """The SimHash of the word shingles of text, repeats included, as an unsigned number."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    n, digest, ones = max(1, len(w) - words + 1), xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 65536):  # the votes of a very long text are counted in pieces
        h = np.fromiter((digest(b" ".join(w[i : i + words]), SEED) for i in range(at, min(n, at + 65536))), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """docs' other columns with fp (the fingerprint as a signed long) and body (a 128-bit digest of the text) for text_col."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    out = T.StructType([*rest, T.StructField("fp", T.LongType()), T.StructField("body", T.BinaryType())])

    def rows(batches):
        for b in batches:
            texts = b[text_col]
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield {f.name: b[f.name] for f in rest} | {"fp": fps, "body": [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]}

    return map_rows(docs, rows, out)


def segments(distance: int) -> list[tuple[int, int]]:
    """Shift and width of each of distance + 1 segments of near-equal width."""
    cuts = [BITS * k // (distance + 1) for k in range(distance + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def within(x: np.ndarray, first: int, distance: int) -> np.ndarray:
    """Which of the differences x start a chain at segment first and have at most distance bits set."""
    cut = segments(distance)
    alive = np.arange(len(x))
    total = np.zeros(len(x), np.int64)
    for step in range(len(cut)):
        shift, width = cut[(first + step) % len(cut)]
        part = (x[alive] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        total = total + np.bitwise_count(part)
        ok = total <= (step + 1) * distance // len(cut)
        alive, total = alive[ok], total[ok]
        if not len(alive):
            break
    return alive


def near_groups(values: np.ndarray, first: int, distance: int):
    """Places of values by their second segment, and a function to the groups within the chain's budget of one."""
    cut = segments(distance)
    shift, width = cut[(first + 1) % len(cut)]
    budget = 2 * distance // len(cut)
    if len(cut) < 2 or budget != 1 or len(values) <= 64:  # one group: the chain itself bounds the second segment
        return {0: np.arange(len(values))}, np.zeros(len(values), np.int64), [0]
    second = ((values >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
    order = np.argsort(second, kind="stable")
    starts = np.flatnonzero(np.r_[True, second[order][1:] != second[order][:-1]])
    groups = dict(zip(second[order][starts].tolist(), np.split(order, starts[1:]), strict=True))
    return groups, second, [0, *(1 << b for b in range(width))]


def linked(values: np.ndarray, first: int, distance: int, block: int = 1 << 20) -> np.ndarray:
    """Places of the values that are within distance of another of a near group."""
    groups, _, flips = near_groups(values, first, distance)
    busy = np.zeros(len(values), bool)
    for key, own in groups.items():
        others = values[np.concatenate([groups[key ^ f] for f in flips if key ^ f in groups])]
        for at in range(0, len(own), max(1, block // len(others))):
            rows = own[at : at + max(1, block // len(others))]
            close = np.bitwise_count(values[rows][:, None] ^ others[None, :]) <= distance
            busy[rows] = close.sum(1) > 1  # each is close to itself
    return np.flatnonzero(busy)


def forest(values: np.ndarray, first: int, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of values (distinct, equal in segment first) under within()."""
    places = linked(values, first, distance)
    values = values[places]
    groups, second, flips = near_groups(values, first, distance)
    out, todo = [], np.ones(len(values), bool)
    for root in range(len(values)):
        if not todo[root]:
            continue
        todo[root] = False
        queue = [root]
        while queue:
            at = queue.pop()
            for flip in flips:
                key = int(second[at]) ^ flip
                group = groups.get(key)
                if group is None:
                    continue
                live = group[todo[group]]
                if len(live) < len(group):
                    groups[key] = live
                if not len(live):
                    continue
                found = live[within(values[live] ^ values[at], first, distance)]
                if len(found):
                    todo[found] = False
                    queue += found.tolist()
                    out += [(int(places[at]), int(places[k])) for k in found.tolist()]
    return out


EDGES = schema(u=T.LongType(), v=T.LongType())


def links(distinct: DataFrame, distance: int = 2, bucket_rows: int = 32768) -> DataFrame:
    """Spanning links (u, v) between the distinct values of distinct.fp."""
    cut = segments(distance)
    segment = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << b) - 1)).cast("long") if b < BITS else F.col("fp") for a, b in cut]
    keys = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(n).alias("k"), s.alias("s")) for n, s in enumerate(segment)])).alias("key")).select("fp", "key.k", "key.s")
    large = keys.groupBy("k", "s").count().where(F.col("count") > bucket_rows)
    large = staged(large.select("k", "s", F.ceil(F.col("count") / (bucket_rows // 2)).cast("int").alias("blocks")), "buckets")
    if large.isEmpty():
        dealt = keys.select("k", "s", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
        dealt = keys.join(large, ["k", "s"], "left").select("k", "s", "fp", own.alias("own"), other.alias("other"))
        dealt = dealt.select("k", "s", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = dealt.repartition("k", "s", "a", "b").sortWithinPartitions("k", "s", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # rows of the bucket that the last batch left open

        def out(rows: np.ndarray) -> list[tuple[int, int]]:
            edge = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(1)) + 1
            found = []
            sizes = np.diff(np.r_[0, edge, len(rows)])
            for start, size in zip(np.r_[0, edge][sizes > 1], sizes[sizes > 1], strict=True):
                values = np.unique(rows[start : start + size, 4].view(np.uint64))
                found += [(values[a], values[b]) for a, b in forest(values, int(rows[start, 0]), distance)]
            return found

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            rows = np.column_stack([b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "s", "a", "b", "fp")])
            if not len(rows):
                continue
            if kept and (kept[-1][-1, :4] != rows[0, :4]).any():
                yield batch(out(np.concatenate(kept)))
                kept = []
            last = np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(1))
            cut_at = last[-1] + 1 if len(last) else 0
            if cut_at:
                yield batch(out(np.concatenate([*kept, rows[:cut_at]])))
                kept = []
            kept.append(rows[cut_at:])
        if kept:
            yield batch(out(np.concatenate(kept)))

    return map_batches(dealt, run, EDGES).distinct()


def shingles(text: str | None, words: int) -> np.ndarray:
    """The distinct word shingles of text, as sorted 64-bit hashes."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    n = max(1, len(w) - words + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), SEED) for i in range(n)), np.uint64, n))


def alike(texts: list[str | None], words: int, similarity: float) -> list[tuple[int, int]]:
    """Links that span the classes of texts by their shingles; a text is reached only by a link that holds."""
    sets = [shingles(t, words) for t in texts]
    sizes = np.array([len(x) for x in sets])
    names, places = np.unique(np.concatenate(sets), return_inverse=True)
    sets = np.split(places, np.cumsum(sizes)[:-1])
    mark, todo, left, out = np.zeros(len(names), bool), np.ones(len(sets), bool), np.arange(len(sets)), []
    for root in range(len(sets)):
        queue = [root] if todo[root] else []
        todo[root] = False
        while queue:
            at = queue.pop()
            left = left[todo[left]]
            near = left[np.minimum(sizes[left], sizes[at]) >= similarity * np.maximum(sizes[left], sizes[at])]
            if not len(near):
                continue
            mark[sets[at]] = True
            common = np.array([np.count_nonzero(mark[sets[k]]) for k in near])
            mark[sets[at]] = False
            found = near[common >= similarity * (sizes[near] + sizes[at] - common)]
            todo[found] = False
            queue += found.tolist()
            out += [(at, k) for k in found.tolist()]
    return out


def similar(texts: DataFrame, words: int, similarity: float, block_rows: int = 128, blocks: int = 24, block_chars: int = 8 << 20) -> DataFrame:
    """Spanning links (u, v) between the nodes of texts (staged: g, node, text) whose shingles are alike.

    Nodes of one g are compared in one place. A group of over two blocks of block_rows is cut into blocks,
    up to `blocks` of them, and into more if a block would hold over block_chars characters or 64 times
    block_rows; all pairs of blocks are taken.
    """
    n, chars = F.count("*"), F.sum(F.coalesce(F.length("text"), F.lit(0)))
    cut = F.greatest(F.least(F.ceil(n / block_rows), F.lit(blocks)), F.ceil(n / (64 * block_rows)), F.ceil(chars / block_chars))
    large = staged(texts.groupBy("g").agg(cut.cast("int").alias("blocks"), n.alias("n"), chars.alias("chars")).where((F.col("n") > 2 * block_rows) | (F.col("chars") > 2 * block_chars)).select("g", "blocks"), "groups")
    own, other = F.pmod(F.xxhash64("node"), F.coalesce("blocks", F.lit(1))).cast("int"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = texts.join(large, "g", "left").select("g", "node", "text", "blocks", own.alias("own"), other.alias("other")).where("own <> other or coalesce(blocks, 1) = 1")
    dealt = dealt.select("g", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "node", "text")
    dealt = dealt.repartition("g", "a", "b").sortWithinPartitions("g", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []  # the group that the last batch left open

        def links() -> list[tuple[int, int]]:
            nodes = np.concatenate([b.column("node").to_numpy() for b in kept])
            if len(nodes) < 2:
                return []
            return [(nodes[x], nodes[y]) for x, y in alike([t for b in kept for t in b.column("text").to_pylist()], words, similarity)]

        def batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for b in batches:
            keys, found = np.column_stack([b.column(n).to_numpy().astype(np.int64) for n in ("g", "a", "b")]), []
            edge = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for start, end in zip(np.r_[0, edge], np.r_[edge, len(keys)], strict=True):
                if end > start and key != (now := tuple(keys[start].tolist())):
                    found += links() if kept else []
                    key, kept = now, []
                kept.append(b.slice(start, end - start))
            yield batch(found)
        if kept:
            yield batch(links())

    return map_batches(dealt, run, EDGES)


def grouped(edges: DataFrame, name: str) -> DataFrame:
    """(name, root) for every node of an edge, the roots as well."""
    tree = components(edges)
    return tree.select(F.col("node").alias(name), "root").unionByName(tree.select(F.col("root").alias(name), "root").distinct())


def link(prints: DataFrame, distance: int = 2, bucket_rows: int = 32768) -> DataFrame:
    """prints (staged: id, fp and any others) with class_id: the least id whose fingerprint can be reached by links."""
    distinct = staged(prints.groupBy("fp").agg(F.min("id").alias("class_id"), F.count("*").alias("n")), "fingerprints")
    member = grouped(links(distinct.select("fp"), distance, bucket_rows), "fp")
    own = member.join(distinct, "fp").groupBy("root").agg(F.min("class_id").alias("of_class"))
    classes = distinct.join(member.join(own, "root").drop("root"), "fp", "left").select("fp", "n", F.coalesce("of_class", "class_id").alias("class_id"))
    return attach(prints, staged(classes, "classes"))


def attach(prints: DataFrame, classes: DataFrame, by: str | list[str] = "fp", share: int = 1000) -> DataFrame:
    """prints with the columns of classes, by the columns `by`; classes.n counts the rows of each.

    Keys with over 1/share of all rows, of which there are fewer than share, go by a broadcast, so their
    rows stay where they are; the others are shuffled.
    """
    by = [by] if isinstance(by, str) else by
    limit = (classes.agg(F.sum("n")).first()[0] or 0) // share
    hot, cold = classes.where(F.col("n") > limit), classes.where(F.col("n") <= limit)
    there = prints.join(F.broadcast(hot.drop("n")), by)
    return there.unionByName(prints.join(F.broadcast(hot.select(*by)), by, "left_anti").join(cold.drop("n"), by))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2, bucket_rows: int = 32768) -> DataFrame:
    """For each row its id, fp, body and class_id."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return link(staged(fingerprints(source, words=words), "simhash"), distance, bucket_rows)


def signed(docs: DataFrame, text_col: str, words: int, shingle: int, signature: Signature) -> DataFrame:
    """docs' other columns with fp and body as in fingerprints(), and the band keys of the shingles of text_col."""
    rest = [f for f in docs.schema.fields if f.name != text_col]
    out = T.StructType([*rest, T.StructField("fp", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def rows(batches):
        for b in batches:
            texts = b[text_col]
            fps = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            bodies = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            yield {f.name: b[f.name] for f in rest} | {"fp": fps, "body": bodies, "keys": [signature.keys(shingles(t, shingle)) for t in texts]}

    return map_rows(docs, rows, out)


def candidate_links(nodes: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """Links (u, v) between nodes (staged: node, fp, keys) that are worth a comparison of their texts.

    Fingerprints within `distance`, of which the chains find all, and buckets of MinHash bands. A fingerprint
    is stood for by its first node.
    """
    first = staged(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "fingerprints")
    end = lambda c: first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node"))
    near = links(first.select("fp"), distance, bucket_rows).join(end("u"), "u").join(end("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    shared = attach(nodes.select("fp", "node"), first).where("node <> first").select(F.col("node").alias("u"), F.col("first").alias("v"))
    return near.unionByName(shared).unionByName(bands.links(nodes))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 3, shingle: int = 5, similarity: float = 0.8, bucket_rows: int = 32768, n_bands: int = 32, band_rows: int = 8) -> DataFrame:
    """docs without all but the first row (by id, nulls last, then place) of each near-duplicate class.

    A link needs a Jaccard similarity of `shingle`-word shingles of at least `similarity`; classes are the
    components of such links, and equal texts are always one class. Texts are compared if they lie in one
    component of the candidate links: fingerprints within `distance`, and `n_bands` MinHash bands of `band_rows`
    minima. A pair of the least similarity meets in a band with a probability of 0.997, one of 0.9 in all
    but 10^-7 of cases; fingerprints alone lie too far apart for most pairs near 0.8.
    """
    row = free_name(docs, "row")
    marked = docs.withColumn(row, F.monotonically_increasing_id())
    source = marked.select(F.col(row).alias("id"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    prints = staged(signed(source, "text", words, shingle, Signature(n_bands, band_rows)), "simhash")
    order = F.struct(F.col("doc").isNull().alias("no"), "doc", "id")
    # a fingerprint says nothing of texts that share it: each text is a node of its own
    nodes = staged(prints.groupBy("fp", "body").agg(F.min("id").alias("node"), F.min(order).alias("first"), F.count("*").alias("n"), F.min_by("keys", "id").alias("keys")), "nodes")
    group = grouped(candidate_links(nodes.select("node", "fp", "keys"), distance, bucket_rows), "node").withColumnRenamed("root", "g")
    wanted = staged(group.select(F.col("node").alias("id"), "g"), "ends")
    texts = semi(source.select("id", "text"), "id", wanted).select("g", F.col("id").alias("node"), "text")
    alike = grouped(similar(staged(texts, "texts"), shingle, similarity), "node")
    own = alike.join(nodes, "node").groupBy("root").agg(F.min("first").alias("of_first"))
    found = nodes.drop("keys").join(alike.join(own, "root").drop("root"), "node", "left").select("fp", "body", "n", F.coalesce("of_first", "first").alias("first"))
    classes = attach(prints.drop("keys"), staged(found, "classes"), ["fp", "body"])
    drop = staged(classes.where("id <> first.id").select(F.col("id").alias(row)), "duplicates")
    return anti(marked, row, drop).select(*docs.columns)


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document, by near_duplicates()."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("class_id").alias("component_id"))
