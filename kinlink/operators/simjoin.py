"""TF-IDF weights and the cosine top-K similarity join, as an inverted index a task.

A token that more than max_df records of the index hold is left out of the vocabulary. Queries are dealt over groups
and the index over blocks, both by hashes of ids; a task has one group and one block. It puts the block's rows under their
tokens and sums, query by query, over what the query's tokens hold, so what is shuffled are records (a query once for each block, a row of
the index once for each group) and not the pairs that share a token, and a hot token is no task's burden. Pairs are
made and dropped in memory; the best of several blocks are ranked anew.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kinlink.sources.tables import settled, settled_alone


def vocabulary(index_tokens: DataFrame, n_index: DataFrame, max_df: int | None = 3000) -> DataFrame:
    """(tok, df, w): document frequency and inverse weight over the index; n_index is one row of n."""
    df = index_tokens.groupBy("tok").agg(F.count("*").alias("df"))
    if max_df:
        df = df.where(F.col("df") <= max_df)
    return df.join(F.broadcast(n_index), how="inner").select("tok", "df", (F.log(F.col("n") + 1.0) - F.log(F.col("df").cast("double"))).alias("w"))


def count_of(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def weighted(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(rid, tok, x): weights of length 1 for each record; tokens out of vocabulary are left out."""
    w = tokens.join(vocab.select("tok", "w"), "tok")
    norm = w.groupBy("rid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "rid").select("rid", "tok", (F.col("w") / F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm"))).alias("x"))


class Postings:
    """The index rows of one block, by token: which rows hold it."""

    def __init__(self, rows: list[pa.RecordBatch]) -> None:
        flat = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) if rows else np.zeros(0)
        self.rid, self.norms = flat("rid").astype(np.int64), [flat("full"), flat("part")]
        toks = np.concatenate([b.column("toks").flatten().to_numpy() for b in rows]) if rows else np.zeros(0, np.int64)
        sizes = np.concatenate([np.diff(b.column("toks").offsets.to_numpy()) for b in rows]) if rows else np.zeros(0, int)
        order = np.argsort(toks, kind="stable")
        self.held = np.repeat(np.arange(len(self.rid), dtype=np.int32), sizes)[order]
        toks = toks[order]
        self.first = np.flatnonzero(np.r_[True, toks[1:] != toks[:-1]]) if len(toks) else np.zeros(0, int)
        self.toks, self.end = toks[self.first], np.r_[self.first[1:], len(toks)]
        self.place = np.zeros(len(self.rid), np.int64)  # scratch: where a row is among what a query meets

    def ranges(self, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each of toks begin and end in `held`."""
        if not len(self.toks):
            return (np.zeros(len(toks), int),) * 2
        at = np.minimum(np.searchsorted(self.toks, toks), len(self.toks) - 1)
        hit = self.toks[at] == toks
        return np.where(hit, self.first[at], 0), np.where(hit, self.end[at], 0)


def records_of(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """A row for each rid of tokens (rid, tok, name): norms of all and of names, and ids, weights and kinds of its tokens in vocab, names first."""
    w, name = F.col("w"), F.col("name")
    held = tokens.join(vocab.select("tok", "id", "w"), "tok").groupBy("rid").agg(
        F.sqrt(F.sum(w * w)).alias("full"), F.sqrt(F.sum(F.when(name, w * w).otherwise(0.0))).alias("part"), F.sort_array(F.collect_list(F.struct((~name).alias("other"), "id", "w"))).alias("all")
    )
    unit = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)).alias(c)
    return held.select("rid", unit("full"), unit("part"), F.col("all.id").alias("toks"), F.col("all.w").alias("ws"), F.size(F.filter("all", lambda t: ~t.other)).alias("names"))


def best_pairs(queries: DataFrame, index: DataFrame, kinds: list[tuple[str, str, int]], threshold: float, digits: int, cells: tuple[int, int], not_self: bool = False) -> DataFrame:
    """(q_rid, e_rid) and bs_tag and br_tag for each of kinds (norm column, tag, k): pairs that are among the k best by any.

    queries and index come from records_of(); cells is the number of groups of queries and of blocks of the index. Scores are
    rounded to `digits`, ties go to the lower e_rid; where a pair isn't among the best its score is 0 and its rank 99.
    """
    groups, blocks = cells
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select(F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int").alias("g"), upto(blocks).alias("b"), F.lit(True).alias("asks"), "rid", "full", "part", "toks", "ws", "names")
    e = index.select(upto(groups).alias("g"), F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(blocks)).cast("int").alias("b"), F.lit(False).alias("asks"), "rid", "full", "part", "toks", F.lit(None).cast("array<double>").alias("ws"), F.lit(0).alias("names"))
    met = q.unionByName(e).repartitionById(groups * blocks, (F.col("g") * blocks + F.col("b")).cast("int")).sortWithinPartitions("asks", "rid").drop("g", "b")
    out = T.StructType([T.StructField("q_rid", T.LongType()), T.StructField("e_rid", T.LongType())])
    for _, tag, _ in kinds:
        out = out.add(f"bs_{tag}", T.DoubleType()).add(f"br_{tag}", T.IntegerType())
    slack = 2 * 10.0**-digits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nearest(score: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
            """Places of the k best, best first, and their rounded scores."""
            at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k] - slack) if len(score) > k else np.arange(len(score))
            s = np.round(score[at], digits)
            at, s = at[s > threshold], s[s > threshold]
            order = np.lexsort((e[at], -s))[:k]  # rows of the index are in order of rid
            return at[order], s[order]

        def answers(index: Postings, asked: pa.RecordBatch) -> pa.RecordBatch:
            column = lambda c: asked.column(c).to_numpy()
            rids, norms, names = column("rid"), {"full": column("full"), "part": column("part")}, column("names")
            offsets = asked.column("toks").offsets.to_numpy()
            offsets = offsets - offsets[0]
            first, end = index.ranges(asked.column("toks").flatten().to_numpy())
            sizes, squares = end - first, asked.column("ws").flatten().to_numpy() ** 2
            found: list[list[np.ndarray]] = [[] for _ in out]
            for n, (rid, a, z) in enumerate(zip(rids, offsets[:-1], offsets[1:], strict=True)):
                held = np.concatenate([index.held[i:j] for i, j in zip(first[a:z].tolist(), end[a:z].tolist(), strict=True)])
                if not len(held):
                    continue
                at = np.arange(len(held))
                index.place[held] = at  # the last place of each row stands for it
                place = index.place[held]
                last = np.flatnonzero(place == at)
                e = held[last]
                if not_self:
                    last, e = last[index.rid[e] != rid], e[index.rid[e] != rid]
                weight = np.repeat(squares[a:z], sizes[a:z])
                named = int(sizes[a : a + names[n]].sum())
                best = []
                for norm, _, k in kinds:
                    upto = len(held) if norm == "full" else named
                    total = np.bincount(place[:upto], weight[:upto], len(held))[last]
                    best.append(nearest(total / (norms[norm][n] * index.norms[norm == "part"][e]), e, k))
                kept = np.unique(np.concatenate([at for at, _ in best]))
                found[0].append(np.full(len(kept), rid))
                found[1].append(index.rid[e[kept]])
                for c, (at, s) in enumerate(best):
                    score, rank = np.zeros(len(kept)), np.full(len(kept), 99, np.int32)
                    where = np.searchsorted(kept, at)  # kept is sorted
                    score[where], rank[where] = s, np.arange(1, len(at) + 1)
                    found[2 + 2 * c].append(score)
                    found[3 + 2 * c].append(rank)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(found, to_arrow_schema(out), strict=True)], names=out.names)

        rows: list[pa.RecordBatch] = []
        index = None
        for b in batches:
            asks = int(np.searchsorted(b.column("asks").to_numpy(zero_copy_only=False), True))
            if asks:
                rows.append(b.slice(0, asks).select(["rid", "full", "part", "toks"]))
            if asks < b.num_rows:
                if index is None:
                    index = Postings(rows)
                    rows = []
                yield answers(index, b.slice(asks))

    found = met.mapInArrow(run, out)
    if blocks == 1:
        return found
    for _, tag, k in kinds:  # a pair's scores are whole in its block, its ranks are not
        among = F.col(f"br_{tag}") < 99
        rank = F.row_number().over(Window.partitionBy("q_rid").orderBy(among.desc(), F.desc(f"bs_{tag}"), F.asc("e_rid")))
        found = found.withColumn("rank", F.when(among & (rank <= k), rank).otherwise(99)).withColumns({f"br_{tag}": F.col("rank"), f"bs_{tag}": F.when(F.col("rank") < 99, F.col(f"bs_{tag}")).otherwise(0.0)}).drop("rank")
    return found.where(F.least(F.lit(99), *[f"br_{tag}" for _, tag, _ in kinds]) < 99)


#: Rows of the index that are shuffled for a query, at most, so that there are tasks for all cores.
SPREAD = 6


def cells_of(spark: SparkSession, n_queries: int, n_index: int, salt_rows: int, block_rows: int) -> tuple[int, int]:
    """Groups of queries and blocks of the index: at most so many rows each, and some tasks for each core.

    More groups than salt_rows asks for are made only while the copies of the index are at most SPREAD rows a query, so what is
    shuffled follows the rows, however many cores there are.
    """
    blocks = max(1, -(-n_index // block_rows))
    tasks = -(-4 * spark.sparkContext.defaultParallelism // blocks)
    return max(1, -(-n_queries // salt_rows), min(tasks, SPREAD * n_queries // max(n_index, 1))), blocks


def numbered(vocab: DataFrame) -> DataFrame:
    """vocab with an id for each token, kept, so that both sides of a join read the same."""
    return settled(vocab.withColumn("id", F.monotonically_increasing_id()))


def candidates(tokens: DataFrame | Callable[[], DataFrame], entities: DataFrame, queries: DataFrame, k_full: int = 20, k_name: int = 10, max_df: int = 3000, threshold: float = 0.01, digits: int = 9, salt_rows: int = 250_000, block_rows: int = 500_000) -> DataFrame:
    """Candidates of queries among entities (rid each) from (rid, tok, name) tokens: by all of them, and by those of names.

    Names are a part of the tokens, with the same frequencies, so one join serves both scores; scores that
    a pair lacks among the best are 0, ranks 99. A column `indexed` of tokens (whether a record is an entity; else it is a query) spares
    the joins that tell them apart. tokens may be a function that settles them: then they are removed before records are dealt.
    """
    def sides() -> tuple[DataFrame, DataFrame]:
        found = tokens() if callable(tokens) else tokens
        if "indexed" in found.columns:
            own, asking = found.where("indexed").drop("indexed"), found.where("not indexed").drop("indexed")
        else:
            own, asking = (found.join(r.select("rid"), "rid", "left_semi") for r in (entities, queries))
        vocab = numbered(vocabulary(own, count_of(entities), max_df))
        return records_of(own, vocab), records_of(asking, vocab)

    # records are kept, so that the shuffled tokens are given back before records are dealt
    index, asked = settled_alone(sides)
    cells = cells_of(entities.sparkSession, queries.count(), entities.count(), salt_rows, block_rows)
    return best_pairs(asked, index, [("full", "f", k_full), ("part", "n", k_name)], threshold, digits, cells)


def neighbours(tokens: DataFrame, pool: DataFrame, k: int = 5, max_df: int = 3000, threshold: float = 0.01, digits: int = 9, salt_rows: int = 250_000, block_rows: int = 500_000) -> DataFrame:
    """(q_rid, r_rid, s, r_rank): the k records of pool most like each, itself excluded."""
    own = tokens.join(pool.select("rid"), "rid", "left_semi").withColumn("name", F.lit(True))
    x = settled(records_of(own, numbered(vocabulary(own, count_of(pool), max_df))))
    n = pool.count()
    found = best_pairs(x, x, [("full", "nb", k)], threshold, digits, cells_of(tokens.sparkSession, n, n, salt_rows, block_rows), not_self=True)
    return found.select("q_rid", F.col("e_rid").alias("r_rid"), F.col("bs_nb").alias("s"), F.col("br_nb").alias("r_rank"))


VIEWS = ("name", "addr", "num")


def pair_cells(spark: SparkSession, n_queries: int, n_index: int, block_rows: int) -> tuple[int, int]:
    """Groups of queries and blocks of the index for pairs that are known: so dealt that few copies of records are needed."""
    tasks = 4 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_index // block_rows), min(tasks, round((tasks * n_index / max(n_queries, 1)) ** 0.5)))
    return max(1, -(-tasks // blocks)), blocks


def met_pairs(pairs: DataFrame, records: DataFrame, cells: tuple[int, int], columns: list[str], sums: bool = False) -> DataFrame:
    """pairs (q_rid, e_rid, ...) of records with the record columns of both sides, _q and _e; with sums, {view}_ww and {view}_w of the
    tokens that both hold and {q,e}_{view}_{s,norm,n} of what each holds.

    A query's pairs go as a list to the task that has a block of the entities, as in best_pairs(), so pairs aren't shuffled with what
    belongs to records. A query or entity that records lack has nulls. For sums, records has lists of a record's tokens: ids, in order (toks), views
    (places in VIEWS) and weights (ws).
    """
    groups, blocks = cells
    lists = {"toks": "array<long>", "views": "array<int>", "ws": "array<double>"} if sums else {}
    held = [F.coalesce(c, F.array().cast(t)).alias(c) for c, t in lists.items()] + [F.col(c) for c in columns]
    group, block = F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int"), lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(blocks)).cast("int")
    own = F.struct("e_rid", *[c for c in pairs.columns if c not in ("q_rid", "e_rid")])
    asked = pairs.select(F.col("q_rid").alias("rid"), own.alias("pair"), block("e_rid").alias("b")).groupBy("rid", "b").agg(F.collect_list("pair").alias("pairs"))
    kind = asked.schema["pairs"].dataType
    q = asked.join(records, "rid", "left").select(group.alias("g"), "b", F.lit(True).alias("asks"), "rid", *held, "pairs")
    wanted = records.join(pairs.select(F.col("e_rid").alias("rid")), "rid", "left_semi")
    e = wanted.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), block("rid").alias("b"), F.lit(False).alias("asks"), "rid", *held, F.array().cast(kind).alias("pairs"))
    met = q.unionByName(e).repartitionById(groups * blocks, (F.col("g") * blocks + F.col("b")).cast("int")).sortWithinPartitions("asks", "rid").drop("g", "b")
    out = T.StructType([T.StructField("q_rid", T.LongType()), *kind.elementType.fields])
    for c in columns:
        out = out.add(f"{c}_q", records.schema[c].dataType).add(f"{c}_e", records.schema[c].dataType)
    if sums:
        for n in [f"{v}_{f}" for v in VIEWS for f in ("ww", "w")] + [f"{c}_{v}_{f}" for c in "qe" for v in VIEWS for f in ("s", "norm", "n")]:
            out = out.add(n, T.DoubleType())
    width, shape = len(VIEWS), to_arrow_schema(out)

    def tokens_of(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Where the tokens of each row begin, and their ids, views and weights; sums of each row and view."""
        sizes = np.concatenate([np.diff(b.column("toks").offsets.to_numpy()) for b in rows])
        toks, views, ws = (np.concatenate([b.column(c).flatten().to_numpy() for b in rows]) for c in ("toks", "views", "ws"))
        at, n = np.repeat(np.arange(len(sizes)), sizes) * width + views, len(sizes) * width
        own = np.stack([np.bincount(at, ws, n), np.sqrt(np.bincount(at, ws * ws, n)), np.bincount(at, minlength=n)], 1).reshape(len(sizes), 3 * width)
        return np.r_[0, np.cumsum(sizes)], [toks, views, ws], own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(asked: pa.RecordBatch, q: np.ndarray, e: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
            begins, (toks, views, ws), own = tokens_of([asked])
            known = np.searchsorted(vocab, toks)
            known = np.where(vocab[np.minimum(known, len(vocab) - 1)] == toks, known, -1) if len(vocab) else np.full(len(toks), -1)
            key = np.repeat(np.arange(asked.num_rows), np.diff(begins)) * (len(vocab) + 1) + known + 1  # in order, but for tokens that no entity holds
            order = np.argsort(key, kind="stable")
            key, views, ws = key[order], views[order], ws[order]
            sizes = np.where(there, starts[e + 1] - starts[e], 0) if len(rids) else np.zeros(len(e), int)
            pair = np.repeat(np.arange(len(q)), sizes)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[e] if len(rids) else sizes, sizes)
            want = q[pair] * (len(vocab) + 1) + index[place] + 1
            at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
            both = np.flatnonzero(key[at] == want) if len(key) else np.zeros(0, int)
            cell, w = pair[both] * width + views[at[both]], ws[at[both]]
            found = [np.bincount(cell, x, len(q) * width).reshape(-1, width) for x in (w * w, w)]
            found = [*[x[:, v] for v in range(width) for x in found], *own[q].T]
            return found + ([np.where(there, c, 0.0) for c in of_index[e].T] if len(rids) else [np.zeros(len(q))] * (3 * width))

        def answers(asked: pa.RecordBatch) -> pa.RecordBatch:
            q = np.repeat(np.arange(asked.num_rows), np.diff(asked.column("pairs").offsets.to_numpy()))
            pairs = asked.column("pairs").flatten()
            e_rid = pairs.field("e_rid").to_numpy()
            e = np.minimum(np.searchsorted(rids, e_rid), max(len(rids) - 1, 0))
            there = rids[e] == e_rid if len(rids) else np.zeros(len(e_rid), bool)
            made = [pa.array(asked.column("rid").to_numpy()[q]), *pairs.flatten()]
            of = pa.array(e, mask=~there)
            for c in columns:
                made += [asked.column(c).take(pa.array(q)), texts[c].take(of) if len(rids) else pa.nulls(len(q), texts[c].type)]
            made += shared(asked, q, e, there) if sums else []
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) and c.type == f.type else pa.array(c, f.type) if isinstance(c, np.ndarray) else c.cast(f.type) for c, f in zip(made, shape, strict=True)], names=out.names)

        rows: list[pa.RecordBatch] = []
        rids = None
        for b in batches:
            asks = int(np.searchsorted(b.column("asks").to_numpy(zero_copy_only=False), True))
            if asks:
                rows.append(b.slice(0, asks).select(["rid", *lists, *columns]))
            if asks < b.num_rows and rids is None:
                rids = np.concatenate([r.column("rid").to_numpy() for r in rows]) if rows else np.zeros(0, np.int64)
                texts = {c: pa.concat_arrays([r.column(c) for r in rows]) if rows else pa.nulls(0, b.column(c).type) for c in columns}
                if sums:
                    starts, (ids, _, _), of_index = tokens_of(rows) if rows else (np.zeros(1, int), [np.zeros(0, np.int64)] * 3, np.zeros((0, 3 * width)))
                    vocab, index = np.unique(ids, return_inverse=True)
                rows = []
            for at in range(asks, b.num_rows, 200):  # a query has some 30 pairs of some 20 tokens each
                yield answers(b.slice(at, min(200, b.num_rows - at)))

    return met.mapInArrow(run, out)


def view_dots(pairs: DataFrame, tokens: DataFrame, entities: DataFrame, records: DataFrame | None = None, columns: tuple[str, ...] | list[str] = (), block_rows: int = 200_000) -> DataFrame:
    """pairs (q_rid, e_rid, ...) with cos_, covq_, cove_, nq_ and ne_ of every view, and with columns of records (rid, ...) of both sides, _q and _e.

    tokens has (rid, tok, view); weights come from entities, without a cut by frequency. Shares are rounded to
    nine digits, so that ties don't depend on the order of sums.
    """
    own = tokens.join(entities.select("rid"), "rid", "left_semi")
    vocab = numbered(vocabulary(own, count_of(entities), None))
    view = F.array_position(F.array(*map(F.lit, VIEWS)), F.col("view")).cast("int") - 1
    held = tokens.join(vocab.select("tok", "id", "w"), "tok").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("id", view.alias("view"), "w"))).alias("all"))
    held = held.select("rid", F.col("all.id").alias("toks"), F.col("all.view").alias("views"), F.col("all.w").alias("ws"))
    if records is not None:
        held = records.select("rid", *columns).join(held, "rid", "left")
    cells = pair_cells(tokens.sparkSession, pairs.select("q_rid").distinct().count(), entities.count(), block_rows)
    found = met_pairs(pairs, held, cells, list(columns), sums=True)
    out = [F.col(f"{c}_{side}") for c in columns for side in "qe"]
    for v in VIEWS:
        out += [
            F.round(F.col(f"{v}_ww") / F.greatest(F.col(f"q_{v}_norm") * F.col(f"e_{v}_norm"), F.lit(1e-6)), 9).alias(f"cos_{v}"),
            F.round(F.col(f"{v}_w") / F.greatest(F.col(f"q_{v}_s"), F.lit(1e-6)), 9).alias(f"covq_{v}"),
            F.round(F.col(f"{v}_w") / F.greatest(F.col(f"e_{v}_s"), F.lit(1e-6)), 9).alias(f"cove_{v}"),
            F.col(f"q_{v}_n").cast("double").alias(f"nq_{v}"),
            F.col(f"e_{v}_n").cast("double").alias(f"ne_{v}"),
        ]
    return found.select(*pairs.columns, *out)
