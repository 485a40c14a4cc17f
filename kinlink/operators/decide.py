"""Assignment of queries to entities: by threshold, or by the greatest expected F0.5 of each entity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.operators.windows import first_of


def assign(scores: DataFrame, threshold: float) -> DataFrame:
    """Each query's best entity (the lower of ties), if its probability reaches threshold."""
    return first_of(scores.select("q_rid", "e_rid", "p"), "q_rid", [F.desc("p"), F.asc("e_rid")]).where(F.col("p") >= threshold)


def odds_shift(p: Column, r: float) -> Column:
    """p after the odds are multiplied by r."""
    return r * p / (r * p + 1 - p)


#: Ends of a distribution that weigh less than this are left off: what is lost by it is under the rounding of sums near 1.
TINY = 1e-20
#: Sizes k whose expectations are made from one pair of distributions.
STEP = 512


def grow(d: np.ndarray, q: float) -> np.ndarray:
    """The distribution of a number of matches, after one more trial of probability q."""
    return np.append(d * (1 - q), 0.0) + np.append(0.0, d * q)


def trimmed(low: int, d: np.ndarray) -> tuple[int, np.ndarray]:
    """The distribution d of low, low + 1, … without its weightless ends."""
    w = np.abs(d)
    left = int(np.searchsorted(w.cumsum(), TINY))
    right = int(np.searchsorted(w[::-1].cumsum(), TINY))
    return low + left, d[left : len(d) - right]


def matches(p: np.ndarray, leaf: int = 64) -> tuple[int, np.ndarray]:
    """The distribution of the number of matches among p: the least number, and probabilities from there on."""
    if not len(p):
        return 0, np.ones(1)
    q = np.append(p, np.zeros(-len(p) % leaf)).reshape(-1, leaf) if len(p) > leaf else p[None, :]
    d = np.zeros((len(q), q.shape[1] + 1))
    d[:, 0] = 1
    for c in q.T[:, :, None]:
        more = d * (1 - c)
        more[:, 1:] += d[:, :-1] * c
        d = more
    parts = [trimmed(0, row) for row in d]
    while len(parts) > 1:
        paired = [trimmed(a + b, np.convolve(x, y)) for (a, x), (b, y) in zip(parts[::2], parts[1::2], strict=False)]
        parts = paired + parts[len(paired) * 2 :]
    return parts[0]


def sized_f(p: np.ndarray, first: int, last: int) -> np.ndarray:
    """E[F0.5] of predicting the first k, for k = first … last (from 1 on).

    F = 5 A / (A + B + 4 k), with A matches among the first k and B among the rest. S_k(x) = E[5 / (B + x)] comes from S_(k+1) in
    one step a query, as x stays the same when a query moves from the rest to the first.
    """
    starts = list(range(first, last + 1, STEP))
    ends = [min(s + STEP - 1, last) for s in starts]
    rests = [matches(p[ends[-1] :])]
    for s, e in zip(ends[-2::-1], ends[:0:-1], strict=True):
        (a, x), (b, y) = rests[-1], matches(p[s:e])
        rests.append(trimmed(a + b, np.convolve(x, y)))
    low, d = matches(p[:first])
    out = []
    for s, e in zip(starts, ends, strict=True):
        base, rest = rests.pop()
        x0, n = low + 4 * s, len(d) + 5 * (e - s)
        v = np.correlate(5 / np.arange(x0 + base, x0 + base + n + len(rest) - 1, dtype=float), rest, "valid")  # S_e of x0, x0 + 1, …
        kept = {}
        for k in range(e, s - 1, -1):
            kept[k] = v[4 * (k - s) : 4 * (k - s) + len(d) + k - s]
            v = (1 - p[k - 1]) * v[:-1] + p[k - 1] * v[1:]
        for k in range(s, e + 1):
            out.append((d * np.arange(low, low + len(d)) * kept.pop(k)).sum())
            if k < len(p):
                d = grow(d, p[k])
        low, d = trimmed(low, d)
    return np.array(out)


def expected_f(p: list[float] | np.ndarray) -> np.ndarray:
    """E[F0.5] of predicting the first k of independent matches with probabilities p, for k = 0 … len(p).

    F = 1.25 TP / (0.25 NT + k), and for k = 0 it is 1 if there is no match. Exact, by the distributions of
    the number of matches among the first k and among the rest.
    """
    p = np.asarray(p, float)
    return np.append((1 - p).prod(), sized_f(p, 1, len(p)) if len(p) else [])


def sampled_f(p: np.ndarray, samples: int, seed: int, cells: int = 4_000_000) -> np.ndarray:
    """expected_f() estimated from Bernoulli draws, at most cells of them at a time."""
    rng, k = np.random.default_rng(seed), np.arange(1, len(p) + 1)
    none, total, step = 0, np.zeros(len(p)), max(cells // max(len(p), 1), 1)
    for at in range(0, samples, step):
        hit = rng.random((min(step, samples - at), len(p))) < p
        nt = hit.sum(1, keepdims=True)
        none, total = none + (nt == 0).sum(), total + (1.25 * hit.cumsum(1) / (0.25 * nt + k)).sum(0)
    return np.append(none, total) / samples


def best_k(f: np.ndarray) -> int:
    """The smallest k > 0 of the greatest value, or 0 if predicting nothing is as good; values are equal if they are so to 12 digits."""
    f = np.round(f, 12)
    k = int(f[1:].argmax()) + 1 if len(f) > 1 else 0
    return k if k and f[k] > f[0] else 0


def best_size(p: np.ndarray, small: int = 64) -> int:
    """best_k(expected_f(p)) for any number of falling probabilities; of many, sizes that can't be the best are passed over.

    With M and m the expected matches of all and of the first k, and V the variance of those of the rest, f(k) is at most
    5 m / (M + 4 k) (1 + V / ((M + 4 k) (m + 4 k))): F is concave in A, and 1 / (x + B) <= 1 / (x + b) + (B - b)^2 / ((x + b)^2 x), with b the mean of B.
    Sizes whose bound is under an expectation that another size has are no candidates.
    """
    if len(p) <= small:
        return best_k(expected_f(p))
    k, m, v = np.arange(1, len(p) + 1), p.cumsum(), (p * (1 - p)).cumsum()
    most = m[-1] + 4 * k
    bound = 5 * m / most * (1 + np.maximum(v[-1] - v, 0) / (most * (m + 4 * k)))
    top = int(bound.argmax()) + 1
    able = np.flatnonzero(bound >= sized_f(p, top, top)[0] - 1e-9) + 1
    found = best_k(np.append((1 - p).prod(), sized_f(p, able[0], able[-1])))
    return found and int(able[0]) + found - 1


def packed(batches):
    """A row for each entity of a batch: its queries and their probabilities, eight bytes each."""
    for b in batches:
        e, q, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("e_rid", "q_rid", "p"))
        order = e.argsort(kind="stable")
        ids, start = np.unique(e[order], return_index=True)
        at = pa.py_buffer((np.append(start, len(e)) * 8).astype(np.int32))
        cut = lambda x, n=len(ids), at=at, order=order: pa.Array.from_buffers(pa.binary(), n, [None, at, pa.py_buffer(np.ascontiguousarray(x[order]))])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), cut(q), cut(p)], ["e_rid", "qs", "ps"])


def decide(scores: DataFrame, alpha: float = 1.0, floor: float = 0.02, method: str = "exact", samples: int = 256, seed: int = 0) -> DataFrame:
    """(q_rid, e_rid, p): the queries that each entity keeps.

    All queries that prefer an entity are considered. They travel packed, a row for each batch and entity, and one entity's
    are in a task's memory at a time: 16 bytes a query.
    """
    best = assign(scores, floor).select(F.col("e_rid").cast("long").alias("e_rid"), F.col("q_rid").cast("long").alias("q_rid"), F.col("p").cast("double").alias("p"))

    def kept(entity: int, qs: list[bytes], ps: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, p = np.frombuffer(b"".join(qs), np.int64), np.frombuffer(b"".join(ps), np.float64)
        sure = p**alpha
        order = np.lexsort((q, -sure))
        sure = sure[order]
        k = best_size(sure) if method == "exact" else best_k(sampled_f(sure, samples, seed))
        return q[order[:k]], np.full(k, entity, np.int64), p[order[:k]]

    def keep(batches):
        entity, qs, ps = None, [], []
        for b in batches:
            out = []
            for e, q, p in zip(*(b.column(c).to_pylist() for c in ("e_rid", "qs", "ps")), strict=True):
                if e != entity and qs:
                    out.append(kept(entity, qs, ps))
                    qs, ps = [], []
                entity = e
                qs.append(q)
                ps.append(p)
            yield from joined(out)
        yield from joined([kept(entity, qs, ps)] if qs else [])

    def joined(out):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["q_rid", "e_rid", "p"])

    dealt = best.mapInArrow(packed, "e_rid long, qs binary, ps binary").repartition("e_rid").sortWithinPartitions("e_rid")
    return dealt.mapInArrow(keep, "q_rid long, e_rid long, p double")
