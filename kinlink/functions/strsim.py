"""String similarity: indel ratio and what derives from it, Jaro-Winkler, best word match.

Scores run from 0 to 100 (Jaro-Winkler: to 1). Functions named _text define a score for one pair; those named _many give
the same for lists of pairs: the longest common subsequence is taken bit-parallel, 64 letters of the shorter text a
word, with a step of NumPy over all pairs (and, for partial ratios, all windows) at once. The columns are pandas UDFs over
these, which take each pair of a batch once. Levenshtein distance is Spark's own. Of two empty strings ratio, token sort and partial give 100 and the
token-set scores 0; an empty and another string give 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio_text(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs(a, b) / total if total else 100.0


def token_sort_text(a: str, b: str) -> float:
    return ratio_text(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_text(a: str, b: str) -> float:
    """The best ratio among the common words and each side's common and own words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    found = ratio_text(one, two)
    return max(found, ratio_text(both, one), ratio_text(both, two)) if both else found


def partial_text(a: str, b: str) -> float:
    """The best ratio of the shorter string and any window of its length in the longer, ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0

    def best(s: str, t: str) -> float:
        if s in t:
            return 100.0
        n, letters, top = len(s), set(s), 0.0
        for k in range(1 - n, len(t)):
            window = t[max(0, k) : k + n]
            edge = window[-1] if k + n <= len(t) else window[0]
            if edge in letters:  # other windows are no better than their neighbour
                top = max(top, ratio_text(s, window))
        return top

    found = best(short, long)
    return max(found, best(long, short)) if len(short) == len(long) and found < 100 else found


def partial_token_set_text(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return 100.0 if x & y else partial_text(" ".join(sorted(x)), " ".join(sorted(y)))


def jaro_winkler_text(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def best_word_text(word: str, others: str) -> float:
    """The best ratio of word with any of the words of others."""
    return max((100.0 if word == o else ratio_text(word, o) for o in others.split()), default=0.0)


def coded(*columns: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Letters of each list's texts as small numbers from 1, filled up with 0, with lengths; and how many numbers there are."""
    flat = [np.frombuffer("".join(c).encode("utf-32-le", "surrogatepass"), np.uint32) for c in columns]
    there = np.zeros(1 + max((int(x.max()) for x in flat if len(x)), default=0), bool)
    for x in flat:
        there[x] = True
    number = np.cumsum(there)
    out = []
    for c, x in zip(columns, flat, strict=True):
        sizes = np.fromiter(map(len, c), np.int64, len(c))
        codes = np.zeros((len(c), max(int(sizes.max(initial=0)), 4)), np.int64)
        codes[np.arange(codes.shape[1]) < sizes[:, None]] = number[x]
        out.append((codes, sizes))
    return out, int(number[-1]) + 1


def letter_masks(codes: np.ndarray, n: int, letters: int) -> np.ndarray:
    """By word, letter and text: at which of the n first places the letter is."""
    rows = np.arange(len(codes))
    masks = np.zeros((-(-max(n, 1) // 64), letters, len(codes)), np.uint64)
    for i in range(n):
        masks[i // 64, codes[:, i], rows] |= np.uint64(1 << i % 64)
    masks[:, 0] = 0
    return masks


def common_step(row: np.ndarray, hits) -> None:
    """One letter of the other text: row (by word) becomes the next row; bits that become 0 are counted."""
    carry = None
    for word, hit in zip(row, hits, strict=True):
        hit = word & hit
        total = word + hit
        over = total < word if len(row) > 1 else None
        if carry is not None:
            total += carry
            over |= total < carry
        np.bitwise_xor(word, hit, out=word)
        np.bitwise_or(word, total, out=word)
        carry = over


def zeros(row: np.ndarray) -> np.ndarray:
    return np.bitwise_count(~row).sum(0, dtype=np.int64)


def lcs_many(a: list[str], b: list[str]) -> np.ndarray:
    """lcs() of each pair."""
    out = np.zeros(len(a), np.int64)
    short = [min(x, y, key=len) for x, y in zip(a, b, strict=True)]
    long = [y if x is s else x for x, y, s in zip(a, b, short, strict=True)]
    sizes = np.fromiter(map(len, short), np.int64, len(a))
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] > 0]
    for words in np.unique(-(-sizes[order] // 64)):
        these = order[-(-sizes[order] // 64) == words]
        for at in range(0, len(these), 4096):
            some = these[at : at + 4096]
            ((s, n), (t, m)), letters = coded([short[i] for i in some], [long[i] for i in some])
            masks, rows = letter_masks(s, int(n.max()), letters), np.arange(len(some))
            row = np.full((len(masks), len(some)), ~np.uint64(0))
            for j in range(int(m.max())):
                common_step(row, masks[:, t[:, j], rows])
            out[some] = zeros(row)
    return out


def ratio_many(a: list[str], b: list[str]) -> np.ndarray:
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b, strict=True)), np.int64, len(a))
    return np.where(total > 0, 200.0 * lcs_many(a, b) / np.maximum(total, 1), 100.0)


def _each(f, texts: list[str]) -> list:
    """f of each text, made once for equal ones."""
    made = {t: f(t) for t in set(texts)}
    return [made[t] for t in texts]


def token_sort_many(a: list[str], b: list[str]) -> np.ndarray:
    arranged = lambda t: " ".join(sorted(t.split()))
    return ratio_many(_each(arranged, a), _each(arranged, b))


def token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    out, open_, one, two, least = np.zeros(len(a)), [], [], [], []
    words = lambda t: frozenset(t.split())
    for i, (x, y) in enumerate(zip(_each(words, a), _each(words, b), strict=True)):
        if not x or not y:
            continue
        if (x & y) and (x <= y or y <= x):
            out[i] = 100.0
            continue
        both = " ".join(sorted(x & y))
        u, v = f"{both} {' '.join(sorted(x - y))}".strip(), f"{both} {' '.join(sorted(y - x))}".strip()
        open_.append(i)
        one.append(u)
        two.append(v)
        least.append(200.0 * len(both) / (len(both) + min(len(u), len(v))))  # the common words begin both
    out[open_] = np.maximum(ratio_many(one, two), least)
    return out


def _best_windows(short: list[str], long: list[str]) -> np.ndarray:
    """The best ratio of each text of `short`, which all have one length, with any window of that length in its text of `long`."""
    ((s, n), (t, m)), letters = coded(short, long)
    size, width = int(n[0]), int(m.max())
    windows = size + width - 1
    masks = letter_masks(s, size, letters)
    hits = np.zeros((len(masks), len(short), windows + size - 1), np.uint64)  # no letters before and after the longer text
    hits[:, :, size - 1 : size - 1 + width] = masks[:, t[:, :width], np.arange(len(short))[:, None]]
    row = np.full((len(masks), len(short), windows), ~np.uint64(0))
    for j in range(size):
        common_step(row, hits[:, :, j : j + windows])
    first = np.arange(windows) - size + 1
    length = np.minimum(first + size, m[:, None]) - np.maximum(first, 0)
    return (200.0 * zeros(row) / np.maximum(size + length, 1)).max(1)


def partial_many(a: list[str], b: list[str]) -> np.ndarray:
    out = np.zeros(len(a))
    asked: dict[int, list[tuple[int, str, str]]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        s, t = (x, y) if len(x) <= len(y) else (y, x)
        if s in t and (s or not t):
            out[i] = 100.0
        elif s:
            asked.setdefault(len(s), []).extend([(i, s, t), (i, t, s)] if len(s) == len(t) else [(i, s, t)])
    for n, these in asked.items():
        these.sort(key=lambda x: len(x[2]))
        start = 0
        while start < len(these):  # what a step touches stays within a cache
            end = start + 1
            while end < len(these) and (end - start + 1) * (n + len(these[end][2])) * -(-n // 64) <= 40_000:
                end += 1
            at, short, long = zip(*these[start:end], strict=True)
            np.maximum.at(out, list(at), _best_windows(list(short), list(long)))
            start = end
    return out


def partial_token_set_many(a: list[str], b: list[str]) -> np.ndarray:
    out, open_, one, two = np.zeros(len(a)), [], [], []
    words = lambda t: (frozenset(t.split()), " ".join(sorted(set(t.split()))))
    for i, ((x, s), (y, t)) in enumerate(zip(_each(words, a), _each(words, b), strict=True)):
        if not x.isdisjoint(y):
            out[i] = 100.0
        elif x and y:
            open_.append(i)
            one.append(s)
            two.append(t)
    out[open_] = partial_many(one, two)
    return out


def _jaro_winkler(a: list[str], b: list[str], weight: float) -> np.ndarray:
    """Of texts that differ and aren't empty; those of b have 64 letters at most."""
    ((s, n), (t, m)), letters = coded(a, b)
    masks, rows = letter_masks(t, int(m.max()), letters)[0], np.arange(len(a))
    upto = lambda k: np.where(k >= 64, ~np.uint64(0), (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    used, left = np.zeros(len(a), np.uint64), np.zeros(s.shape, bool)
    for i in range(int(n.max())):
        free = masks[s[:, i], rows] & upto(np.minimum(m, i + reach + 1)) & ~upto(np.maximum(0, i - reach)) & ~used
        first = free & (~free + np.uint64(1))
        used |= first
        left[:, i] = first > 0
    right = (used[:, None] >> np.arange(t.shape[1], dtype=np.uint64).clip(max=63) & np.uint64(1)).astype(bool)
    right &= np.arange(t.shape[1]) < 64
    matched = left.sum(1)
    swaps = np.bincount(np.nonzero(left)[0], s[left] != t[right], len(a)).astype(np.int64) // 2
    each = np.maximum(matched, 1)
    jaro = np.where(matched > 0, (matched / n + matched / m + (matched - swaps) / each) / 3, 0.0)
    prefix = np.cumprod((s[:, :4] == t[:, :4]) & (s[:, :4] > 0), 1).sum(1)
    return np.where(jaro > 0.7, jaro + prefix * weight * (1 - jaro), jaro)


def jaro_winkler_many(a: list[str], b: list[str], weight: float = 0.1) -> np.ndarray:
    out = np.zeros(len(a))
    open_ = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        if x == y or len(y) > 64:
            out[i] = jaro_winkler_text(x, y, weight)
        elif x and y:
            open_.append(i)
    for at in range(0, len(open_), 4096):
        some = open_[at : at + 4096]
        out[some] = _jaro_winkler([a[i] for i in some], [b[i] for i in some], weight)
    return out


def best_word_many(word: list[str], others: list[str]) -> np.ndarray:
    split = _each(str.split, others)
    pairs = {(w, o) for w, s in zip(word, split, strict=True) for o in s if w != o}
    score = dict(zip(pairs, ratio_many([w for w, _ in pairs], [o for _, o in pairs]).tolist(), strict=True))
    return np.array([max((100.0 if w == o else score[w, o] for o in s), default=0.0) for w, s in zip(word, split, strict=True)], float)


def _pairwise(many):
    @F.pandas_udf(T.DoubleType())
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        place: dict[tuple[str, str], int] = {}
        at = [place.setdefault(p, len(place)) for p in zip(a.fillna(""), b.fillna(""), strict=True)]
        found = many([x for x, _ in place], [y for _, y in place])
        return pd.Series(found[at] if at else [], index=a.index, dtype="float64")

    return over


ratio = _pairwise(ratio_many)
token_sort_ratio = _pairwise(token_sort_many)
token_set_ratio = _pairwise(token_set_many)
partial_ratio = _pairwise(partial_many)
partial_token_set_ratio = _pairwise(partial_token_set_many)
jaro_winkler = _pairwise(jaro_winkler_many)
best_word_match = _pairwise(best_word_many)


def alt_score(alt_q: Column, core_q: Column, alt_e: Column, core_e: Column) -> Column:
    """The better token-set score of an alternative name with the other side's name, -1 without any."""
    none = (F.length(F.coalesce(alt_q, F.lit(""))) == 0) & (F.length(F.coalesce(alt_e, F.lit(""))) == 0)
    return F.when(none, F.lit(-1.0)).otherwise(F.greatest(token_set_ratio(alt_q, core_e), token_set_ratio(core_q, alt_e)))
