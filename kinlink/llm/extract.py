"""Main text of HTML pages: what the markup tells, and a suffix array of each host for the rest.

Blocks inside an article or main element are the article's, except in parts that the markup sets apart
(menus, headers, footers, sidebars, notices, adverts, forms, comments, hidden parts). Where the markup
leaves open what a block is - on a page without such an element, and in parts whose class names sites and
authors use alike - the text that the host repeats is boilerplate.

All blocks of all pages go through the array: for each host it has the token streams of the blocks outside of articles, and as
a text of its own those of articles, so that a copied article takes nothing from an undecided page. What the array finds
repeated is taken out, and a check follows that puts back what the markup says is the article's (n_repeated tokens of a page).
The suffixes of a host's texts are sorted, cut after `depth` tokens. Equal suffixes are one entry of the array with the pages that have
it (`repeats` of them at most, as more change nothing). The array is dealt by anchors (below), so that equal runs are in one part and runs that
follow each other travel as one stretch of tokens; runs that `repeats` pages of a task share are settled in that task and send
`repeats` of their suffixes for the pages of others, so a hot run is a few rows a task. One pass over neighbours and their common
prefixes yields the intervals of suffixes that agree in `run` tokens or more, with their pages and the
longest prefix that `repeats` pages share. Tokens that a substring of
`run` tokens or more on `repeats` pages covers are taken out; unique runs stay. A longer repeated substring
covers just what its parts of `run` tokens cover, so the cut at `depth` changes no result.

Suffixes are shuffled only where they may be repeated. Of the hashes of parts of a run, two tokens shorter at most, the least is the run's anchor, so equal
runs have equal anchors; anchors are counted first, packed, and a bitmap of a fixed 8 MB has those of `repeats` pages. It lets
others through too, but misses none.

Pages with the same streams count as one page. Text that is clearly an article's is never taken out,
however often a host repeats it: articles may be copies.

Edge cases: a null page is an empty one and gives an empty text; a null url has an empty host; repeated
rows give repeated results; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import _marked, map_rows, schema, shuffles_back, staged
from kinlink.llm.htmltext import blocks

#: text holds the whole result unless parts are doubtful; then parts has all candidates in page order and
#: places the token of the stream that each begins at (-1: it stays in any case).
PARSED = schema(
    row=T.LongType(), page_id=T.LongType(), url=T.StringType(), host=T.StringType(), text=T.StringType(),
    parts=T.ArrayType(T.StringType()), places=T.ArrayType(T.IntegerType()), stream=T.StringType(), doubtful=T.BooleanType(),
)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def parse(page: str | None) -> tuple[list[str], list[int], list[str]]:
    """Blocks that are or may be the page's text, the token of the stream that each begins at (-1: it is), and the stream's blocks."""
    found = blocks(page)
    article = any(b.main and not b.apart for b in found)
    parts, places, stream, at = [], [], [], 0
    for b in found:
        may = not b.apart and (b.main or not article)
        sure = may and b.main and not b.doubtful
        if may:
            parts.append(b.text)
            places.append(-1 if sure else at)
        if not sure:
            stream.append(b.text)
            at += b.text.count(" ") + 1
    return parts, places, stream


SLICE = 1 << 20  # bytes that are hashed at once


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number from 0 to n, modulo 2 to the 64, and those of its inverse."""
    base = 0x9E3779B97F4A7C15
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))


def _words(data: np.ndarray) -> np.ndarray:
    """Hashes of 32 bits of the words of data, UTF-8 with one space or line break between words."""
    ends = np.r_[np.flatnonzero((data == 32) | (data == 10)), len(data)]
    starts = np.r_[0, ends[:-1] + 1]
    up, down = _powers(max(SLICE, len(data)))
    # sums of a word's bytes times powers of the place, so that a word is a difference of two
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(0x9E37)) * up[: len(data)])]
    h = (total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(32)).astype(np.uint32)


def hashed(text: str) -> np.ndarray:
    """The tokens of a text as hashes of 32 bits; none of an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    out, at = [], 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):  # a slice ends where a word ends
            cut = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end))
            end = cut if cut > at else min([k for k in (raw.find(b" ", end), raw.find(b"\n", end)) if k >= 0], default=len(raw))
        out.append(_words(data[at:end]))
        at = end + 1
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def tokens(stream: list[str]) -> bytes:
    """The tokens of a stream as hashes of four bytes each, in a row."""
    return hashed("\n".join(stream)).tobytes()


@lru_cache(1 << 12)
def _seed(name: str) -> int:
    return xxhash.xxh64_intdigest(name)


def article(text: str | None, parts: list[str] | None, places: list[int] | None) -> list[str]:
    """The blocks of a page that are the article's."""
    return text.split("\n") if text else [p for p, at in zip(parts or (), places or (), strict=True) if at < 0]


ARRAY = ("host", "stream", "text", "parts", "places")
BUCKETS, SLOTS = 1 << 8, 1 << 18  # of anchors, and of a bucket in the bitmap


class Texts:
    """What the pages of a batch add to the array, their streams and their articles: all tokens in a row, where each text begins
    and ends, the number of its name (the host's streams or articles), its page in the batch, and whether it is an article."""

    def __init__(self, batch: dict[str, list]) -> None:
        found = []
        for n, (host, stream, text, parts, places) in enumerate(zip(*(batch[c] for c in ARRAY), strict=True)):
            if stream:
                found.append((stream, _seed(host), n, False))
            own = text or "\n".join(article(text, parts, places))
            if own:
                found.append((own, _seed(f"{host}/article"), n, True))
        self.tokens = hashed("\n".join([f[0] for f in found]))
        sizes = np.array([f[0].count(" ") + f[0].count("\n") + 1 for f in found], np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.name, self.page, self.article = (np.array([f[k] for f in found], t) for k, t in ((1, np.uint64), (2, np.int64), (3, bool)))

    def runs(self, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where runs of tokens begin, the text of each, and its anchor."""
        of = np.repeat(np.arange(len(self.end)), self.end - self.start)
        at = np.flatnonzero(np.arange(len(of)) + run <= self.end[of]) if len(of) else of
        return at, of[at], _anchors(self.name[of], self.tokens, run)[at] if len(at) else np.zeros(0, np.uint32)


def _anchors(seeds: np.ndarray, found: np.ndarray, run: int) -> np.ndarray:
    t = found.astype(np.uint64)
    if len(t) < run:
        return np.zeros(0, np.uint32)
    size = max((run + 1) // 2, run - 2)  # longer ones are more, but fewer of them are common
    h = seeds[: len(t) - size + 1].copy()
    for k in range(size):
        h ^= t[k : len(t) - size + 1 + k]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    hashes = (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    least = hashes[: len(t) - run + 1].copy()
    for k in range(1, run - size + 1):
        np.minimum(least, hashes[k : k + len(least)], out=least)
    return least


def anchors(name: str, data: bytes, run: int) -> np.ndarray:
    """A number of 32 bits for each run of tokens, equal for equal runs of one name and the same for many neighbouring runs."""
    t = np.frombuffer(data, np.uint32)
    return _anchors(np.full(len(t), _seed(name), np.uint64), t, run)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte place by byte place."""
    return pa.compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(data, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).reshape(n)


def often(parsed: DataFrame, run: int, repeats: int, flush: int = 4_000_000) -> np.ndarray:
    """A bitmap of the anchors that `repeats` pages have; copies of a page count here."""

    def packed(batches):
        held: list[np.ndarray] = []

        def rows():
            found, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint32), return_counts=True)
            held.clear()
            n = np.minimum(n, repeats).astype(np.uint8)
            first = np.searchsorted(found, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(24))
            full = np.flatnonzero(np.diff(first))
            own = [slice(first[b], first[b + 1]) for b in full]
            return {"bucket": full.tolist(), "n": [s.stop - s.start for s in own], "keys": [_packed(np.diff(found[s], prepend=np.uint32(0))) for s in own], "counts": [_packed(n[s]) for s in own]}

        for b in batches:
            texts = Texts(b)
            _, of, found = texts.runs(run)
            pairs = np.unique(of.astype(np.uint64) << np.uint64(32) | found)  # an anchor once a text
            held.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            if sum(map(len, held)) > flush:
                yield rows()
        yield rows()

    def merged(batches):
        held: dict[int, list] = {}
        for b in batches:
            for bucket, n, keys, counts in zip(b["bucket"], b["n"], b["keys"], b["counts"], strict=True):
                held.setdefault(bucket, []).append((np.cumsum(_unpacked(keys, np.uint32, n), dtype=np.uint32), _unpacked(counts, np.uint8, n)))
        for bucket, own in held.items():
            keys, n = np.concatenate([k for k, _ in own]), np.concatenate([c for _, c in own])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            bits = np.zeros(SLOTS, bool)
            bits[(keys[first][np.add.reduceat(n, first) >= repeats] >> np.uint32(6)) % SLOTS] = True
            yield {"bucket": [bucket], "bits": [np.packbits(bits).tobytes()]}

    counted = map_rows(parsed.select(*ARRAY), packed, schema(bucket=T.IntegerType(), n=T.IntegerType(), keys=T.BinaryType(), counts=T.BinaryType())).repartition("bucket")
    out = np.zeros((BUCKETS, SLOTS // 8), np.uint8)
    for r in map_rows(counted, merged, schema(bucket=T.IntegerType(), bits=T.BinaryType())).collect():
        out[r.bucket] = np.frombuffer(r.bits, np.uint8)
    return out.reshape(-1)


def unique_runs(parts: list[str], places: list[int], repeated: list[int], run: int) -> str:
    """The parts without what repeated substrings of `run` tokens at the given places of the stream cover.

    A block goes if it is covered whole; of others only stretches of `run` tokens or more go, so a repeated
    neighbour takes no words from a block's end.
    """
    covered = set()
    for p in repeated:
        covered.update(range(p, p + run))
    out = []
    for block, at in zip(parts, places, strict=True):
        if at < 0:
            out.append(block)
            continue
        kept: list[str] = []
        stretch: list[str] = []
        whole = True
        for n, token in enumerate(block.split(" "), at):
            if n in covered:
                stretch.append(token)
            else:
                whole = False
                kept += stretch if len(stretch) < run else []
                stretch = []
                kept.append(token)
        if not whole and len(stretch) < run:
            kept += stretch
        if kept:
            out.append(" ".join(kept))
    return "\n".join(out)


class Neighbours:
    """A pass over sorted suffixes of one range: intervals of common prefixes of `run` tokens or more."""

    def __init__(self, run: int, repeats: int) -> None:
        self.run, self.repeats = run, repeats
        self.out: list[tuple[str, bytes, int, list[int]]] = []
        self.host: str | None = None
        self.last = b""
        self.stack: list[tuple[int, set[int]]] = []  # depth in tokens and pages of the intervals that are open
        self.longest = 0
        self.first = True

    def _few(self, pages: set[int]) -> set[int]:
        return pages if len(pages) <= self.repeats else set(sorted(pages)[: self.repeats])

    def _close(self, depth: int) -> None:
        """Ends the intervals deeper than depth; their pages go to the interval around them."""
        pages: set[int] = set()
        while self.stack and self.stack[-1][0] > depth:
            d, own = self.stack.pop()
            pages = self._few(own | pages)
            if len(pages) >= self.repeats:
                self.longest = max(self.longest, d)
        if pages:
            if self.stack and self.stack[-1][0] == depth:
                pages = self._few(self.stack.pop()[1] | pages)
            self.stack.append((depth, pages))

    def end(self, border: bool) -> None:
        """Ends what begins with the last suffix's first tokens; at a range's border also if pages are too few."""
        if self.host is None:
            return
        self._close(self.run)
        pages = self.stack.pop()[1]
        self.stack.clear()
        if border or self.first or len(pages) >= self.repeats:
            self.out.append((self.host, self.last[: 4 * self.run], max(self.longest, self.run), sorted(pages)))
        self.first, self.longest = False, 0

    def add(self, host: str, suffix: bytes, pages: list[int]) -> None:
        same = 0
        if host == self.host:
            a, b = (np.frombuffer(x[: min(len(suffix), len(self.last)) // 4 * 4], np.uint32) for x in (suffix, self.last))
            differ = np.flatnonzero(a != b)
            same = int(differ[0]) if len(differ) else len(a)
        if same < self.run:
            self.end(border=False)
        else:
            self._close(same)
        self.host, self.last = host, suffix
        size = len(suffix) // 4
        if self.stack and self.stack[-1][0] == size:
            self.stack[-1] = (size, self._few(self.stack[-1][1] | set(pages)))
        else:
            self.stack.append((size, self._few(set(pages))))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each of starts on, as many as sizes says."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


#: What a task sends to one part of the array: stretches of runs that follow each other (their page's row, place of the first run, ~place in
#: an article, number of name and hash of the text, runs and tokens), their tokens, and runs that are settled.
STRETCHES = {"row": np.int64, "place": np.int32, "name": np.uint64, "page": np.uint64, "runs": np.uint32, "size": np.uint32}
SETTLED = {"told_row": np.int64, "told_place": np.int32}
DEALT = schema(part=T.IntegerType(), n=T.IntegerType(), n_tokens=T.IntegerType(), n_told=T.IntegerType(), tokens=T.BinaryType(), **{c: T.BinaryType() for c in (*STRETCHES, *SETTLED)})
REPEATED = schema(row=T.LongType(), places=T.ArrayType(T.IntegerType()))


def dealt(parsed: DataFrame, bitmap, parts: int, run: int, repeats: int, depth: int, flush: int = 500_000) -> DataFrame:
    """The suffixes that may be repeated, each with its run's place, by parts of the array: equal runs are in one part.

    Runs that `repeats` pages of a task share are settled there: `repeats` of their suffixes go to the array, for the pages of other tasks, and
    of the others just the places.
    """

    def rows(held: list[dict[str, np.ndarray]]):
        out = {c: [] for c in DEALT.names}
        base = np.cumsum([0] + [len(h["tokens"]) for h in held])[:-1]
        at, end = (np.concatenate([h[c] + b for h, b in zip(held, base, strict=True)] or [np.zeros(0, np.int64)]) for c in ("at", "end"))
        if not len(at):
            return out
        t, anchor, row, place, name, page = (np.concatenate([h[c] for h in held]) for c in ("tokens", "anchor", "row", "place", "name", "page"))
        held.clear()
        head = name.copy()
        for k in range(run):
            head = (head ^ t[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            head ^= head >> np.uint64(32)
        order = np.lexsort((page, head))
        first = np.r_[True, head[order][1:] != head[order][:-1]]
        new = first | np.r_[True, page[order][1:] != page[order][:-1]]  # the first run of a page
        group, nth = np.cumsum(first) - 1, np.cumsum(new)
        known = (np.bincount(group, new) >= repeats)[group]
        told = np.zeros(len(at), bool)
        told[order] = known & ~(new & (nth - nth[np.flatnonzero(first)][group] < repeats))
        part = ((anchor * np.uint32(0x9E3779B1)).astype(np.uint64) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        part[told] = row[told] % parts  # by pages: a hot run is no part's burden
        order = np.lexsort((at, part, told))
        n = len(at) - int(told.sum())
        asked, settled = order[:n], order[n:]
        at, own, last = at[asked], part[asked], end[asked]
        begins = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (own[1:] != own[:-1]) | (last[1:] != last[:-1])][:n])
        stops = np.r_[begins[1:], n][: len(begins)] - 1
        size = at[stops] - at[begins] + np.minimum(depth, last[stops] - at[stops])
        stretch = {"row": row[asked][begins], "place": place[asked][begins], "name": name[asked][begins], "page": page[asked][begins], "runs": stops - begins + 1, "size": size}
        for p in np.unique(part):
            a, z = np.searchsorted(own[begins], [p, p + 1])
            c, d = np.searchsorted(part[settled], [p, p + 1])
            body = t[_ranges(at[begins[a:z]], size[a:z])]
            told_row = row[settled[c:d]]
            for column, value in (("part", int(p)), ("n", z - a), ("n_tokens", len(body)), ("n_told", d - c), ("tokens", _packed(body)), ("told_row", _packed(np.diff(told_row, prepend=np.int64(0)))), ("told_place", _packed(place[settled[c:d]]))):
                out[column].append(value)
            for column, kind in STRETCHES.items():
                value = stretch[column][a:z].astype(kind)
                out[column].append(_packed(np.diff(value, prepend=np.int64(0)) if column == "row" else value))
        return out

    def deal(batches):
        held: list[dict[str, np.ndarray]] = []
        bits = np.frombuffer(pa.decompress(bitmap.value, BUCKETS * SLOTS // 8, "zstd"), np.uint8)
        for b in batches:
            texts = Texts(b)
            at, of, anchor = texts.runs(run)
            slot = anchor >> np.uint32(6)
            may = np.flatnonzero(bits[slot >> np.uint32(3)] >> (np.uint8(7) - (slot & np.uint32(7)).astype(np.uint8)) & np.uint8(1))
            at, of, anchor = at[may], of[may], anchor[may]
            pages = np.array([xxhash.xxh3_64_intdigest(texts.tokens[i:j].tobytes()) for i, j in zip(texts.start, texts.end, strict=True)], np.uint64)
            place = (at - texts.start[of]).astype(np.int32)
            held.append({
                "tokens": texts.tokens, "at": at, "end": texts.end[of], "anchor": anchor, "row": np.array(b["row"], np.int64)[texts.page[of]],
                "place": np.where(texts.article[of], ~place, place), "name": texts.name[of], "page": pages[of],
            })
            if sum(len(h["at"]) for h in held) > flush or sum(len(h["tokens"]) for h in held) > 8 * flush:
                yield rows(held)
                held.clear()
        yield rows(held)

    return map_rows(parsed.select("row", *ARRAY), deal, DEALT)


def repeated_places(parsed: DataFrame, bitmap, run: int, repeats: int, depth: int) -> DataFrame:
    """(row, places): where runs begin that `repeats` pages or more of a host have; ~place in an article."""

    def places_of(row: np.ndarray, place: np.ndarray) -> dict[str, list]:
        order = np.lexsort((place, row))
        row, place = row[order], place[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]][: len(row)])
        return {"row": row[first].tolist(), "places": [x.tolist() for x in np.split(place, first[1:])] if len(row) else []}

    def array(own: list[dict[str, np.ndarray]], stream: list[np.ndarray]) -> dict[str, list]:
        """Sorts the suffixes of a part and looks for repeats among neighbours."""
        row, place, name, page, runs, size = (np.concatenate([o[c] for o in own]) for c in STRETCHES)
        t = np.r_[np.concatenate(stream), np.zeros(depth, np.uint32)]
        runs, size = runs.astype(np.int64), size.astype(np.int64)
        of, nth = np.repeat(np.arange(len(runs)), runs), _ranges(np.zeros(len(runs), np.int64), runs)
        at, left = (np.cumsum(size) - size)[of] + nth, np.minimum(depth, size[of] - nth)
        head = name[of]
        for k in range(run):
            head = (head ^ t[at + k]) * np.uint64(0x9E3779B97F4A7C15)
            head ^= head >> np.uint64(32)
        _, group, many = np.unique(head, return_inverse=True, return_counts=True)
        some = np.flatnonzero(many[group] >= repeats)  # others have too few runs
        of, nth, at, left = of[some], nth[some], at[some], left[some]
        suffix = np.where(np.arange(depth) < left[:, None], t[at[:, None] + np.arange(depth)], np.uint32(0))
        order = np.lexsort((page[of], left, *suffix.T[::-1], name[of]))
        of, nth, left, suffix = of[order], nth[order], left[order], suffix[order]
        names, pages = name[of], page[of]
        same = np.r_[False, (suffix[1:] == suffix[:-1]).all(1) & (left[1:] == left[:-1]) & (names[1:] == names[:-1])][: len(of)]
        heads = np.r_[False, (suffix[1:, :run] == suffix[:-1, :run]).all(1) & (names[1:] == names[:-1])][: len(of)]
        new = np.flatnonzero(~same | np.r_[True, pages[1:] != pages[:-1]][: len(of)])  # a suffix has a page once
        entry = new[~same[new]]
        upto = np.r_[np.flatnonzero(~same[new])[1:], len(new)] if len(new) else entry
        walk, found = Neighbours(run, repeats), set()
        ids, data, sizes, a = pages[new].tolist(), suffix[entry].tobytes(), left[entry].tolist(), 0
        for n, (host, z) in enumerate(zip(names[entry].tolist(), upto.tolist(), strict=True)):
            walk.add(host, data[4 * depth * n : 4 * (depth * n + sizes[n])], ids[a : min(z, a + repeats)])
            a = z
        walk.end(border=False)
        found = {(host, head) for host, head, _, own in walk.out if len(own) >= repeats}
        first = np.flatnonzero(~heads)
        hit = np.array([(h, s.tobytes()) in found for h, s in zip(names[first].tolist(), suffix[first, :run], strict=True)], bool)
        hit = np.repeat(hit, np.diff(np.r_[first, len(of)])) if len(of) else np.zeros(0, bool)
        of, nth = of[hit], nth[hit].astype(np.int32)
        return places_of(row[of], np.where(place[of] < 0, place[of] - nth, place[of] + nth))

    def places(batches):
        held: dict[int, tuple[list, list]] = {}
        for b in batches:
            for n, part in enumerate(b["part"]):
                own = {c: _unpacked(b[c][n], kind, b["n"][n]) for c, kind in STRETCHES.items()}
                own["row"] = np.cumsum(own["row"])
                for found, value in zip(held.setdefault(part, ([], [])), (own, _unpacked(b["tokens"][n], np.uint32, b["n_tokens"][n])), strict=True):
                    found.append(value)
                told = [_unpacked(b[c][n], kind, b["n_told"][n]) for c, kind in SETTLED.items()]
                yield places_of(np.cumsum(told[0]), told[1])
        for part in list(held):
            yield array(*held.pop(part))

    spark = parsed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = dealt(parsed, bitmap, parts, run, repeats, depth).repartitionById(parts, F.col("part"))
    return map_rows(found, places, REPEATED).groupBy("row").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("repeated"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 8, repeats: int = 3, depth: int = 16) -> DataFrame:
    """page_id, url and main text of each row, whether the host's suffix array decided parts of it, and how many tokens of the article it found repeated."""
    source = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def read(batches):
        for b in batches:
            found = [parse(h) for h in b["html"]]
            open_ = [any(p >= 0 for p in places) for _, places, _ in found]
            yield {
                "row": b["row"],
                "page_id": b["page_id"],
                "url": b["url"],
                "host": [host_of(u) for u in b["url"]],
                "text": [None if o else "\n".join(parts) for o, (parts, _, _) in zip(open_, found, strict=True)],
                "parts": [parts if o else None for o, (parts, _, _) in zip(open_, found, strict=True)],
                "places": [places if o else None for o, (_, places, _) in zip(open_, found, strict=True)],
                "stream": ["\n".join(stream) for _, _, stream in found],
                "doubtful": open_,
            }

    parsed = staged(map_rows(source, read, PARSED), "pages", "zstd")
    bitmap = parsed.sparkSession.sparkContext.broadcast(pa.compress(often(parsed, run, repeats).tobytes(), "zstd", asbytes=True))
    shuffles_back(parsed.sparkSession)
    covered = staged(repeated_places(parsed, bitmap, run, repeats, depth), "repeated")
    shuffles_back(parsed.sparkSession)

    def cleaned(batches):
        """What the array leaves of the blocks, and the article's blocks whole again."""
        for b in batches:
            found = [r or [] for r in b["repeated"]]
            parts = [article(t, p, None) if p is None else p for t, p in zip(b["text"], b["parts"], strict=True)]
            places = [[-1] * len(p) if at is None else at for p, at in zip(parts, b["places"], strict=True)]
            yield {
                "page_id": b["page_id"],
                "url": b["url"],
                "text": [unique_runs(p, at, [r for r in own if r >= 0], run) for p, at, own in zip(parts, places, found, strict=True)],
                "by_array": b["doubtful"],
                "n_repeated": [len({n for r in own if r < 0 for n in range(~r, ~r + run)}) for own in found],
            }

    result = schema(page_id=T.LongType(), url=T.StringType(), text=T.StringType(), by_array=T.BooleanType(), n_repeated=T.LongType())
    marked, touched = _marked(parsed, "row", covered, 1 << 26)
    touched |= F.col("doubtful")
    decided = map_rows(marked.where(touched).select("row", "page_id", "url", "text", "parts", "places", "doubtful").join(covered, "row", "left").drop("row"), cleaned, result)
    return marked.where(~touched).select("page_id", "url", "text", F.lit(False).alias("by_array"), F.lit(0).cast("long").alias("n_repeated")).unionByName(decided)


def op10_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page, by main_text()."""
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "by_array", "n_repeated")
