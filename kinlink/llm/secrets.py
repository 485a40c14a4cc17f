"""Secret scans: strict patterns, and guess costs of the values in credential contexts.

The guess cost of a value is the least sum over all ways to cut it into dictionary words, dates,
repeats, sequences, keyboard walks and brute-force spans, in powers of ten (after the published
password-strength estimators). Every part of a run counts as a piece, not only the whole run. Words are a short list of
those that people choose, then the whole words of a public tokenizer's vocabulary in its order (the more
frequent first), if its path is given. Values next to a credential word whose cost reaches a threshold
are added to the spans of the strict rules.

Edge cases: a null text has no spans, as an empty one; repeated rows give repeated results; texts are
read whole and a value of any length is scored whole. Time is in proportion to the length of a text, but
for a logarithm in the number of its spans. Other columns aren't read.
"""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import Spans, map_batches, map_rows, schema, with_text

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex")
ORDER = {k: n for n, k in enumerate((*KINDS, "guess"))}

_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A credential word, a sign between, and a value (fixed values).
_CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_ -]?key|(?:access|private|secret|signing|encryption)[_ -]?key|client[_ -]?secret|auth(?:orization)?|bearer)"
    r"(?:[\"'`]?\x20{0,3}(?:=>|->|:=|[:=])\x20{0,3}(?:bearer\x20|basic\x20)?|\x20is\x20(?=[\"'`])|(?<=bearer)\x20)[\"'`]?([^\s\"'`<>,;]{6,})",
    re.I | re.A,
)

#: Words that people choose, the more frequent first (fixed values).
WORDS = (
    "password 123456 qwerty admin welcome letmein dragon monkey master login hello secret test user root guest changeme default example "
    "sample demo temp pass token key value name here your this that none null true false string undefined summer winter spring autumn "
    "love baby angel sunshine princess football baseball soccer hockey shadow michael jordan daniel charlie thomas robert jennifer "
    "computer internet server system service account private public access client database production staging develop company "
    "correct horse battery staple red green blue black white silver golden tiger eagle wolf lion star moon sun sky fire water earth "
    "house home work office city world friend family mother father sister brother happy lucky magic super power"
).split()
_LEET = str.maketrans("4@3105$7!", "aaeiosstl"[:9])
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
#: Dates: year first, day first, a year alone (fixed values).
_DATES = (
    re.compile(r"(?:19|20)[0-9]{2}[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12][0-9]|3[01])"),
    re.compile(r"(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)[0-9]{2}"),
    re.compile(r"(?:19|20)[0-9]{2}"),
)
#: Shortest and longest word of no list, and the longest period of a repeat.
_LETTERS, _PERIOD = (3, 14), 8


@lru_cache(maxsize=4)
def dictionary(vocabulary: str | None = None) -> tuple[dict[str, int], dict[str, int]]:
    """Rank of each word, and the longest word for each beginning of three letters.

    vocabulary is the path of a public tokenizer's file whose whole words end in </w>, in the order of their ids.
    """
    words = list(WORDS)
    if vocabulary:
        with open(vocabulary, encoding="utf-8") as file:
            ids = json.load(file)["model"]["vocab"]
        found = sorted((n, w[:-4]) for w, n in ids.items() if w.endswith("</w>"))
        words += [w for _, w in found if len(w) >= 3 and w.isascii() and w.isalpha()]
    rank: dict[str, int] = {}
    heads: dict[str, int] = {}
    for w in words:
        rank.setdefault(w, len(rank) + 1)
        heads[w[:3]] = max(heads.get(w[:3], 0), len(w))
    return rank, heads


def _neighbours() -> dict[str, frozenset[str]]:
    at = {c: (n + 0.5 * r, r) for r, row in enumerate(_ROWS) for n, c in enumerate(row)}
    return {a: frozenset(b for b, (x, y) in at.items() if b != a and abs(x - at[a][0]) <= 1 and abs(y - at[a][1]) <= 1) for a in at}


_KEYS = _neighbours()


def sequence_cost(length: int) -> float:
    return math.log10(4 * length)


def walk_cost(length: int) -> float:
    return math.log10(47) + (length - 1) * math.log10(2.3)


def repeat_cost(length: int, period: int) -> float:
    return period + math.log10(length / period + 1)


def letters_cost(length: int) -> float:
    return 4.5 + 0.15 * length


def word_cost(rank: int, leet: bool, cased: bool) -> float:
    return math.log10(rank + 1) + leet + 0.3 * cased


def date_cost(length: int) -> float:
    return math.log10(365 * 60) if length > 4 else math.log10(120)


class _Run:
    """Pieces of one kind that end at the place reached: every part of the open run that is long enough.

    Costs grow with the length by ever less, so a start that another, earlier one has once beaten stays
    beaten and is dropped; what is kept is short and the least cost is exact.
    """

    def __init__(self, kind: str, least: int, cost) -> None:
        self.kind, self.least, self.cost = kind, least, cost
        self.start, self.starts = 0, []

    def reset(self, start: int) -> None:
        self.start = start
        if self.starts:
            self.starts = [a for a in self.starts if a >= start]

    def best(self, end: int, best: list[float]) -> tuple[float, int]:
        """Least cost up to end of a piece of this kind, and its start."""
        newest = end - self.least
        if newest >= self.start:
            self.starts.append(newest)
        low, at, kept = math.inf, 0, []
        for a in self.starts:
            now = best[a] + self.cost(end - a)
            if now < low:
                low, at = now, a
                kept.append(a)
        self.starts = kept
        return low, at


def _fixed(value: str, low: str, words: tuple[dict[str, int], dict[str, int]]) -> dict[int, list[tuple[int, float, str]]]:
    """By end: start, cost and kind of the dates and words in value."""
    n, found = len(value), {}
    rank, heads = words
    plain = low.translate(_LEET)
    leets = plain != low
    for i, c in enumerate(value):
        if "0" <= c <= "9":
            for pattern in _DATES:
                m = pattern.match(value, i)
                if m:
                    found.setdefault(m.end(), []).append((i, date_cost(m.end() - i), "date"))
        for form, leet in ((low, False), (plain, True))[: 2 if leets else 1]:
            for j in range(i + 3, min(n, i + heads.get(form[i : i + 3], 0)) + 1):
                r = rank.get(form[i:j])
                if r and (not leet or form[i:j] != low[i:j]):
                    found.setdefault(j, []).append((i, word_cost(r, leet, value[i:j] != low[i:j]), "word"))
    return found


def guess_cost(value: str, piece: float = 0.3, words: tuple[dict[str, int], dict[str, int]] | None = None) -> tuple[float, list[tuple[str, int, int]]]:
    """Powers of ten of guesses for value, and its cheapest segmentation; piece is what each further piece costs."""
    low, n = value.lower() if value.isascii() else value, len(value)
    fixed = _fixed(value, low, words or dictionary())
    sequence, walk = _Run("sequence", 3, sequence_cost), _Run("walk", 3, walk_cost)
    repeats = [_Run("repeat", max(3, 2 * p), lambda length, p=p: repeat_cost(length, p)) for p in range(1, _PERIOD + 1)]
    least, most = _LETTERS
    small = large = 0  # how many small letters, and how many capitals, stand in a row before the place reached
    step = 0
    best = [0.0] + [math.inf] * n  # of all that end here
    raw = [math.inf] * (n + 1)  # of those that end in brute force
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for end in range(1, n + 1):
        i = end - 1
        c = value[i]
        if i:
            before = step
            step = ord(c) - ord(value[i - 1])
            if step not in (1, -1):
                sequence.reset(i)
            elif step != before:
                sequence.reset(i - 1)
            if low[i] not in _KEYS.get(low[i - 1], ()):
                walk.reset(i)
        raw[end] = min(raw[i] + 1.0, best[i] + 1.0 + piece)
        low_cost, now = raw[end], (i, "brute")
        for p, run in enumerate(repeats, 1):
            if i >= p and c != value[i - p]:
                run.reset(i - p + 1)
            elif end - run.start >= run.least:
                cost, at = run.best(end, best)
                if cost + piece < low_cost:
                    low_cost, now = cost + piece, (at, "repeat")
        for run in (sequence, walk):
            if end - run.start >= 3:
                cost, at = run.best(end, best)
                if cost + piece < low_cost:
                    low_cost, now = cost + piece, (at, run.kind)
        for at, cost, kind in fixed.get(end, ()):
            if best[at] + cost + piece < low_cost:
                low_cost, now = best[at] + cost + piece, (at, kind)
        upper = "A" <= c <= "Z"
        small, large = (0, large + 1) if upper else (small + 1, 0) if "a" <= c <= "z" else (0, 0)
        if large >= least:
            lengths = range(least, min(large, most) + 1)
        elif small:
            # with or without the capital before the small letters
            capital = end - small - 1 >= 0 and "A" <= value[end - small - 1] <= "Z"
            lengths = range(least, min(small, most) + 1) if not capital or small < least else [*range(least, min(small, most) + 1), *([small + 1] if small <= most else [])]
        else:
            lengths = ()
        for length in lengths:
            cost = best[end - length] + letters_cost(length) + piece
            if cost < low_cost:
                low_cost, now = cost, (end - length, "letters")
        best[end], back[end] = low_cost, now
    parts, at = [], n
    while at:
        a, kind = back[at]
        if parts and kind == "brute" == parts[-1][0]:
            parts[-1] = ("brute", a, parts[-1][2])
        else:
            parts.append((kind, a, at))
        at = a
    return best[n], parts[::-1]


def find_base(text: str) -> list[tuple[str, int, int, int, int]]:
    """Kind, start, end, and start and end of the secret value, by start and kind."""
    out = [("assign", m.start(), m.end(), m.start(2), m.end(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [("access", m.start(), m.end(), m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def find(text: str | None, least: float = 10.0, words: tuple[dict[str, int], dict[str, int]] | None = None) -> tuple[list[tuple[str, int, int, int, int]], list[tuple[str, int, int]], float]:
    """Strict spans, values added by their cost, and the highest cost of a value in a credential context."""
    if not text:
        return [], [], 0.0
    base, added, top = find_base(text), [], 0.0
    taken = Spans((s[1], s[2]) for s in base)
    for kind, _, _, a, b in base:
        if kind == "assign":
            top = max(top, guess_cost(text[a:b], words=words)[0])
    for m in _CONTEXT.finditer(text):
        a, b = m.start(1), m.start(1) + len(m[1].rstrip(".!?)]}"))
        if b - a < 6 or taken.overlap(a, b):
            continue
        cost = guess_cost(text[a:b], words=words)[0]
        top = max(top, cost)
        if cost >= least:
            added.append(("guess", a, b))
    return base, added, top


def redact(text: str | None, least: float = 10.0, mark: str = "[SECRET]", words: tuple[dict[str, int], dict[str, int]] | None = None) -> str | None:
    """text with the value of every secret replaced by mark; a null stays null."""
    base, added, _ = find(text, least, words)
    if not base and not added:
        return text
    out, done = [], 0
    for a, b in sorted([(s[3], s[4]) for s in base] + [(s[1], s[2]) for s in added]):
        if a >= done:
            out += [text[done:a], mark]
        done = max(done, b)
    return "".join([*out, text[done:]])


RESULT = schema(doc_id=T.LongType(), base=T.ArrayType(T.StringType()), added=T.ArrayType(T.StringType()), guesses_log10=T.DoubleType())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 10.0, vocabulary: str | None = None) -> DataFrame:
    """Strict and added spans (kind:start:end) of each row, and the highest guess cost among its credential values."""

    def rows(batches):
        words = dictionary(vocabulary)
        for b in batches:
            found = [find(t, least, words) for t in b["text"]]
            yield {
                "doc_id": b["doc_id"],
                "base": [[f"{k}:{s}:{e}" for k, s, e, _, _ in base] for base, _, _ in found],
                "added": [[f"{k}:{s}:{e}" for k, s, e in more] for _, more, _ in found],
                "guesses_log10": [top for _, _, top in found],
            }

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, RESULT)


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", least: float = 10.0, vocabulary: str | None = None) -> DataFrame:
    """docs with secrets replaced in text_col; all columns stay, chars_col is counted again where a text changed."""

    def run(batches):
        words = dictionary(vocabulary)
        for b in batches:
            texts = b.column(text_col).to_pylist()
            clean = [redact(t, least, words=words) for t in texts]
            yield b if clean == texts else with_text(b, text_col, clean, chars_col)

    return map_batches(docs, run, docs.schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    """Digests of all secrets of documents, by scan()."""
    import public_tokenizers

    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary=public_tokenizers.path("word_bpe_49k.json"))
    kind = lambda k: F.size(F.filter("base", lambda s: s.startswith(f"{k}:"))).cast("long").alias(f"n_{k}")
    rank = lambda s: F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.split_part(s, F.lit(":"), F.lit(1)))
    key = F.transform(F.concat("base", "added"), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("a"), rank(s).alias("k"), s.alias("s")))
    return found.select(
        "doc_id",
        *[kind(k) for k in KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(key), lambda x: x["s"]), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
        F.round("guesses_log10", 6).alias("guesses_log10"),
    )
