"""Toxicity: Levenshtein automata over a lexicon trie, and context windows that weigh the hits.

The lexicon is learned from labelled rows: words, and beginnings of words that go on in several ways,
which occur almost only in toxic documents. It is held as a trie. A word of a document is looked up by
walking the trie with the Levenshtein automaton of the word, simulated on bit vectors, so misspelled
terms are found too; two neighbouring letters in the wrong order are one edit. A word with digits or
signs between its letters is looked up with the letters that they stand for. Around each hit a window tells
quotation (quotes, reporting words) from abuse (address); quotation marks are paired over the whole line. A logistic model of the weighted hits, fitted on labelled rows that the lexicon hasn't seen,
gives the score.

At most `train_rows` labelled rows are used, those of the least hash; that bound is a parameter. So are the
size of the lexicon (`lexicon_size`, the entries in most toxic documents), the lengths of beginnings
(`start_sizes`), the least letters of a term that is looked up with errors (`Lexicon.least`) and the number
of errors. How much a quotation, a reporting word and an address change a hit's weight is set by `CONTEXT`.
All rows are scored, whole.

Edge cases: a null text is an empty one and gets the score of a text without hits; so does every text if
no labelled row is toxic. Rows with a null id are scored and never trained on. Labels that repeat an id
count once, as toxic if any says so. Repeated rows get repeated results.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import map_rows, schema, staged

WORD = re.compile(r"[^\W\d_]+")
#: A word with digits or signs between its letters, and the letters that they stand for (fixed values).
DISGUISED = re.compile(r"(?<![^\W_])[^\W\d_]+(?:[0-9@$!*|+]{1,2}[^\W\d_]+)+(?![^\W_])")
STANDS_FOR = str.maketrans("0134578@$!|+", "oieastbasilt")
#: What a hit's weight changes by if it is quoted, near a reporting word, near an address.
CONTEXT = (-0.6, -0.3, 0.3)
#: Words that report what others said, and words that address someone (fixed values).
REPORTING = frozenset("said says called quoted quote wrote writes term word sagte schrieb genannt dit appelé écrit dijo llamó escribió palabra wort mot".split())
ADDRESS = frozenset("you your youre tu toi vous du dich dein ihr usted tú eres".split())
_MARK = re.compile(r"[\n\"“”„«»]")
#: Closing marks and the marks that they may close (fixed values); “ closes „ and opens otherwise.
_CLOSES = {"”": "“", "»": "«", "“": "„"}


class Trie:
    """Terms by letter; walk() intersects it with the Levenshtein automaton of a word."""

    def __init__(self, terms: list[str]) -> None:
        self.root: dict = {}
        for t in terms:
            node = self.root
            for c in t:
                node = node.setdefault(c, {})
            node[""] = t

    def walk(self, word: str, errors: int) -> tuple[str, int] | None:
        """The term nearest to word (then the least) within errors edits, and their number."""
        n, full = len(word), (1 << (len(word) + 1)) - 1
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        start = tuple((1 << (e + 1)) - 1 & full for e in range(errors + 1))
        none = (0,) * (errors + 1)
        best: tuple[int, str] | None = None
        stack = [(self.root, start, none, "")]  # node, state, the state a letter before, that letter
        while stack:
            node, state, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e, bits in enumerate(state):
                        if bits >> n & 1:
                            best = min(best, (e, child)) if best else (e, child)
                            break
                    continue
                hit = masks.get(c, 0)
                swapped = hit & masks.get(last, 0) >> 1  # the word has c and then the letter before
                new, below = [], 0
                for e, bits in enumerate(state):
                    now = (bits & hit) << 1
                    if e:
                        # a letter too many in the term, another letter, a letter of the word left out, two letters swapped
                        now |= state[e - 1] | state[e - 1] << 1 | below << 1 | (before[e - 1] & swapped) << 2
                    now &= full
                    new.append(now)
                    below = now
                if new[-1]:
                    stack.append((child, tuple(new), state, c))
        return (best[1], best[0]) if best else None


@dataclass
class Lexicon:
    """Whole terms and beginnings; errors edits are allowed in those terms of fuzzy (all, if None) that have least letters or more."""

    terms: list[str]
    starts: list[str]
    fuzzy: list[str] | None = None
    errors: int = 1
    least: int = 5
    kept: int = 400_000
    _memo: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        long = [t for t in (self.terms if self.fuzzy is None else self.fuzzy) if len(t) >= self.least]
        self.trie = Trie(long)
        self.exact = frozenset(self.terms)
        self.start_set = frozenset(self.starts)
        self.start_sizes = sorted({len(s) for s in self.starts})
        parts = self.errors + 1  # of so many parts of a term, one is in the word unchanged
        self.heads: dict[int, set[str]] = {}
        self.tails: dict[int, set[str]] = {}
        for t in long:
            h = len(t) // parts
            self.heads.setdefault(h, set()).add(t[:h])
            self.tails.setdefault(h, set()).add(t[-h:])
        self.letters = {"".join(sorted(t)) for t in long}  # of a term with two letters swapped neither part may be unchanged
        self.sizes = (min(map(len, long), default=0) - self.errors, max(map(len, long), default=0) + self.errors)

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "starts": self.starts, "fuzzy": self.fuzzy, "errors": self.errors, "least": self.least, "kept": self.kept}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def look(self, word: str) -> tuple[str, str] | None:
        """How word (lower case) is in the lexicon (exact, start, near), and by which entry."""
        if word in self.exact:
            return "exact", word
        for n in self.start_sizes:
            if word[:n] in self.start_set:
                return "start", word[:n]
        if self.sizes[0] <= len(word) <= self.sizes[1] and (
            self.errors > 1 or any(word[:n] in s for n, s in self.heads.items()) or any(word[-n:] in s for n, s in self.tails.items()) or "".join(sorted(word)) in self.letters
        ):
            near = self.trie.walk(word, self.errors)
            if near:
                return "near", near[0]
        return None

    def hits(self, words: set[str]) -> dict[str, tuple[str, str]]:
        memo, out = self._memo, {}
        if len(memo) > self.kept:
            memo.clear()
        for w in words:
            try:
                found = memo[w]
            except KeyError:
                found = memo[w] = self.look(w)
            if found:
                out[w] = found
        return out


def quotations(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks of one line, whatever its length, merged and in order; one pass."""
    opened: dict[str, int] = {}
    found = []
    for m in _MARK.finditer(text):
        mark, at = m[0], m.start()
        if mark == "\n":
            opened.clear()
        elif mark == '"':
            if '"' in opened:
                found.append((opened.pop('"'), at))
            else:
                opened['"'] = at
        elif _CLOSES.get(mark) in opened:
            found.append((opened.pop(_CLOSES[mark]), at))
        elif mark in "“„«":
            opened.setdefault(mark, at)
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def quoted(spans: list[tuple[int, int]], at: int) -> bool:
    """Whether place at lies in one of quotations()."""
    n = bisect_right(spans, (at,)) - 1
    return n >= 0 and at < spans[n][1]


FEATURES = ("exact", "near", "start", "quoted", "kinds", "density")


def plain_form(word: str) -> str:
    """word with the letters that its digits and signs stand for; an asterisk stays, as any letter."""
    return word.translate(STANDS_FOR)


def features(text: str | None, lexicon: Lexicon, window: int = 5) -> list[float]:
    """Weighted hits of text; all zero without any."""
    low = (text or "").lower()
    words = WORD.findall(low)
    hits = lexicon.hits(set(words)) if words else {}
    hidden = []
    for m in DISGUISED.finditer(low):
        found = lexicon.hits({plain_form(m[0])})
        if found:
            hidden.append((m.start(), ("near", next(iter(found.values()))[1])))
    if not hits and not hidden:
        return [0.0] * len(FEATURES)
    places = [(m.start(), n, hits[m[0]]) for n, m in enumerate(WORD.finditer(low)) if m[0] in hits]
    if hidden:
        starts = [m.start() for m in WORD.finditer(low)]
        places += [(at, bisect_left(starts, at), found) for at, found in hidden]
    spans = quotations(low)
    weight, in_quotes = Counter(), 0.0
    for at, n, found in places:
        near = words[max(0, n - window) : n]
        quote = quoted(spans, at)
        told, to_someone = not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint(near)
        weight[found[0]] += 1.0 + CONTEXT[0] * quote + CONTEXT[1] * told + CONTEXT[2] * to_someone
        in_quotes += quote
    total, kinds = len(places), len({entry for _, _, (_, entry) in places})
    return [float(np.log1p(weight["exact"])), float(np.log1p(weight["near"])), float(np.log1p(weight["start"])), in_quotes / total, float(np.log1p(kinds)), min(1.0, 10 * total / len(words))]


@dataclass
class Model:
    """A lexicon and the weights of its features, the last one for a text without any."""

    lexicon: Lexicon
    weights: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([[*features(t, self.lexicon), 1.0] for t in texts]).reshape(-1, len(self.weights))
        return 1 / (1 + np.exp(-x @ self.weights))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.5, steps: int = 60) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        ridge = np.full(len(w), l2)
        ridge[-1] = 1e-6
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def select_terms(nodes: list[tuple[str, int, int]], purity: float) -> tuple[list[str], list[str]]:
    """Whole terms and beginnings from (node, toxic documents, documents); nodes of whole words end in $.

    Of beginnings the shortest stay; one that is mostly a single word gives way to the word.
    """
    good = {n: (t, d) for n, t, d in nodes if (t + 0.5) / (d + 1) >= purity}
    terms = {n[:-1]: c for n, c in good.items() if n.endswith("$")}
    starts: list[str] = []
    for n in sorted((n for n in good if not n.endswith("$")), key=lambda n: (len(n), n)):
        own = max((c[0] for w, c in terms.items() if w.startswith(n)), default=0)
        if own < 0.8 * good[n][0] and not any(n.startswith(s) for s in starts):
            starts.append(n)
    return sorted(w for w in terms if not any(w.startswith(s) for s in starts)), starts


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, train_rows: int, lexicon_size: int = 1000, least_docs: int = 4, purity: float = 0.85, errors: int = 1, start_sizes: tuple[int, int] = (4, 10)) -> Model:
    """A model from at most train_rows labelled rows; labels holds those that may be learned from.

    The lexicon has at most lexicon_size entries, beginnings of start_sizes letters among them.
    """
    chosen = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(train_rows)
    rows = staged(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y", (F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(3)) == 0).alias("held")), "labelled")

    def nodes(batches):
        toxic, all_docs = Counter(), Counter()
        for b in batches:
            for text, y, held in zip(b["text"], b["y"], b["held"], strict=True):
                if not held:
                    words = set(WORD.findall((text or "").lower()))
                    found = {w + "$" for w in words if len(w) >= 3}
                    for n in range(start_sizes[0], start_sizes[1] + 1):
                        found.update([w[:n] for w in words if len(w) >= n])
                    all_docs.update(found)
                    if y:
                        toxic.update(found)
        seen = sorted(toxic)
        rest = [n for n in all_docs if n not in toxic]
        yield {"node": seen + rest, "toxic": [toxic[n] for n in seen] + [0] * len(rest), "docs": [all_docs[n] for n in seen] + [all_docs[n] for n in rest]}

    counts = map_rows(rows, nodes, schema(node=T.StringType(), toxic=T.LongType(), docs=T.LongType())).groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs"))
    top = counts.where((F.col("toxic") >= least_docs) & (F.col("toxic") + 0.5 >= purity * (F.col("docs") + 1))).orderBy(F.desc("toxic"), "node").limit(lexicon_size)
    lexicon = Lexicon(*select_terms([tuple(r) for r in top.collect()], purity), errors=errors)

    def nearby(batches):
        toxic, all_docs = Counter(), Counter()
        for b in batches:
            for text, y, held in zip(b["text"], b["y"], b["held"], strict=True):
                if not held:
                    found = {entry for how, entry in lexicon.hits(set(WORD.findall((text or "").lower()))).values() if how == "near"}
                    all_docs.update(found)
                    toxic.update(found if y else ())
        yield {"node": list(all_docs), "toxic": [toxic[n] for n in all_docs], "docs": list(all_docs.values())}

    # terms whose neighbours are words of clean documents are looked up without errors
    mixed = map_rows(rows, nearby, schema(node=T.StringType(), toxic=T.LongType(), docs=T.LongType())).groupBy("node").agg(F.sum("toxic").alias("toxic"), F.sum("docs").alias("docs")).where("toxic + 0.5 < 0.5 * (docs + 1)")
    clash = {r["node"] for r in mixed.collect()}  # no more than lexicon_size
    lexicon = Lexicon(lexicon.terms, lexicon.starts, [t for t in lexicon.terms if t not in clash], errors=errors)

    def measured(batches):
        for b in batches:
            found = [(features(t, lexicon), y) for t, y, held in zip(b["text"], b["y"], b["held"], strict=True) if held]
            yield {"x": [x for x, _ in found], "y": [y for _, y in found]}

    table = map_rows(rows, measured, schema(x=T.ArrayType(T.DoubleType()), y=T.IntegerType())).collect()  # a third of train_rows
    if not table:
        return Model(lexicon, np.array([0.0] * len(FEATURES) + [-4.0]))
    x, y = np.array([[*r[0], 1.0] for r in table]), np.array([float(r[1] > 0) for r in table])
    weights = _logistic(x, y)
    weights[1] = max(weights[1], 0.6 * weights[0])  # misspelled terms are too rare in labels to be weighed by them alone
    return Model(lexicon, weights)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of each row."""

    def rows(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": model.scores(b["text"])}

    return map_rows(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), rows, schema(doc_id=T.LongType(), score=T.DoubleType()))


def op9_toxicity(spark, sf_dir: str, train_rows: int = 10_000) -> DataFrame:
    """Score of every document; labels of rows with crc32(doc_id) mod 4 of 2 are held out."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs, labels.where(~held("doc_id")), "doc_id", "text", "doc_id", "toxic", train_rows)
    found = score(docs, model)
    return found.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
