"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Every rule rejects a document by a condition on its text. Cost and selectivity (share rejected) of each
are measured on a bounded sample, and the rules run in the order of rejection per cost: a nested CASE
evaluates a rule only for rows that all earlier ones let pass. The order changes what a run costs, never
which rows it keeps nor which rule is named for a row: that is the first in the order given.

The sample is drawn at random from the rows of the table that is judged. The cost of a rule is the least
time of several runs over the kept sample, after one that isn't counted, less the time of a run without a
rule. A rule goes ahead of one that is given before it only if its rejection per cost is `clear` times as
great, so that a clock's noise doesn't change the order.

passing() is where the order saves work. judged() has to give the figures of every row, so there a rule that
can be told from them is, and only other rules look at the text again.

Edge cases: a null text has no words and is rejected by min_words, as an empty one; texts of any length
are judged whole; repeated rows get the same verdict each; an empty table gives an empty result (rules
then keep the order given). Columns of any name may be there; only text_col (and id_col) is read.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word rule (fixed values): space, tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, ""))


def n_symbols(text: Column) -> Column:
    full = F.coalesce(text, F.lit(""))
    return F.length(full) - F.length(F.translate(full, SYMBOLS, ""))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body has it in a lambda."""
    return F.transform(F.array(value), body)[0]


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))


def repeats(found: Column) -> Column:
    """How many of an array's elements equal an earlier one."""
    return F.size(found) - F.size(F.array_distinct(found))


def n_repeat_words(ws: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that occur twice or more.

    Windows are sorted by a hash and their place; each whose neighbour has the same hash and words is
    repeated. Sorted places then add what they cover beyond the place before.
    """

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.element_at(w, (i + k).cast("int")) for k in range(size)])

    def same(w: Column, a: Column, b: Column) -> Column:
        equal = a["h"] == b["h"]
        for k in range(size):
            equal = equal & (F.element_at(w, (a["i"] + k).cast("int")) == F.element_at(w, (b["i"] + k).cast("int")))
        return equal

    def places(w: Column) -> Column:
        ordered = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.struct(window(w, i).alias("h"), i.alias("i"))))
        return _bound(
            ordered,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(s, lambda x, n: ((n > 0) & same(w, x, F.get(s, n - 1))) | same(w, x, F.get(s, n + 1))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(0).alias("n"), F.lit(-size).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(F.lit(size), i - a["last"])).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    return _bound(ws, lambda w: F.when(F.size(w) < size + 1, F.lit(0)).otherwise(_bound(places(w), covered)))


#: Figures of a row that judged() gives or needs, by name.
Figures = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """name, a condition on text that rejects, and the same on the figures of a row, if they tell."""

    name: str
    rejects: Callable[[Column], Column]
    by_figures: Callable[[Figures], Column] | None = None


def default_rules(min_words: int = 50, repeat_percent: int = 50, symbol_percent: int = 5, dup_line_percent: int = 30, min_dup_lines: int = 3, mean_word: tuple[float, float] = (2.0, 15.0)) -> list[Rule]:
    few = lambda n: n < min_words
    windows = lambda repeated, n: 100 * repeated > repeat_percent * n
    symbols = lambda n, chars: 100 * n > symbol_percent * F.greatest(chars, F.lit(1))
    same_lines = lambda n, of: (n >= min_dup_lines) & (100 * n > dup_line_percent * of)
    length = lambda chars, n: ~(chars / F.greatest(n, F.lit(1))).between(*mean_word)
    return [
        Rule("min_words", lambda t: few(F.size(words(t))), lambda f: few(f["n_words"])),
        Rule("symbols", lambda t: symbols(n_symbols(t), word_chars(t)), lambda f: symbols(f["n_symbols"], f["word_chars"])),
        Rule("repeated_lines", lambda t: _bound(lines(t), lambda x: _bound(repeats(x), lambda n: same_lines(n, F.size(x)))), lambda f: same_lines(f["n_dup_lines"], f["n_lines"])),
        Rule("word_length", lambda t: length(word_chars(t), F.size(words(t))), lambda f: length(f["word_chars"], f["n_words"])),
        Rule("repeated_windows", lambda t: _bound(words(t), lambda w: windows(n_repeat_words(w), F.size(w))), lambda f: windows(f["n_repeat_words"], f["n_words"])),
    ]


def sample_of(docs: DataFrame, text_col: str, rows: int, files: int, seed: int = 42) -> DataFrame:
    """At most `rows` texts of docs, drawn at random; of a table of more than `files` files so many are read, spread over it."""
    try:
        paths = sorted(docs.inputFiles())
        if len(paths) > files:
            chosen = [paths[n * len(paths) // files].split(":", 1)[-1].lstrip("/") for n in range(files)]
            docs = docs.where(F.regexp_replace("_metadata.file_path", "^[^:]*:/*", "").isin(chosen))
        source = docs.select(F.col(text_col).cast("string").alias("text"))
    except AnalysisException:  # rows that no longer know their file: all of them are drawn from
        source = docs.select(F.col(text_col).cast("string").alias("text"))
    return source.orderBy(F.rand(seed)).limit(rows)


def order_rules(docs: DataFrame, rules: list[Rule], text_col: str = "text", sample_rows: int = 400, sample_files: int = 4, runs: int = 2, clear: float = 4.0) -> tuple[list[Rule], dict[str, tuple[float, float]]]:
    """rules by rejection per cost, and each one's (seconds a row, share rejected) on the sample."""
    sample = sample_of(docs, text_col, sample_rows, sample_files).cache()
    text = F.col("text")

    def run(condition: Column) -> tuple[float, float]:
        job = sample.agg(F.avg(condition.cast("double")))
        share = job.first()[0] or 0.0  # not counted: plans, generated code
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            job.first()
            took.append(time.perf_counter() - began)
        return min(took), share

    try:
        rows = sample.count()
        if not rows:
            return list(rules), {}
        idle, _ = run(text.isNull())
        figures = {}
        for rule in rules:
            took, share = run(rule.rejects(text))
            figures[rule.name] = (max(took - idle, idle / 2) / rows, share)
    finally:
        sample.unpersist()
    ordered: list[Rule] = []
    for rule in rules:
        cost, share = figures[rule.name]
        at = len(ordered)
        while at and share / cost > clear * figures[ordered[at - 1].name][1] / figures[ordered[at - 1].name][0]:
            at -= 1
        ordered.insert(at, rule)
    return ordered, figures


def rejected(text: Column, rules: list[Rule], figures: Figures | None = None) -> Column:
    """Whether a rule rejects text; the first that does ends it. Rules that figures tell don't look at the text."""
    out = F.lit(False)
    for rule in reversed(rules):
        condition = rule.by_figures(figures) if figures and rule.by_figures else rule.rejects(text)
        out = F.when(condition, F.lit(True)).otherwise(out)
    return out


def rejected_by(text: Column, ordered: list[Rule], given: list[Rule], figures: Figures | None = None) -> Column:
    """Of the rules that reject text the first in the order given, else null; rows that pass are judged in the other order."""
    name = F.lit(None).cast("string")
    for rule in reversed(given):
        condition = rule.by_figures(figures) if figures and rule.by_figures else rule.rejects(text)
        name = F.when(condition, F.lit(rule.name)).otherwise(name)
    return F.when(rejected(text, ordered, figures), name)


def passing(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", **sample) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    ordered, _ = order_rules(docs, rules or default_rules(), text_col, **sample)
    return docs.where(~rejected(F.col(text_col).cast("string"), ordered))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, **sample) -> DataFrame:
    """Base figures of each row, base_failed, kept, and of the rules that reject it the first in the order given.

    kept is false where base_failed is, whatever the rules.
    """
    given = rules or default_rules()
    ordered, _ = order_rules(docs, given, text_col, **sample)
    text = F.col("text")
    once = lambda value, body: F.transform(F.array(value), body)[0]
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id",
        "text",
        once(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), n_repeat_words(w).cast("long").alias("n_repeat_words"))).alias("w"),
        once(lines(text), lambda x: F.struct(F.size(x).alias("n_lines"), repeats(x).cast("long").alias("n_dup_lines"))).alias("l"),
        word_chars(text).cast("long").alias("word_chars"),
        n_symbols(text).cast("long").alias("n_symbols"),
    )
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    base = base.select("doc_id", "text", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    figures = {n: F.col(n) for n in (*names, "n_lines")}
    return base.select(
        "doc_id", *names, failed.alias("base_failed"), (~failed & ~rejected(text, ordered, figures)).alias("kept"), rejected_by(text, ordered, given, figures).alias("rejected_by")
    )


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document, by judged()."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rejected_by")


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM t),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 5 * greatest(word_chars, 1) AND NOT (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
       AND word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 15.0 AS kept
FROM v
"""
