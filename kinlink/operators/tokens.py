"""Blocking tokens of records, as one array a record: no shuffle until they are exploded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.functions import tables as t
from kinlink.functions.textnorm import skeleton, words


def keyed(word: Column) -> Column:
    """Numbers marked with #, other words by their skeleton."""
    return F.when(word.rlike("^[0-9]+$"), F.concat(F.lit("#"), word)).otherwise(skeleton(word))


def pairs(ws: Column) -> Column:
    """Neighbouring words joined by _, by position."""
    return F.when(
        F.size(ws) > 1,
        F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: F.concat(F.element_at(ws, i), F.lit("_"), F.element_at(ws, i + 1))),
    ).otherwise(F.array().cast("array<string>"))


def _marked(country: Column, kind: str, ws: Column) -> Column:
    return F.transform(ws, lambda w: F.concat(country, F.lit(f"|{kind}|"), w))


def token_array(country: Column, core_sk: Column, alt: Column, addr: Column | None = None, core: Column | None = None) -> Column:
    """Distinct tokens of a record.

    n and m: skeletons of name words and their pairs, also of the alternative name, and the name without
    spaces; a and b: address words that aren't generic, and pairs of those; r and s, if core is given: name
    words and pairs as they are spelled. All begin with the country.
    """
    cty = F.lower(country)
    parts = []

    def add(kind: str, pair_kind: str, ws: Column) -> None:
        parts.append(F.transform(F.array(ws), lambda w: F.concat(_marked(cty, kind, w), _marked(cty, pair_kind, pairs(w))))[0])

    add("n", "m", words(core_sk))
    add("n", "m", F.transform(words(alt), keyed))
    parts.append(F.when(F.instr(core_sk, " ") > 0, F.array(F.concat(cty, F.lit("|n|"), F.regexp_replace(core_sk, " ", "")))).otherwise(F.array().cast("array<string>")))
    if addr is not None:
        add("a", "b", F.transform(F.filter(words(addr), lambda w: ~w.isin(t.ADDRESS_GENERIC)), keyed))
    if core is not None:
        add("r", "s", words(core))
    return F.array_distinct(F.concat(*parts))


def tokenize(records: DataFrame, with_addr: bool = True, raw: bool = False, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(rid, tok) of records with rid, country, core_sk, alt, addr (and core, if raw), and what keep has of them."""
    array = token_array(F.col("country"), F.col("core_sk"), F.col("alt"), F.col("addr") if with_addr else None, F.col("core") if raw else None)
    return records.select("rid", *keep, F.explode(array).alias("tok"))


def view_of(tok: Column) -> Column:
    """name, num or addr: which view a token belongs to."""
    kind, value = F.split_part(tok, F.lit("|"), F.lit(2)), F.split_part(tok, F.lit("|"), F.lit(3))
    return F.when((kind == "a") & value.startswith("#"), F.lit("num")).when(kind.isin("n", "m"), F.lit("name")).otherwise(F.lit("addr"))


def indexed() -> Column:
    """Whether a record is an entity, for candidates() to be read beside its tokens."""
    return (F.col("src") == 1).alias("indexed")


def name_marked(tokens: DataFrame) -> DataFrame:
    """tokens with `name`: whether a token is of the name alone, that is not of the address."""
    return tokens.withColumn("name", ~F.split_part("tok", F.lit("|"), F.lit(2)).isin("a", "b"))
