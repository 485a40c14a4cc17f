"""Names and addresses as Column expressions: cleaning, phonetic keys, legal forms, states, numbers.

Everything stays in the JVM. Word-wise steps are array transforms inside one row, so no step shuffles.
Only text in scripts beyond Latin needs transliterate() of kinlink.functions.translit first.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinlink.functions import tables as t

#: Latin letters with marks and the letters without (fixed values).
MARKED = "àâäáãåéèêëíîïìóôöòõøúûùüçñýÿšžœæß"
PLAIN = "aaaaaaeeeeiiiioooooouuuucnyyszoas"


def words(text: Column) -> Column:
    """The words between spaces; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def each_word(text: Column, f) -> Column:
    return F.array_join(F.transform(words(text), f), " ")


def skeleton(word: Column) -> Column:
    """Phonetic key of one word: numbers as they are, else consonants in classes, without vowels and repeats."""
    s = word
    for pattern, by in t.SKELETON:
        s = F.regexp_replace(s, pattern, by)
    s = F.regexp_replace(s, r"(.)\1+", "$1")
    return F.when(word.rlike("^[0-9]+$"), word).when(s == "", F.substring(word, 1, 2)).otherwise(s)


@lru_cache(maxsize=None)
def skeleton_of(word: str) -> str:
    """skeleton() of a literal, for tables."""
    import re

    if word.isdigit():
        return word
    s = word
    for pattern, by in t.SKELETON:
        s = re.sub(pattern, by, s)
    return re.sub(r"(.)\1+", r"\1", s) or word[:2]


def to_ascii(text: Column) -> Column:
    """Lower case without Latin marks and without words that mean null; null becomes ''."""
    plain = F.translate(F.lower(F.coalesce(text, F.lit(""))), MARKED, PLAIN)
    return F.regexp_replace(plain, t.NULLISH, " ")


def clean(text: Column) -> Column:
    """Lower-case letters, digits and single spaces; & is a word, ' and ` vanish."""
    s = F.regexp_replace(F.regexp_replace(text, "&", " and "), "['`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]+", " "), " +", " "))


def web_strip(text: Column) -> Column:
    """Points are spaces; a name keeps its place without http, www and the web ending."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", " "), t.WEB, " $1 ")


def aka_parts(text: Column) -> Column:
    """The names that 'aka', 'dba' and the like part; [''] without any."""
    parts = F.filter(F.transform(F.split(text, t.AKA), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) == 0, F.array(F.lit(""))).otherwise(parts)


def strip_legal(text: Column) -> Column:
    """text without legal forms, stop words and titles of address; if nothing is left, only without stop words, or whole."""
    dropped = sorted({*t.LEGAL, *t.STOP, *t.HONORIFIC})
    keys = sorted({skeleton_of(w) for w in t.LEGAL_SPELLINGS})
    ws = words(text)
    core = F.filter(ws, lambda w: ~w.isin(dropped) & ~((F.length(w) > 3) & skeleton(w).isin(keys)))
    some = F.filter(ws, lambda w: ~w.isin(t.STOP))
    return F.array_join(F.when(F.size(core) > 0, core).when(F.size(some) > 0, some).otherwise(ws), " ")


def legal_kind(ws: Column) -> Column:
    """The legal form that the words tell, '' if none."""
    out = F.lit("")
    for kind, tells in reversed(t.LEGAL_KINDS):
        hit = F.arrays_overlap(ws, F.array(*map(F.lit, tells)))
        if kind == "pvt":
            hit = hit | F.exists(ws, lambda w: skeleton(w) == "prvt")
        out = F.when(hit, F.lit(kind)).otherwise(out)
    return out


def name_parts(raw: Column) -> Column:
    """Struct of name_full, core, core_sk, legal and alt of a business name.

    With several names (aka), core is of the last and alt of the first.
    """
    full = clean(web_strip(to_ascii(raw)))
    return F.transform(
        F.array(full),
        lambda s: F.transform(
            F.array(F.transform(aka_parts(s), strip_legal)),
            lambda cores: F.struct(
                s.alias("name_full"),
                F.element_at(cores, -1).alias("core"),
                each_word(F.element_at(cores, -1), skeleton).alias("core_sk"),
                legal_kind(words(s)).alias("legal"),
                F.when(F.size(cores) > 1, F.element_at(cores, 1)).otherwise(F.lit("")).alias("alt"),
            ),
        )[0],
    )[0]


@lru_cache(maxsize=2)
def state_tables(strict: bool = False) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """By 'country,text', by skeleton without spaces, and French regions; strict leaves out skeletons of under 4 letters."""
    exact: dict[str, str] = {}
    by_sound: dict[str, str] = {}
    for country, mark, states in (("us", "st_us_", {k: [v] for k, v in t.US_STATES.items()}), ("india", "st_in_", t.INDIA_STATES)):
        for code, names in states.items():
            exact[f"{country},{code}"] = mark + code
            for n in names:
                exact[f"*,{n}"] = mark + code
                by_sound[skeleton_of(n.replace(" ", ""))] = mark + code
    france = {n: f"st_fr_{c}" for c, names in t.FRANCE_REGIONS.items() for n in names}
    return exact, {k: v for k, v in by_sound.items() if not strict or len(k) >= 4}, france


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of key in a small literal table, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def state_of(component: Column, country: Column, strict: bool = False) -> Column:
    """The state token of an address component, else null."""
    exact, by_sound, france = state_tables(strict)
    sound = F.when(F.length(component) > 3, lookup(by_sound, skeleton(F.regexp_replace(component, " ", ""))))
    other = F.coalesce(lookup(exact, F.concat(country, F.lit(","), component)), lookup(exact, F.concat(F.lit("*,"), component)), sound)
    return F.when(component == "", F.lit(None).cast("string")).when(country == "france", lookup(france, component)).otherwise(other)


def components(raw: Column) -> Column:
    """Cleaned parts of an address between commas, semicolons and bars."""
    return F.filter(F.transform(F.split(to_ascii(raw), "[,;|]"), clean), lambda c: c != "")


def ordinal_strip(word: Column) -> Column:
    return F.regexp_replace(word, "^([0-9]+)(st|nd|rd|th)$", "$1")


def canonical_number(digits: Column) -> Column:
    """digits without leading zeros; zero is '0'."""
    return F.regexp_replace(digits, "^0+(?=[0-9])", "")


def address_word(word: Column, country: Column) -> Column:
    """An abbreviation's long form, by country; other words as they are."""
    usual = F.coalesce(lookup(t.ADDRESS_WORDS, word), word)
    return F.when(country == "france", F.coalesce(lookup(t.ADDRESS_WORDS_FRANCE, word), usual)).otherwise(usual)


def numbers_in(word: Column) -> Column:
    """Every run of digits of word, canonical."""
    return F.transform(F.regexp_extract_all(word, F.lit("([0-9]+)"), 1), canonical_number)


def addr_parts(raw: Column, country: Column, strict_states: bool = False) -> Column:
    """Struct of addr, tokens, nums and state of an address; the last state component counts."""
    cty = F.lower(F.trim(F.coalesce(country, F.lit(""))))
    told = F.transform(components(raw), lambda c: F.struct(c.alias("c"), state_of(c, cty, strict_states).alias("st")))

    def tokens(parts: Column) -> Column:
        raw_words = F.flatten(F.transform(F.filter(parts, lambda p: p["st"].isNull()), lambda p: words(p["c"])))
        plain = F.transform(raw_words, ordinal_strip)
        return F.transform(plain, lambda w: F.when(w.rlike("^[0-9]+$"), canonical_number(w)).otherwise(address_word(w, cty)))

    def out(parts: Column) -> Column:
        return F.transform(
            F.array(tokens(parts)),
            lambda ts: F.struct(
                F.array_join(ts, " ").alias("addr"),
                ts.alias("tokens"),
                F.flatten(F.transform(ts, numbers_in)).alias("nums"),
                F.coalesce(F.try_element_at(F.filter(parts, lambda p: p["st"].isNotNull()), F.lit(-1))["st"], F.lit("")).alias("state"),
            ),
        )[0]

    return F.transform(F.array(told), out)[0]


def country_clean(country: Column) -> Column:
    return F.trim(F.coalesce(country, F.lit("")))
