"""SQL twins of the string similarities, from their definitions.

A longest common subsequence is a fold over the letters of the second string: a row of bits, one for each
letter of the first, in a 128-bit number, so the first string has at most 125 letters. Each function
returns an expression over two column names or expressions.
"""

from __future__ import annotations

_BIT = "pow(2, i - 1)::HUGEINT"


def _full(a: str) -> str:
    return f"(pow(2, length({a}))::HUGEINT - 1::HUGEINT)"


def masks(a: str, b: str) -> str:
    """For each letter of b the places in a that hold it."""
    return f"list_transform(range(1, length({b}) + 1), lambda j: list_sum(list_transform(range(1, length({a}) + 1), lambda i: CASE WHEN ({a})[i] = ({b})[j] THEN {_BIT} ELSE 0::HUGEINT END)))"


def common(a: str, found: str) -> str:
    """Length of the longest common subsequence of a and the letters whose masks are found."""
    step = f"((u + (u & v)) | (u - (u & v))) & {_full(a)}"
    return f"(length({a}) - bit_count(list_reduce(list_prepend({_full(a)}, {found}), lambda u, v: {step})))"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0.0 ELSE 200.0::DOUBLE * {common(a, masks(a, b))} / (length({a}) + length({b})) END"


def ratios(name: str, pairs: str) -> str:
    """CTE `name` (a, b, r): the ratio of each distinct pair that `pairs`, a query of a and b, yields."""
    return f"{name} AS MATERIALIZED (SELECT a, b, {ratio('a', 'b')} AS r FROM (SELECT DISTINCT a, b FROM ({pairs})))"


def words(text: str) -> str:
    return f"list_filter(string_split({text}, ' '), lambda w: w <> '')"


def sorted_words(text: str) -> str:
    return f"array_to_string(list_sort({words(text)}), ' ')"


def token_sets(name: str, pairs: str) -> str:
    """CTEs up to `name` (a, b, r): the token-set score of each distinct pair of `pairs`."""
    join = lambda own, other, keep: f"array_to_string(list_sort(list_filter(list_distinct({own}), lambda w: {keep} list_contains({other}, w))), ' ')"
    return f"""{name}_0 AS MATERIALIZED (SELECT a, b, {words('a')} AS x, {words('b')} AS y FROM (SELECT DISTINCT a, b FROM ({pairs}))),
{name}_1 AS MATERIALIZED (SELECT *, {join('x', 'y', '')} AS s, {join('x', 'y', 'NOT')} AS l, {join('y', 'x', 'NOT')} AS d FROM {name}_0),
{name}_2 AS MATERIALIZED (SELECT *, trim(s || ' ' || l) AS one, trim(s || ' ' || d) AS two FROM {name}_1),
{ratios(name + '_r', f"SELECT one AS a, two AS b FROM {name}_2 UNION ALL SELECT s, one FROM {name}_2 UNION ALL SELECT s, two FROM {name}_2")},
{name} AS MATERIALIZED (SELECT t.a, t.b, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN s <> '' AND (l = '' OR d = '') THEN 100.0 WHEN s = '' THEN r1.r ELSE greatest(r1.r, r2.r, r3.r) END AS r
FROM {name}_2 t JOIN {name}_r r1 ON r1.a = one AND r1.b = two JOIN {name}_r r2 ON r2.a = s AND r2.b = one JOIN {name}_r r3 ON r3.a = s AND r3.b = two)"""


def partials(name: str, pairs: str) -> str:
    """CTEs up to `name` (a, b, r): the best ratio of the shorter string and any window of its length in the longer, ends included.

    Strings of one length are compared both ways.
    """
    n, size = "length(s)", "(least(k + length(s), length(t)) - greatest(k, 0))"
    window = "m[greatest(k, 0) + 1 : least(k + length(s), length(t))]"
    best = f"list_max(list_transform(range(1 - {n}, length(t)), lambda k: 200.0::DOUBLE * {common('s', window)} / ({n} + {size})))"
    return f"""{name}_0 AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
{name}_1 AS MATERIALIZED (SELECT DISTINCT s, t FROM (SELECT CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM {name}_0 UNION ALL SELECT b, a FROM {name}_0 WHERE length(a) = length(b))),
{name}_2 AS MATERIALIZED (SELECT s, t, {masks('s', 't')} AS m FROM {name}_1 WHERE s <> ''),
{name}_3 AS MATERIALIZED (SELECT s, t, CASE WHEN contains(t, s) THEN 100.0 ELSE {best} END AS r FROM {name}_2 UNION ALL SELECT s, t, CASE WHEN t = '' THEN 100.0 ELSE 0.0 END FROM {name}_1 WHERE s = ''),
{name} AS MATERIALIZED (SELECT p.a, p.b, max(r) AS r FROM {name}_0 p JOIN {name}_3 q ON (q.s = p.a AND q.t = p.b) OR (q.s = p.b AND q.t = p.a) GROUP BY ALL)"""


def best_words(name: str, pairs: str) -> str:
    """CTEs up to `name` (a, b, r): the best ratio of the word a with any word of b, 0 without any."""
    return f"""{name}_0 AS MATERIALIZED (SELECT DISTINCT a, b FROM ({pairs})),
{name}_1 AS MATERIALIZED (SELECT a, b, unnest({words('b')}) AS o FROM {name}_0),
{ratios(name + '_r', f"SELECT a, o AS b FROM {name}_1")},
{name} AS MATERIALIZED (SELECT p.a, p.b, coalesce(max(q.r), 0.0) AS r FROM {name}_0 p LEFT JOIN {name}_1 o ON o.a = p.a AND o.b = p.b LEFT JOIN {name}_r q ON q.a = o.a AND q.b = o.o GROUP BY ALL)"""
