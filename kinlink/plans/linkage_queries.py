"""Queries on candidates, features, the graph, decisions, evaluation and models, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import strsim
from kinlink.functions import tables as t
from kinlink.functions import textnorm as n
from kinlink.operators import decide, fine, graph, metrics, model, rates, simjoin, splits
from kinlink.operators import features as feats
from kinlink.operators.relational import joined_lists
from kinlink.operators.windows import query_context as context_of
from kinlink.plans import fixtures as x
from kinlink.plans import similarity_sql as y
from kinlink.plans.fixtures import sql_skeleton, sql_text, table, with_sql
from kinlink.plans.text_queries import CORES_SQL, KIND_SQL
from kinlink.sources.tables import settled

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(df, *cols: str, digits: int = 6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@query(with_sql("SELECT q_rid, e_rid, round(s, 6) AS s, r FROM top_f", "top_f"))
def cosine_topk_full(spark, sf):
    return x.cand(spark, sf).where("br_f < 99").select("q_rid", "e_rid", F.round("bs_f", 6).alias("s"), F.col("br_f").cast("long").alias("r"))


@query(with_sql("SELECT q_rid, e_rid, round(s, 6) AS s, r FROM top_n", "top_n"))
def cosine_topk_name(spark, sf):
    return x.cand(spark, sf).where("br_n < 99").select("q_rid", "e_rid", F.round("bs_n", 6).alias("s"), F.col("br_n").cast("long").alias("r"))


@query(with_sql("SELECT q_rid, e_rid, round(bs_f, 6) AS bs_f, br_f, round(bs_n, 6) AS bs_n, br_n FROM cand", "cand"))
def candidates_union(spark, sf):
    return rounded(x.blocked(spark, sf), "bs_f", "bs_n").withColumns({c: F.col(c).cast("long") for c in ("br_f", "br_n")})


@query(with_sql("SELECT q_rid, r_rid, round(s, 6) AS s, r_rank FROM links", "links"))
def record_graph_links(spark, sf):
    return rounded(x.links(spark, sf), "s").withColumn("r_rank", F.col("r_rank").cast("long"))


@query(with_sql("SELECT q_rid, true_e FROM gt", "gt"))
def gt_flatten(spark, sf):
    """The truth as lists an entity, flattened again."""
    from kinlink.sources.tables import truth_pairs

    g = x.gt(spark, sf)
    lists = g.groupBy("true_e").agg(F.array_join(F.collect_list(F.col("q_rid").cast("string")), ",").alias("matched_entity_ids")).select(F.col("true_e").cast("string").alias("source1_entity_id"), "matched_entity_ids")
    return truth_pairs(lists, x.linkage_records(spark, sf))


_VIEW = "CASE WHEN split_part(tok, '|', 2) = 'a' AND split_part(tok, '|', 3)[1] = '#' THEN 'num' WHEN split_part(tok, '|', 2) IN ('n', 'm') THEN 'name' ELSE 'addr' END"
_DOT = f"""vv AS MATERIALIZED (SELECT tok, {_VIEW} AS view, ln((SELECT count(*) FROM rec WHERE src = 1) + 1.0) - ln(CAST(count(*) AS DOUBLE)) AS w FROM tok_v JOIN rec USING (rid) WHERE src = 1 GROUP BY tok),
xv AS MATERIALIZED (SELECT rid, tok, view, w FROM tok_v JOIN vv USING (tok)),
st AS MATERIALIZED (SELECT rid, view, sum(w) AS s, sqrt(sum(w * w)) AS norm, CAST(count(*) AS DOUBLE) AS n FROM xv GROUP BY ALL),
dt AS MATERIALIZED (SELECT q_rid, e_rid, q.view, sum(q.w * q.w) AS ww, sum(q.w) AS w FROM cand JOIN xv q ON q.rid = q_rid JOIN xv e ON e.rid = e_rid AND e.tok = q.tok GROUP BY ALL)
"""


def _dot_columns(digits: int = 9) -> tuple[str, str]:
    cols, joins = [], []
    for v in simjoin.VIEWS:
        joins.append(f"LEFT JOIN dt d_{v} ON d_{v}.q_rid = c.q_rid AND d_{v}.e_rid = c.e_rid AND d_{v}.view = '{v}' LEFT JOIN st q_{v} ON q_{v}.rid = c.q_rid AND q_{v}.view = '{v}' LEFT JOIN st e_{v} ON e_{v}.rid = c.e_rid AND e_{v}.view = '{v}'")
        cols += [
            f"round(round(coalesce(d_{v}.ww, 0) / greatest(coalesce(q_{v}.norm, 0) * coalesce(e_{v}.norm, 0), 1e-6), 9), {digits}) AS cos_{v}",
            f"round(round(coalesce(d_{v}.w, 0) / greatest(coalesce(q_{v}.s, 0), 1e-6), 9), {digits}) AS covq_{v}",
            f"round(round(coalesce(d_{v}.w, 0) / greatest(coalesce(e_{v}.s, 0), 1e-6), 9), {digits}) AS cove_{v}",
            f"coalesce(q_{v}.n, 0) AS nq_{v}",
            f"coalesce(e_{v}.n, 0) AS ne_{v}",
        ]
    return ", ".join(cols), " ".join(joins)


@query(with_sql("SELECT c.q_rid, c.e_rid, {} FROM cand c {}".format(*_dot_columns(6)), "cand", "tok_v").replace("\nSELECT c.q_rid", f",\n{_DOT}\nSELECT c.q_rid"))
def pair_dot(spark, sf):
    found = simjoin.view_dots(x.cand(spark, sf).select("q_rid", "e_rid"), x.views(spark, sf), x.linkage_records(spark, sf).where("src = 1"))
    return rounded(found, *[c for c in found.columns if c.startswith("co")])


def _named_pairs(spark, sf):
    r = x.rec(spark, sf)
    named = lambda s: r.select(F.col("rid").alias(f"{s}_rid"), F.col("name").alias(f"n{s}"), F.col("addr").alias(f"a{s}"))
    return x.cand(spark, sf).select("q_rid", "e_rid").join(named("q"), "q_rid").join(named("e"), "e_rid")


@query("SELECT a.p_partkey, round(jaro_winkler_similarity(a.p_name, b.p_name), 9) AS jw FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def sim_jaro_winkler(spark, sf):
    p = table(spark, sf, "part")
    pair = p.select("p_partkey", "p_name").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return pair.select("p_partkey", F.round(strsim.jaro_winkler("p_name", "other"), 9).alias("jw"))


@query("SELECT l_orderkey, l_partkey, levenshtein(CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR)) AS d FROM lineitem")
def sim_levenshtein(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.levenshtein(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).cast("long").alias("d"))


#: The longest common subsequence, one letter of the first word an iteration.
_LCS_RATIO = """WITH RECURSIVE names AS MATERIALIZED (SELECT a.p_partkey, a.p_name AS a, b.p_name AS b FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a, b FROM names),
lcs(a, b, i, line) AS (SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda j: 0) FROM pairs
UNION ALL SELECT a, b, i + 1, list_reduce(list_prepend([0], list_transform(range(1, length(b) + 1), lambda j: [CASE WHEN a[i + 1] = b[j] THEN line[j] + 1 ELSE line[j + 1] END])), lambda u, v: list_append(u, greatest(u[len(u)], v[1]))) FROM lcs WHERE i < length(a))
SELECT p_partkey, round(200.0 * line[length(b) + 1] / (length(a) + length(b)), 6) AS ratio FROM names JOIN lcs USING (a, b) WHERE i = length(a)"""


@query(_LCS_RATIO)
def sim_ratio(spark, sf):
    p = table(spark, sf, "part")
    pair = p.select("p_partkey", "p_name").join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other")), "p_partkey")
    return pair.select("p_partkey", F.round(strsim.ratio("p_name", "other"), 6).alias("ratio"))


_NAMED = "named AS MATERIALIZED (SELECT q_rid, e_rid, q.name AS nq, e.name AS ne, q.addr AS aq, e.addr AS ae FROM cand JOIN rec q ON q.rid = q_rid JOIN rec e ON e.rid = e_rid)"


def _score_sql(parts: str, a: str, b: str) -> str:
    """The score z of both texts of candidates."""
    return x.more_sql(f"{_NAMED},\n{parts}", f"SELECT q_rid, e_rid, round(r, 6) AS score FROM named JOIN z ON z.a = {a} AND z.b = {b}", "cand")


def _similarity(name: str, f, column: str, sql: str):
    def run(spark, sf):
        return _named_pairs(spark, sf).select("q_rid", "e_rid", F.round(f(f"{column}q", f"{column}e"), 6).alias("score"))

    QUERIES[name], ORACLES[name] = run, sql


_SORTED = [y.sorted_words(c) for c in ("nq", "ne")]
_similarity("sim_token_sort", strsim.token_sort_ratio, "n", _score_sql(y.ratios("z", f"SELECT {_SORTED[0]} AS a, {_SORTED[1]} AS b FROM named"), *_SORTED))
_similarity("sim_token_set", strsim.token_set_ratio, "n", _score_sql(y.token_sets("z", "SELECT nq AS a, ne AS b FROM named"), "nq", "ne"))
_similarity("sim_partial", strsim.partial_ratio, "n", _score_sql(y.partials("z", "SELECT nq AS a, ne AS b FROM named"), "nq", "ne"))


def _partial_sets(name: str, a: str, b: str) -> str:
    """CTEs up to `name` (a, b, r): 100 if the word sets of a and b meet, 0 if one is empty, else the partial ratio of both sorted."""
    text = lambda w: f"array_to_string(list_sort(list_distinct({w})), ' ')"
    return f"""{name}_s AS MATERIALIZED (SELECT a, b, v, w, {text('v')} AS s, {text('w')} AS t FROM (SELECT DISTINCT {a} AS a, {b} AS b, {y.words(a)} AS v, {y.words(b)} AS w FROM named)),
{y.partials(name + '_p', f"SELECT s AS a, t AS b FROM {name}_s WHERE len(v) > 0 AND len(w) > 0 AND NOT list_has_any(v, w)")},
{name} AS MATERIALIZED (SELECT k.a, k.b, CASE WHEN len(v) = 0 OR len(w) = 0 THEN 0.0 WHEN list_has_any(v, w) THEN 100.0 ELSE r END AS r FROM {name}_s k LEFT JOIN {name}_p p ON p.a = s AND p.b = t)"""


_similarity("sim_partial_token_set", strsim.partial_token_set_ratio, "a", _score_sql(_partial_sets("z", "aq", "ae"), "aq", "ae"))


@query(_score_sql(y.best_words("z", "SELECT string_split(nq, ' ')[1] AS a, ne AS b FROM named"), "string_split(nq, ' ')[1]", "ne"))
def sim_best_word(spark, sf):
    return _named_pairs(spark, sf).select("q_rid", "e_rid", F.round(strsim.best_word_match(F.get(F.split("nq", " "), 0), F.col("ne")), 6).alias("score"))


_ALTS = "alts AS MATERIALIZED (SELECT q_rid, e_rid, q.alt AS aq, q.core AS cq, e.alt AS ae, e.core AS ce FROM cand JOIN names q ON q.rid = q_rid JOIN names e ON e.rid = e_rid)"


@query(x.more_sql(
    f"{CORES_SQL},\n{_ALTS},\n{y.token_sets('z', 'SELECT aq AS a, ce AS b FROM alts UNION ALL SELECT cq, ae FROM alts')}",
    "SELECT q_rid, e_rid, round(CASE WHEN aq = '' AND ae = '' THEN -1.0 ELSE greatest(u.r, v.r) END, 6) AS score FROM alts JOIN z u ON u.a = aq AND u.b = ce JOIN z v ON v.a = cq AND v.b = ae", "raw", "cand"))
def sim_alt(spark, sf):
    r = x.raw(spark, sf).select("rid", n.name_parts(F.col("business_name")).alias("p")).select("rid", "p.core", "p.alt")
    named = lambda s: r.select(F.col("rid").alias(f"{s}_rid"), F.col("core").alias(f"c{s}"), F.col("alt").alias(f"a{s}"))
    pair = x.cand(spark, sf).select("q_rid", "e_rid").join(named("q"), "q_rid").join(named("e"), "e_rid")
    return pair.select("q_rid", "e_rid", F.round(strsim.alt_score(F.col("aq"), F.col("cq"), F.col("ae"), F.col("ce")), 6).alias("score"))


def _stage1_sql() -> str:
    """All features of the first stage for all candidates; records of the fixture have one name each and no state."""
    flat = lambda c: f"replace({c}, ' ', '')"
    scores = {
        "n_ratio": ("r_all", "nq", "ne"), "n_tsort": ("r_all", "snq", "sne"), "n_tset": ("t_all", "nq", "ne"), "n_partial": ("p_all", "nq", "ne"),
        "n_despace": ("r_all", "fnq", "fne"), "n_despace_part": ("p_all", "fnq", "fne"), "sk_ratio": ("r_all", "kq", "ke"), "sk_tset": ("t_all", "kq", "ke"),
        "full_tsort": ("r_all", "snq", "sne"), "a_ratio": ("r_all", "aq", "ae"), "a_tset": ("t_all", "aq", "ae"), "a_tsort": ("r_all", "saq", "sae"), "a_partial_tset": ("z", "aq", "ae"),
    }
    of = lambda kind: " UNION ALL ".join(f"SELECT {a} AS a, {b} AS b FROM named" for a, b in dict.fromkeys((a, b) for k, a, b in scores.values() if k == kind))
    side = lambda c: f"{c}.name AS n{c}, {c}.addr AS a{c}, {c}.key AS k{c}, {c}.legal AS l{c}, {y.sorted_words(f'{c}.name')} AS sn{c}, {y.sorted_words(f'{c}.addr')} AS sa{c}, {flat(f'{c}.name')} AS fn{c}, {c}.nums AS m{c}, {c}.src AS src{c}"
    record = f"""recs AS MATERIALIZED (SELECT rid, src, name, addr, array_to_string(sk, ' ') AS key, {KIND_SQL} AS legal, list_filter({y.words('addr')}, lambda w: regexp_matches(w, '^[0-9]+$')) AS nums FROM (SELECT *, nw AS w FROM rsk)),
named AS MATERIALIZED (SELECT q_rid, e_rid, bs_f, br_f, bs_n, br_n, {side('q')}, {side('e')} FROM cand JOIN recs q ON q.rid = q_rid JOIN recs e ON e.rid = e_rid)"""
    cols, joins = _dot_columns()
    joined = " ".join(f"JOIN {k} s_{f} ON s_{f}.a = n.{a} AND s_{f}.b = n.{b}" for f, (k, a, b) in scores.items())
    shared = "len(list_intersect(list_distinct(mq), list_distinct(me)))"
    base = f"""base AS MATERIALIZED (SELECT n.*, {', '.join(f's_{f}.r AS {f}' for f in scores)}, jaro_winkler_similarity(nq, ne) AS n_jw, d.* EXCLUDE (q_rid, e_rid) FROM named n {joined} JOIN dots d ON d.q_rid = n.q_rid AND d.e_rid = n.e_rid)"""
    grouped = feats.GROUPED
    tops = "tops AS MATERIALIZED (SELECT *, " + ", ".join(f"max({g}) OVER q AS {g}_m1, rank() OVER (PARTITION BY q_rid ORDER BY {g} DESC) AS {g}_rk" for g in grouped) + ", count(*) OVER q AS q_ncand FROM base WINDOW q AS (PARTITION BY q_rid))"
    seconds = "seconds AS MATERIALIZED (SELECT *, " + ", ".join(f"sum(CASE WHEN {g} = {g}_m1 THEN 1 ELSE 0 END) OVER q AS {g}_n1, coalesce(max(CASE WHEN {g} < {g}_m1 THEN {g} END) OVER q, 0) AS {g}_m2" for g in grouped) + " FROM tops WINDOW q AS (PARTITION BY q_rid))"
    plain = {
        "n_alt": "-1.0", "num_nq": "len(mq)", "num_ne": "len(me)", "num_shared": shared, "num_first_eq": "CASE WHEN len(mq) = 0 OR len(me) = 0 THEN -1 WHEN mq[1] = me[1] THEN 1 ELSE 0 END",
        "num_first_in": "CASE WHEN len(mq) = 0 THEN -1 WHEN list_contains(me, mq[1]) THEN 1 ELSE 0 END", "legal_eq": "CASE WHEN lq = '' OR le = '' THEN 0 WHEN lq = le THEN 1 ELSE -1 END",
        "state_eq": "0", "q_noaddr": "CASE WHEN aq = '' THEN 1 ELSE 0 END", "q_native": "0", "len_cq": "length(nq)", "len_ce": "length(ne)", "ntok_cq": "length(nq) - length(replace(nq, ' ', ''))",
        "len_aq": "length(aq)", "len_ae": "length(ae)", "q_src3": "CASE WHEN srcq = 3 THEN 1 ELSE 0 END", "num_covq": f"{shared} / greatest(len(mq), 1)", "num_qonly": f"len(mq) - {shared}",
    }
    gaps = {f"{g}_gap": f"{g} - CASE WHEN {g} = {g}_m1 AND {g}_n1 = 1 THEN {g}_m2 ELSE {g}_m1 END" for g in grouped}
    # gaps are differences of figures of nine digits: at six, many would lie half-way
    out = ", ".join(f"round(CAST({(plain | gaps).get(f, f)} AS DOUBLE), {9 if f in gaps else 6}) AS {f}" for f in feats.FEATURES)
    more = ",\n".join(
        [
            record, _DOT.strip(), f"dots AS MATERIALIZED (SELECT c.q_rid, c.e_rid, {cols} FROM cand c {joins})",
            y.ratios("r_all", of("r_all")), y.token_sets("t_all", of("t_all")), y.partials("p_all", of("p_all")), _partial_sets("z", "aq", "ae"), base, tops, seconds,
        ]
    )
    return x.more_sql(more, f"SELECT q_rid, e_rid, {out} FROM seconds", "cand", "tok_v")


@query(_stage1_sql())
def stage1_features(spark, sf):
    found = feats.stage1_features(x.cand(spark, sf), x.linkage_records(spark, sf))
    gaps = [f"{c}_gap" for c in feats.GROUPED]
    return rounded(rounded(found, *[c for c in feats.FEATURES if c not in gaps]), *gaps, digits=9)


def _digits(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    text = lambda c: F.col(c).cast("string")
    return li.select("*", F.array(text("l_orderkey"), text("l_suppkey")).alias("nq"), F.array(text("l_partkey"), text("l_suppkey")).alias("ne"))


_NUMBERS = "nums AS MATERIALIZED (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, CAST(l_orderkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b, [CAST(l_orderkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)] AS nq, [CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)] AS ne FROM lineitem)"
_SWAP = "length(a) = length(b) AND list_sort(string_split(a, '')) = list_sort(string_split(b, ''))"


@query(f"""WITH {_NUMBERS} SELECT l_orderkey, l_partkey, l_suppkey, CAST(levenshtein(a, b) AS DOUBLE) AS f_hn_ed, CAST(least(levenshtein(a, ne[1]), levenshtein(a, ne[2])) AS DOUBLE) AS f_hn_led,
CAST(abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1 AS DOUBLE) AS f_hn_drop, CAST(length(a) = length(b) AND levenshtein(a, b) = 1 AS DOUBLE) AS f_hn_1dig,
CAST(levenshtein(a, b) > 1 AND abs(l_orderkey - l_partkey) <= 20 AS DOUBLE) AS f_hn_shift, CAST(a <> b AND {_SWAP} AS DOUBLE) AS f_hn_swap FROM nums""")
def hn_edit(spark, sf):
    return _digits(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", *fine.number_edits(F.col("nq"), F.col("ne")))


@query(f"""WITH {_NUMBERS} SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN a = b THEN 'same' WHEN abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1 THEN 'drop' WHEN {_SWAP} THEN 'swap'
WHEN length(a) = length(b) AND levenshtein(a, b) = 1 THEN '1dig' WHEN abs(l_orderkey - l_partkey) <= 20 THEN 'shift' WHEN a IN (b, CAST(l_suppkey AS VARCHAR)) THEN 'inother' ELSE 'other' END AS kind FROM nums""")
def hn_type(spark, sf):
    return _digits(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", rates.number_edit_kind(F.col("nq"), F.col("ne")).alias("kind"))


@query(f"""WITH {_NUMBERS} SELECT l_orderkey, l_partkey, l_suppkey, CAST(a = b AS DOUBLE) AS f_hn_eq, round(ln(1.0 + least(abs(l_orderkey - l_partkey), abs(l_orderkey - l_suppkey))), 6) AS f_hn_dmin, round(ln(1.0 + abs(l_orderkey - l_partkey)), 6) AS f_hn_dfirst,
CAST(len(list_filter(list_distinct(ne), lambda v: NOT list_contains(nq, v))) AS DOUBLE) AS f_num_eonly FROM nums""")
def hn_gaps(spark, sf):
    return rounded(_digits(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", *fine.number_gaps(F.col("nq"), F.col("ne"))), "f_hn_dmin", "f_hn_dfirst")


@query(f"""WITH {_NUMBERS} SELECT l_orderkey, l_partkey, l_suppkey, 2.0 AS num_nq, 2.0 AS num_ne, CAST(len(list_intersect(list_distinct(nq), list_distinct(ne))) AS DOUBLE) AS num_shared, CAST(a = b AS DOUBLE) AS num_first_eq, CAST(list_contains(ne, a) AS DOUBLE) AS num_first_in,
len(list_intersect(list_distinct(nq), list_distinct(ne))) / 2 AS num_covq, CAST(2 - len(list_intersect(list_distinct(nq), list_distinct(ne))) AS DOUBLE) AS num_qonly FROM nums""")
def number_features(spark, sf):
    return _digits(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", *feats.number_features(F.col("nq"), F.col("ne")))


_CONTEXT = """a AS MATERIALIZED (SELECT *, max(p) OVER q AS q_max, sum(p) OVER q AS q_sum, sum(CASE WHEN p > 0.1 THEN 1 ELSE 0 END) OVER q AS q_n10, rank() OVER (PARTITION BY q_rid ORDER BY p DESC) AS q_rank FROM scores WINDOW q AS (PARTITION BY q_rid)),
b AS MATERIALIZED (SELECT *, sum(CASE WHEN p = q_max THEN 1 ELSE 0 END) OVER (PARTITION BY q_rid) AS n1, coalesce(max(CASE WHEN p < q_max THEN p END) OVER (PARTITION BY q_rid), 0) AS m2, CASE WHEN q_rank = 1 AND p > 0.5 THEN 1 ELSE 0 END AS win FROM a)
"""


@query(with_sql("SELECT q_rid, e_rid, round(p - CASE WHEN p = q_max AND n1 = 1 THEN m2 ELSE q_max END, 6) AS q_gap, round(q_max, 6) AS q_max, round(q_sum, 6) AS q_sum, CAST(q_n10 AS DOUBLE) AS q_n10, CAST(q_rank AS DOUBLE) AS q_rank FROM b", "scores").replace("\nSELECT q_rid, e_rid, round(p -", f",\n{_CONTEXT}\nSELECT q_rid, e_rid, round(p -"))
def query_context(spark, sf):
    return rounded(context_of(x.scores(spark, sf)).select("q_rid", "e_rid", "q_gap", "q_max", "q_sum", "q_n10", "q_rank"), "q_gap", "q_max", "q_sum")


@query(with_sql("SELECT q_rid, e_rid, CAST(sum(win) OVER e - win AS DOUBLE) AS e_nwin_other, round(sum(p) OVER e, 6) AS e_psum, CAST(count(*) OVER e AS DOUBLE) AS e_ncand, CAST(rank() OVER (PARTITION BY e_rid ORDER BY p DESC) AS DOUBLE) AS e_rank, round(max(p) OVER e, 6) AS e_pmax FROM b WINDOW e AS (PARTITION BY e_rid)", "scores").replace("\nSELECT q_rid, e_rid, CAST(sum(win)", f",\n{_CONTEXT}\nSELECT q_rid, e_rid, CAST(sum(win)"))
def entity_context(spark, sf):
    return rounded(context_of(x.scores(spark, sf)).select("q_rid", "e_rid", "e_nwin_other", "e_psum", "e_ncand", "e_rank", "e_pmax"), "e_psum", "e_pmax")


def _labelled(spark, sf):
    """Scored pairs with both sides' words, numbers and legal forms, and y."""
    c, r = F.col, x.linkage_records(spark, sf)
    records = r.select("rid", n.words(c("core")).alias("t"), rates.first_numbers(c("nums")).alias("n"), c("legal").alias("l"), c("country").alias("c"))
    pairs = splits.label(x.scores(spark, sf).select("q_rid", "e_rid"), x.gt(spark, sf))
    cells = simjoin.pair_cells(spark, r.where("src <> 1").count(), r.where("src = 1").count(), 200_000)
    found = simjoin.met_pairs(pairs, records, cells, ["t", "n", "l", "c"])
    return found.select("q_rid", "e_rid", "y", *[c(f"{k}_{side}").alias(f"{k}{side}") for k in "tnlc" for side in "qe"])


_PAIR_WORDS = "pw AS MATERIALIZED (SELECT s.q_rid, s.e_rid, q.nw AS tq, e.nw AS te, CASE WHEN g.q_rid IS NULL THEN 0 ELSE 1 END AS y FROM scores s JOIN rwords q ON q.rid = s.q_rid JOIN rwords e ON e.rid = s.e_rid LEFT JOIN gt g ON g.q_rid = s.q_rid AND g.true_e = s.e_rid),\npx AS MATERIALIZED (SELECT *, list_distinct(list_filter(tq, lambda w: NOT list_contains(te, w))) AS xq, list_distinct(list_filter(te, lambda w: NOT list_contains(tq, w))) AS xe FROM pw)\n"
_RATES = " UNION ALL ".join(f"SELECT w, '{s}' AS side, n, round((ys + 20 * (SELECT avg(y) FROM ex_{s})) / (n + 20), 6) AS rate FROM (SELECT w, count(*) AS n, sum(y) AS ys FROM ex_{s} GROUP BY w HAVING count(*) >= 3)" for s in "qe")


@query(with_sql(f"SELECT * FROM ({_RATES})", "scores", "gt", "rwords").replace("\nSELECT * FROM (SELECT w", f",\n{_PAIR_WORDS}, ex_q AS MATERIALIZED (SELECT y, unnest(xq) AS w FROM px WHERE len(xe) = 0), ex_e AS MATERIALIZED (SELECT y, unnest(xe) AS w FROM px WHERE len(xq) = 0)\nSELECT * FROM (SELECT w"))
def extra_word_rates(spark, sf):
    return rounded(rates.extra_word_rates(_labelled(spark, sf), least=3), "rate")


def _signed(spark, sf):
    c = F.col
    f, g = rates.signatures(c("tq"), c("te"), c("nq"), c("ne"), c("lq"), c("le"), c("cq"))
    return _labelled(spark, sf).select("q_rid", "e_rid", "y", f.alias("fine"), g.alias("coarse"))


def _swapped(a: str, b: str) -> str:
    return f"length({a}) = length({b}) AND list_sort(string_split({a}, '')) = list_sort(string_split({b}, ''))"


def _numbers_sql(addr: str) -> str:
    return f"list_transform(list_filter({y.words(addr)}, lambda w: regexp_matches(w, '^[0-9]+$')), lambda w: regexp_replace(w, '^0+([0-9])', '\\1'))"


_EXCEPT = "list_distinct(list_filter({a}, lambda w: NOT list_contains({b}, w)))"
#: Scored pairs with both sides' words, numbers, legal forms and y, and how they differ.
_SIGNED = f"""sides AS MATERIALIZED (SELECT rid, country, nw, {_numbers_sql('addr')} AS nums, {KIND_SQL} AS legal FROM (SELECT *, nw AS w FROM rwords)),
pw AS MATERIALIZED (SELECT s.q_rid, s.e_rid, q.nw AS tq, e.nw AS te, q.nums AS nq, e.nums AS ne, q.legal AS lq, e.legal AS le, lower(q.country) AS cty, CASE WHEN g.q_rid IS NULL THEN 0 ELSE 1 END AS y FROM scores s JOIN sides q ON q.rid = s.q_rid JOIN sides e ON e.rid = s.e_rid LEFT JOIN gt g ON g.q_rid = s.q_rid AND g.true_e = s.e_rid),
px AS MATERIALIZED (SELECT *, {_EXCEPT.format(a='tq', b='te')} AS xq, {_EXCEPT.format(a='te', b='tq')} AS xe, nq[1] AS a, ne[1] AS b FROM pw),
pk AS MATERIALIZED (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN 'none' WHEN a IS NULL THEN 'noq' WHEN b IS NULL THEN 'noe' WHEN a = b THEN 'same' WHEN abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1 THEN 'drop' WHEN {_swapped('a', 'b')} THEN 'swap'
WHEN length(a) = length(b) AND levenshtein(a, b) = 1 THEN '1dig' WHEN length(a) < 10 AND length(b) < 10 AND abs(TRY_CAST(a AS BIGINT) - TRY_CAST(b AS BIGINT)) <= 20 THEN 'shift' WHEN list_contains(ne, a) THEN 'inother' ELSE 'other' END AS kind, least(len(xq), 2) || '|r' || least(len(xe), 2) AS more FROM px),
signed AS MATERIALIZED (SELECT *, cty || '|' || kind || '|' || CASE lq WHEN '' THEN '-' ELSE lq END || '>' || CASE le WHEN '' THEN '-' ELSE le END || '|a' || more AS fine, kind || '|a' || more AS coarse FROM pk)"""
_SIG_RATES = " UNION ALL ".join(f"SELECT sig, '{k}' AS kind, n, (ys + 20 * (SELECT avg(y) FROM signed)) / (n + 20) AS rate FROM (SELECT {k} AS sig, count(*) AS n, sum(y) AS ys FROM signed GROUP BY ALL HAVING count(*) >= 3)" for k in ("fine", "coarse"))


@query(x.more_sql(_SIGNED, "SELECT q_rid, e_rid, y, fine, coarse FROM signed", "scores", "gt", "rwords"))
def diff_signature(spark, sf):
    return _signed(spark, sf)


@query(x.more_sql(_SIGNED, f"SELECT sig, kind, n, round(rate, 6) AS rate FROM ({_SIG_RATES})", "scores", "gt", "rwords"))
def signature_rates(spark, sf):
    return rounded(rates.signature_rates(_signed(spark, sf), least=3), "rate")


def _aligned_sql(side: str, own: str, other: str) -> str:
    """CTEs up to f{side}: five figures on the words of `own` that `other` lacks."""
    return f"""{side}_w AS MATERIALIZED (SELECT q_rid, e_rid, unnest({own}) AS v, {other} AS o, array_to_string({other}, ' ') AS ot FROM kept),
{side}_k AS MATERIALIZED (SELECT *, {sql_skeleton('v')} AS k, list_transform(o, lambda w: {sql_skeleton('w')}) AS ks FROM {side}_w),
{y.best_words(side + '_b', f"SELECT v AS a, ot AS b FROM {side}_k")},
{side}_s AS MATERIALIZED (SELECT q_rid, e_rid, v, ln(((SELECT count(*) FROM rec WHERE src = 1) + 1) / (coalesce(df, 0) + 1)) AS idf, CASE WHEN list_contains(ks, k) THEN 100.0 ELSE r END AS s FROM {side}_k JOIN {side}_b ON a = v AND b = ot LEFT JOIN skdf ON skdf.sk = k),
f{side} AS MATERIALIZED (SELECT q_rid, e_rid, sum(CASE WHEN s < 75 THEN 1 ELSE 0 END) AS un, sum(CASE WHEN s < 75 THEN idf ELSE 0 END) AS unidf, sum(CASE WHEN s < 75 THEN idf ELSE 0 END) / greatest(sum(idf), 1e-6) AS unfrac, max(CASE WHEN s < 75 THEN length(v) ELSE 0 END) AS unlen, min(s) AS worst FROM {side}_s GROUP BY ALL)"""


def _rated_sql(side: str, extra: str) -> str:
    """CTE x{side}: least and greatest rate of a side's extra words, and how many have none."""
    return f"x{side} AS MATERIALIZED (SELECT q_rid, e_rid, coalesce(min(rate), -1) AS lo, coalesce(max(rate), -1) AS hi, sum(CASE WHEN rate IS NULL THEN 1 ELSE 0 END) AS unk FROM (SELECT q_rid, e_rid, unnest({extra}) AS w FROM signed) LEFT JOIN (SELECT * FROM wrates WHERE side = '{side}') USING (w) GROUP BY q_rid, e_rid)"


def _fine_sql() -> str:
    """All fine features of scored pairs; the fixture's names hold their legal words."""
    among = lambda w, these: f"list_distinct(list_filter({w}, lambda v: v IN ({these})))"
    legal, titles = ", ".join(map(sql_text, sorted({*t.LEGAL, *t.LEGAL_EXTRA}))), ", ".join(map(sql_text, t.TITLES))
    extra, short = ", ".join(map(sql_text, t.LEGAL_EXTRA)), "list_transform(list_filter({n}, lambda v: length(v) < 10), lambda v: CAST(v AS BIGINT))"
    without = lambda a, b: f"len(list_filter({a}, lambda w: NOT list_contains({b}, w)))"
    more = ",\n".join(
        [
            _SIGNED, f"sigs AS MATERIALIZED ({_SIG_RATES})",
            "ex_q AS MATERIALIZED (SELECT y, unnest(xq) AS w FROM px WHERE len(xe) = 0), ex_e AS MATERIALIZED (SELECT y, unnest(xe) AS w FROM px WHERE len(xq) = 0)",
            "wrates AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT w, '{k}' AS side, (ys + 20 * (SELECT avg(y) FROM ex_{k})) / (n + 20) AS rate FROM (SELECT w, count(*) AS n, sum(y) AS ys FROM ex_{k} GROUP BY w HAVING count(*) >= 3)" for k in "qe") + ")",
            "skdf AS MATERIALIZED (SELECT sk, count(*) AS df FROM (SELECT unnest(list_distinct(sk)) AS sk FROM rsk WHERE src = 1) GROUP BY sk)",
            f"kept AS MATERIALIZED (SELECT *, list_filter(tq, lambda v: v NOT IN ({extra})) AS wq, list_filter(te, lambda v: v NOT IN ({extra})) AS we, {among('tq', legal)} AS gq, {among('te', legal)} AS ge, {among('tq', titles)} AS hq, {among('te', titles)} AS he, {short.format(n='nq')} AS iq, {short.format(n='ne')} AS ie FROM signed)",
            _aligned_sql("q", "wq", "we"), _aligned_sql("e", "we", "wq"), _rated_sql("q", "xq"), _rated_sql("e", "xe"),
        ]
    )
    edit = lambda c: f"CASE WHEN a IS NULL OR b IS NULL THEN -1 ELSE CAST({c} AS DOUBLE) END"
    gap = lambda c: f"CASE WHEN len(iq) = 0 OR len(ie) = 0 THEN -1 ELSE CAST({c} AS DOUBLE) END"
    flag = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
    value = {
        **{f"f{k}_{c}": f"coalesce(f{k}.{c}, {100 if c == 'worst' else 0})" for k in "qe" for c in fine.ALIGN},
        "f_first_eq": flag(f"len(wq) > 0 AND len(we) > 0 AND (wq[1] = we[1] OR {sql_skeleton('wq[1]')} = {sql_skeleton('we[1]')})"),
        "f_legal_qonly": without("gq", "ge"), "f_legal_eonly": without("ge", "gq"), "f_title_diff": f"{without('hq', 'he')} + {without('he', 'hq')}", "f_title_shared": flag("list_has_any(hq, he)"),
        "f_hn_eq": gap("iq[1] = ie[1]"), "f_hn_dmin": gap("ln(1 + list_min(list_transform(ie, lambda v: abs(v - iq[1]))))"), "f_hn_dfirst": gap("ln(1 + abs(iq[1] - ie[1]))"),
        "f_num_eonly": f"CASE WHEN len(iq) = 0 OR len(ie) = 0 THEN len(ie) ELSE len({_EXCEPT.format(a='ie', b='iq')}) END",
        "f_hn_ed": edit("levenshtein(a, b)"), "f_hn_led": edit("list_min(list_transform(ne, lambda v: levenshtein(a, v)))"), "f_hn_drop": edit("abs(length(a) - length(b)) = 1 AND levenshtein(a, b) = 1"),
        "f_hn_1dig": edit("length(a) = length(b) AND levenshtein(a, b) = 1"), "f_hn_shift": edit("levenshtein(a, b) > 1 AND length(a) < 10 AND length(b) < 10 AND abs(TRY_CAST(a AS BIGINT) - TRY_CAST(b AS BIGINT)) <= 20"),
        "f_hn_swap": edit(f"a <> b AND {_swapped('a', 'b')}"),
        **{f"f_x{k}_{c}": f"coalesce(x{k}.{v}, {0 if v == 'unk' else -1})" for k in "qe" for c, v in (("min", "lo"), ("max", "hi"), ("unk", "unk"))},
        "f_sig_rate": "coalesce(sf.rate, sc.rate, -1)", "f_sig_logn": "coalesce(ln(1 + sf.n), 0)", "f_sig2_rate": "coalesce(sc.rate, -1)",
    }
    joins = " ".join(f"LEFT JOIN {k}{s} ON {k}{s}.q_rid = p.q_rid AND {k}{s}.e_rid = p.e_rid" for k in "fx" for s in "qe")
    out = ", ".join(f"round(CAST({value[f]} AS DOUBLE), 6) AS {f}" for f in fine.FINE)
    return x.more_sql(more, f"SELECT p.q_rid, p.e_rid, {out} FROM kept p {joins} LEFT JOIN sigs sf ON sf.kind = 'fine' AND sf.sig = fine LEFT JOIN sigs sc ON sc.kind = 'coarse' AND sc.sig = coarse", "scores", "gt", "rsk")


@query(_fine_sql())
def fine_features(spark, sf):
    c = F.col
    sig = rates.signatures(c("tq"), c("te"), c("nq"), c("ne"), c("lq"), c("le"), c("cq"))
    pairs = settled(_labelled(spark, sf).select("tq", "te", "y", sig[0].alias("fine"), sig[1].alias("coarse")))
    words, signed = settled(rates.extra_word_rates(pairs, least=3)), settled(rates.signature_rates(pairs, least=3))
    found = fine.fine_features(x.scores(spark, sf), x.linkage_records(spark, sf), words, signed)
    return rounded(found, *fine.FINE)


@query(with_sql(f"SELECT q_rid, e_rid, CAST(len(tq) > 0 AND len(te) > 0 AND (tq[1] = te[1] OR {sql_skeleton('tq[1]')} = {sql_skeleton('te[1]')}) AS DOUBLE) AS first_eq FROM pw", "scores", "gt", "rwords").replace("\nSELECT q_rid, e_rid, CAST(len", f",\n{_PAIR_WORDS}\nSELECT q_rid, e_rid, CAST(len"))
def first_eq(spark, sf):
    a, b = F.get("tq", 0), F.get("te", 0)
    return _labelled(spark, sf).select("q_rid", "e_rid", F.coalesce(((a == b) | (n.skeleton(a) == n.skeleton(b))).cast("double"), F.lit(0.0)).alias("first_eq"))


@query(with_sql("SELECT q_rid, e_rid, array_to_string(list_sort(xq), ' ') AS xq, array_to_string(list_sort(xe), ' ') AS xe, y FROM px", "scores", "gt", "rwords").replace("\nSELECT q_rid, e_rid, array", f",\n{_PAIR_WORDS}\nSELECT q_rid, e_rid, array"))
def set_diff(spark, sf):
    text = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), " ")
    return _labelled(spark, sf).select("q_rid", "e_rid", text("tq", "te").alias("xq"), text("te", "tq").alias("xe"), "y")


_TITLES = ", ".join(map(sql_text, t.TITLES))


@query(with_sql(f"SELECT q_rid, e_rid, CAST(len(list_filter(a, lambda w: NOT list_contains(b, w))) + len(list_filter(b, lambda w: NOT list_contains(a, w))) AS BIGINT) AS diff, list_has_any(a, b) AS shared FROM (SELECT q_rid, e_rid, list_distinct(list_filter(tq, lambda w: w IN ({_TITLES}))) AS a, list_distinct(list_filter(te, lambda w: w IN ({_TITLES}))) AS b FROM pw)", "scores", "gt", "rwords").replace("\nSELECT q_rid, e_rid, CAST(len", f",\n{_PAIR_WORDS}\nSELECT q_rid, e_rid, CAST(len"))
def title_diff(spark, sf):
    p = _labelled(spark, sf).select("q_rid", "e_rid", fine.title_words(F.array_join("tq", " ")).alias("a"), fine.title_words(F.array_join("te", " ")).alias("b"))
    return p.select("q_rid", "e_rid", (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).cast("long").alias("diff"), F.arrays_overlap("a", "b").alias("shared"))


_VOTES = ", ".join(f"round({c}, 6) AS {c}" for c in ("nb_v1", "nb_vmax", "nb_vw", "nb_vsum", "nb_nv"))


@query(with_sql(f"SELECT q_rid, e_rid, {_VOTES} FROM votes", "votes"))
def nb_votes(spark, sf):
    return rounded(graph.votes(x.links(spark, sf), x.scores(spark, sf)), "nb_v1", "nb_vmax", "nb_vw", "nb_vsum", "nb_nv")


@query(with_sql("SELECT q_rid, e_rid FROM (SELECT v.q_rid, v.e_rid, row_number() OVER (PARTITION BY v.q_rid ORDER BY nb_vw DESC, v.e_rid) AS r FROM votes v ANTI JOIN scores s ON s.q_rid = v.q_rid AND s.e_rid = v.e_rid WHERE nb_vw >= 0.05) WHERE r <= 2", "votes"))
def nb_propose(spark, sf):
    s = x.scores(spark, sf)
    return graph.propose(graph.votes(x.links(spark, sf), s), s, least=0.05)


@query(with_sql("""SELECT q_rid, e_rid, CAST(count(*) AS DOUBLE) AS nb_nclose, CAST(sum(CASE WHEN hr = he AND he <> '' THEN 1 ELSE 0 END) AS DOUBLE) AS nb_hn_e, CAST(sum(CASE WHEN hr = hq AND hq <> '' THEN 1 ELSE 0 END) AS DOUBLE) AS nb_hn_q,
round(avg(len(list_filter(xq, lambda w: list_contains(tr, w))) / greatest(len(xq), 1)), 6) AS nb_xq, round(avg(len(list_filter(xe, lambda w: list_contains(tr, w))) / greatest(len(xe), 1)), 6) AS nb_xe
FROM (SELECT s.q_rid, s.e_rid, q.hn AS hq, e.hn AS he, r.hn AS hr, r.tk AS tr, list_distinct(list_filter(q.tk, lambda w: NOT list_contains(e.tk, w))) AS xq, list_distinct(list_filter(e.tk, lambda w: NOT list_contains(q.tk, w))) AS xe
FROM scores s JOIN keys q ON q.rid = s.q_rid JOIN keys e ON e.rid = s.e_rid JOIN links l ON l.q_rid = s.q_rid AND l.s >= 0.1 JOIN keys r ON r.rid = l.r_rid) GROUP BY ALL""", "scores", "links", "keys"))
def nb_consensus(spark, sf):
    found = graph.consensus(x.scores(spark, sf), x.links(spark, sf), graph.keys(x.linkage_records(spark, sf)), close=0.1)
    return rounded(found, "nb_xq", "nb_xe")


@query(with_sql("""SELECT q_rid, e_rid, round(v - CASE WHEN v = m1 AND n1 = 1 THEN m2 ELSE m1 END, 6) AS nb_vgap FROM (SELECT *, sum(CASE WHEN v = m1 THEN 1 ELSE 0 END) OVER (PARTITION BY q_rid) AS n1, coalesce(max(CASE WHEN v < m1 THEN v END) OVER (PARTITION BY q_rid), 0) AS m2
FROM (SELECT s.q_rid, s.e_rid, coalesce(nb_vw, 0) AS v, max(coalesce(nb_vw, 0)) OVER (PARTITION BY s.q_rid) AS m1 FROM scores s LEFT JOIN votes b ON b.q_rid = s.q_rid AND b.e_rid = s.e_rid))""", "scores", "votes"))
def nb_gap(spark, sf):
    s = x.scores(spark, sf)
    return rounded(graph.graph_features(x.links(spark, sf), s, s, x.linkage_records(spark, sf)).select("q_rid", "e_rid", "nb_vgap"), "nb_vgap")


@query(with_sql("SELECT q_rid, e_rid, round(p, 6) AS p FROM best WHERE p >= 0.3", "best"))
def assign_threshold(spark, sf):
    return rounded(decide.assign(x.scores(spark, sf), 0.3), "p")


#: The exact expectation: distributions of matches among the first k and the rest, grown one probability an iteration.
_DECIDE = """top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY e_rid ORDER BY p DESC, q_rid) AS r FROM best WHERE p >= 0.02),
ps AS MATERIALIZED (SELECT e_rid, list(p ORDER BY r) AS p, count(*) AS m FROM top GROUP BY e_rid),
head(e_rid, i, d) AS (SELECT e_rid, 0, [1.0::DOUBLE] FROM ps UNION ALL SELECT h.e_rid, i + 1, list_transform(range(1, i + 3), lambda a: coalesce(d[a], 0) * (1 - ps.p[i + 1]) + CASE WHEN a > 1 THEN d[a - 1] * ps.p[i + 1] ELSE 0 END) FROM head h JOIN ps ON ps.e_rid = h.e_rid WHERE i < m),
tail(e_rid, i, d) AS (SELECT e_rid, m, [1.0::DOUBLE] FROM ps UNION ALL SELECT t.e_rid, i - 1, list_transform(range(1, m - i + 3), lambda a: coalesce(d[a], 0) * (1 - ps.p[i]) + CASE WHEN a > 1 THEN d[a - 1] * ps.p[i] ELSE 0 END) FROM tail t JOIN ps ON ps.e_rid = t.e_rid WHERE i > 0),
ef AS MATERIALIZED (SELECT h.e_rid, h.i AS k, CASE WHEN h.i = 0 THEN t.d[1] ELSE list_sum(flatten(list_transform(range(1, len(h.d) + 1), lambda a: list_transform(range(1, len(t.d) + 1), lambda b: h.d[a] * t.d[b] * 1.25 * (a - 1) / (0.25 * (a + b - 2) + h.i))))) END AS f FROM head h JOIN tail t ON t.e_rid = h.e_rid AND t.i = h.i),
kk AS MATERIALIZED (SELECT e_rid, k FROM (SELECT *, row_number() OVER (PARTITION BY e_rid ORDER BY round(f, 12) DESC, k) AS r FROM ef) WHERE r = 1)
"""


@query(with_sql("SELECT q_rid, e_rid, round(p, 6) AS p FROM top JOIN kk USING (e_rid) WHERE r <= k", "best").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT q_rid, e_rid, round(p, 6)", f",\n{_DECIDE}\nSELECT q_rid, e_rid, round(p, 6)"))
def expected_f_decision(spark, sf):
    return rounded(decide.decide(x.scores(spark, sf)), "p")


_PRED = "pred AS MATERIALIZED (SELECT q_rid, e_rid, p FROM best WHERE p >= 0.3)"
_F05 = """SELECT rid AS e_rid, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM (SELECT rid FROM rec WHERE src = 1)
LEFT JOIN (SELECT e_rid AS rid, count(*) AS np FROM {pred} GROUP BY ALL) USING (rid) LEFT JOIN (SELECT true_e AS rid, count(*) AS nt FROM gt GROUP BY ALL) USING (rid)
LEFT JOIN (SELECT p.e_rid AS rid, count(*) AS tp FROM {pred} p JOIN gt ON gt.q_rid = p.q_rid AND true_e = p.e_rid GROUP BY ALL) USING (rid)"""
_F = "CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END"


@query(with_sql(f"SELECT round(avg({_F}), 9) AS f05 FROM ({_F05.format(pred='pred')})", "best", "gt").replace("\nSELECT round(avg", f",\n{_PRED}\nSELECT round(avg"))
def macro_f05(spark, sf):
    e = x.rec(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    return rounded(metrics.macro_f05(decide.assign(x.scores(spark, sf), 0.3), x.gt(spark, sf), e), "f05", digits=9)


@query(with_sql("SELECT k, round(avg(CASE WHEN coalesce(br_f, 99) <= k THEN 1.0 ELSE 0.0 END), 9) AS r_full, round(avg(CASE WHEN coalesce(br_n, 99) <= k THEN 1.0 ELSE 0.0 END), 9) AS r_name, round(avg(CASE WHEN least(coalesce(br_f, 99), coalesce(br_n, 99)) <= k THEN 1.0 ELSE 0.0 END), 9) AS r_any FROM gt LEFT JOIN cand c ON c.q_rid = gt.q_rid AND e_rid = true_e, (SELECT unnest([1, 2, 3, 5, 10, 20]) AS k) GROUP BY k", "gt", "cand"))
def recall_at_k(spark, sf):
    return rounded(metrics.recall_at_k(x.cand(spark, sf), x.gt(spark, sf)), "r_full", "r_name", "r_any", digits=9)


@query(with_sql(f"SELECT t / 100 AS thr, round(avg({_F}), 9) AS f05 FROM (SELECT t, rid, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM (SELECT rid, unnest(range(20, 96, 5)) AS t FROM rec WHERE src = 1) LEFT JOIN (SELECT t, e_rid AS rid, count(*) AS np, count(true_e) AS tp FROM (SELECT unnest(range(20, 96, 5)) AS t) JOIN best ON p >= t / 100 LEFT JOIN gt ON gt.q_rid = best.q_rid AND true_e = e_rid GROUP BY ALL) USING (t, rid) LEFT JOIN (SELECT true_e AS rid, count(*) AS nt FROM gt GROUP BY ALL) USING (rid)) GROUP BY t", "best", "gt"))
def threshold_sweep(spark, sf):
    e = x.rec(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    return rounded(metrics.threshold_sweep(x.scores(spark, sf), x.gt(spark, sf), e), "f05", digits=9)


_BUCKETS = """bk AS MATERIALIZED (SELECT q.q_rid, gt.true_e, pred.e_rid AS pred_e, CASE WHEN gt.true_e IS NULL AND pred.e_rid IS NULL THEN 'ok' WHEN pred.e_rid = gt.true_e THEN 'ok' WHEN gt.true_e IS NULL THEN 'confuser_matched' WHEN pred.e_rid IS NOT NULL THEN 'wrong_entity' WHEN c.q_rid IS NULL THEN 'blocking_miss' WHEN s.q_rid IS NULL THEN 'pruned_s1' WHEN best.e_rid <> gt.true_e THEN 'outranked_below_thr' ELSE 'below_thr' END AS bucket
FROM (SELECT rid AS q_rid FROM rec WHERE src <> 1) q LEFT JOIN gt ON gt.q_rid = q.q_rid LEFT JOIN pred ON pred.q_rid = q.q_rid LEFT JOIN cand c ON c.q_rid = q.q_rid AND c.e_rid = gt.true_e LEFT JOIN scores s ON s.q_rid = q.q_rid AND s.e_rid = gt.true_e LEFT JOIN best ON best.q_rid = q.q_rid)
"""


def _buckets(spark, sf):
    s, g = x.scores(spark, sf), x.gt(spark, sf)
    pred = decide.assign(s, 0.3)
    return pred, metrics.error_buckets(x.rec(spark, sf).where("src <> 1").select(F.col("rid").alias("q_rid")), g, s, x.cand(spark, sf), pred)


@query(with_sql("SELECT q_rid, true_e, pred_e, bucket FROM bk", "best", "gt", "cand", "scores").replace("\nSELECT q_rid, true_e", f",\n{_PRED},\n{_BUCKETS}\nSELECT q_rid, true_e"))
def error_buckets(spark, sf):
    return _buckets(spark, sf)[1]


@query(with_sql(f"SELECT round(avg({_F}), 9) AS f05 FROM ({_F05.format(pred='fixed')})", "best", "gt", "cand", "scores").replace("\nSELECT round(avg", f",\n{_PRED},\n{_BUCKETS}, fixed AS MATERIALIZED (SELECT q_rid, e_rid FROM pred WHERE q_rid NOT IN (SELECT q_rid FROM bk WHERE bucket = 'wrong_entity') UNION ALL SELECT q_rid, true_e FROM bk WHERE bucket = 'wrong_entity' AND true_e IS NOT NULL)\nSELECT round(avg"))
def repair_gain(spark, sf):
    pred, buckets = _buckets(spark, sf)
    e = x.rec(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    return rounded(metrics.macro_f05(metrics.repaired(pred, buckets, "wrong_entity"), x.gt(spark, sf), e), "f05", digits=9)


@query(with_sql("SELECT q_rid, e_rid, round(p, 6) AS p, q_rid AS orig FROM scores UNION ALL SELECT q_rid + (SELECT max(q_rid) + 1 FROM scores), e_rid, round(p, 6), q_rid FROM scores WHERE q_rid NOT IN (SELECT q_rid FROM gt)", "scores", "gt"))
def crowding_sim(spark, sf):
    return rounded(splits.with_copies(x.scores(spark, sf), x.gt(spark, sf), 1), "p")


_SHIFTS = "SELECT unnest([1.0, 0.7, 0.5, 0.35, 0.25])::DOUBLE AS r"
_SEARCH = f"""crowd AS MATERIALIZED (SELECT r, q_rid, e_rid, r * p / (r * p + 1 - p) AS p FROM (SELECT q_rid, e_rid, p FROM scores UNION ALL SELECT q_rid + (SELECT max(q_rid) + 1 FROM scores), e_rid, p FROM scores WHERE q_rid NOT IN (SELECT q_rid FROM gt)), ({_SHIFTS})),
picked AS MATERIALIZED (SELECT r, q_rid, e_rid FROM (SELECT *, row_number() OVER (PARTITION BY r, q_rid ORDER BY p DESC, e_rid) AS k FROM crowd) WHERE k = 1 AND p >= 0.3),
grid AS MATERIALIZED (SELECT r, round(avg({_F}), 12) AS f05 FROM (SELECT r, rid, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt, coalesce(tp, 0) AS tp FROM (SELECT rid, r FROM rec, ({_SHIFTS}) WHERE src = 1)
LEFT JOIN (SELECT r, p.e_rid AS rid, count(*) AS np, count(true_e) AS tp FROM picked p LEFT JOIN gt ON gt.q_rid = p.q_rid AND true_e = p.e_rid GROUP BY ALL) USING (r, rid) LEFT JOIN (SELECT true_e AS rid, count(*) AS nt FROM gt GROUP BY ALL) USING (rid)) GROUP BY r)"""


@query(x.more_sql(_SEARCH, "SELECT r, round(f05, 9) AS f05, row_number() OVER (ORDER BY f05 DESC, r DESC) = 1 AS chosen FROM grid", "scores", "gt"))
def prior_shift_grid(spark, sf):
    """The prior shift that does best on crowded scores."""
    e = x.rec(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    return rounded(metrics.prior_shift_search(x.scores(spark, sf), x.gt(spark, sf), e, lambda s: decide.assign(s, 0.3)), "f05", digits=9)


@query(with_sql("SELECT 'entity' AS kind, e_rid AS rid FROM held UNION ALL SELECT 'query', q_rid FROM hq UNION ALL SELECT 'train', q_rid FROM (SELECT DISTINCT q_rid FROM cand) WHERE q_rid NOT IN (SELECT q_rid FROM hq)", "cand", "gt").replace("\nSELECT 'entity'", ",\nheld AS MATERIALIZED (SELECT rid AS e_rid FROM rec WHERE src = 1 AND (((rid % 1000003) * 8003 + 4503347) % 1000003) % 100 < 10),\nhq AS MATERIALIZED (SELECT q_rid FROM gt WHERE true_e IN (SELECT e_rid FROM held) UNION SELECT q_rid FROM cand WHERE (br_f <= 2 OR br_n <= 1) AND e_rid IN (SELECT e_rid FROM held))\nSELECT 'entity'"))
def split_design(spark, sf):
    held, held_q, train_q = splits.split_design(x.rec(spark, sf).where("src = 1"), x.cand(spark, sf), x.gt(spark, sf), 10, 42)
    kind = lambda df, c, k: df.select(F.lit(k).alias("kind"), F.col(c).alias("rid"))
    return kind(held, "e_rid", "entity").unionByName(kind(held_q, "q_rid", "query")).unionByName(kind(train_q, "q_rid", "train"))


@query(with_sql("SELECT CAST(rid AS VARCHAR) AS source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM (SELECT rid FROM rec WHERE src = 1) LEFT JOIN (SELECT e_rid AS rid, string_agg(CAST(q_rid AS VARCHAR), ',' ORDER BY CAST(q_rid AS VARCHAR)) AS ids FROM best WHERE p >= 0.3 GROUP BY ALL) USING (rid)", "best"))
def match_lists(spark, sf):
    pred = decide.assign(x.scores(spark, sf), 0.3)
    e = x.rec(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    return joined_lists(pred, e, "e_rid", "q_rid", "matched_entity_ids").select(F.col("e_rid").cast("string").alias("source1_entity_id"), "matched_entity_ids")


_LEV = "1 - levenshtein({q}, {e}) / greatest(length({q}), length({e}), 1)"
_REPAIRED = f"""fresh AS MATERIALIZED (SELECT rec.rid, CASE WHEN country = 'fr' THEN coalesce(names.core, '') ELSE name END AS core, name AS old, country FROM rec LEFT JOIN names USING (rid)),
touched AS MATERIALIZED (SELECT DISTINCT c.q_rid FROM cand c JOIN rec q ON q.rid = c.q_rid JOIN rec e ON e.rid = c.e_rid WHERE q.country = 'fr' OR e.country = 'fr')"""


@query(x.more_sql(f"{CORES_SQL},\n{_REPAIRED}", f"SELECT c.q_rid, c.e_rid, round(CASE WHEN t.q_rid IS NULL THEN {_LEV.format(q='q.old', e='e.old')} ELSE {_LEV.format(q='q.core', e='e.core')} END, 6) AS p FROM cand c JOIN fresh q ON q.rid = c.q_rid JOIN fresh e ON e.rid = c.e_rid LEFT JOIN touched t ON t.q_rid = c.q_rid", "raw", "cand"))
def incremental_repair(spark, sf):
    """One country's records normalised anew, and the pairs that they touch scored again."""
    from kinlink.plans.repair import repair

    def score(pairs, records):
        side = lambda c: records.select(F.col("rid").alias(f"{c}_rid"), F.col("core").alias(c))
        p = 1 - F.levenshtein("q", "e") / F.greatest(F.length("q"), F.length("e"), F.lit(1))
        return pairs.join(side("q"), "q_rid").join(side("e"), "e_rid").select("q_rid", "e_rid", p.alias("p"))

    texts = x.raw(spark, sf).select("rid", F.col("business_name").alias("__name"), "business_address")
    rec = x.linkage_records(spark, sf).join(texts, "rid").withColumn("business_name", F.col("__name")).drop("__name")
    cand = x.cand(spark, sf)
    return rounded(repair(rec, cand, score(cand, rec), "fr", score)[1], "p")


#: Settings of the registered model queries, smaller than model.STAGE1 and model.STAGE2.
_SMALL = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3}


@query(None)
def gbt_stage1(spark, sf):
    """A first-stage model of planted pairs, on entities that it hasn't seen."""
    rows = x.planted_features(spark, sf)
    fitted = model.train(rows.where("fold <> 0"), feats.FEATURES, **_SMALL)
    return rounded(model.predict(fitted, rows.where("fold = 0")).select("q_rid", "e_rid", "y", "p"), "p")


_STAGE2 = ["p1", "q_gap", "q_max", "q_sum", "q_n10", "q_rank", "e_nwin_other", "e_psum", "e_rank", "e_pmax", "n_tset", "n_ratio", "cos_name", "cos_addr", "a_tset"]


@x.once("stage2_rows")
def _stage2_rows(spark, sf):
    """Second-stage rows: context of first-stage scores, which are out of fold."""
    first = settled(model.out_of_fold(x.planted_features(spark, sf), feats.FEATURES, 5, **_SMALL))
    context = context_of(first.select("q_rid", "e_rid", "y", "fold", "of", "p", "n_tset", "n_ratio", "cos_name", "cos_addr", "a_tset"))
    return context.withColumnRenamed("p", "p1")


@query(None)
def gbt_stage2_oof(spark, sf):
    """Second-stage scores of planted pairs, out of five folds of entities."""
    return rounded(model.out_of_fold(_stage2_rows(spark, sf), _STAGE2, 5, **_SMALL).select("q_rid", "e_rid", "y", "fold", "p"), "p")


@query(None)
def feature_importance(spark, sf):
    gains = model.importance(model.train(x.planted_features(spark, sf), feats.FEATURES, **_SMALL))
    return spark.createDataFrame(gains, "feature string, gain double")


def _held_out(spark, sf):
    """Entities of fold 0 and their truth."""
    e = splits.folds(x.planted(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid")), F.col("e_rid"), 5).where("fold = 0").select("e_rid")
    return e, x.planted_truth(spark, sf).join(e.withColumnRenamed("e_rid", "true_e"), "true_e", "left_semi")


@query(None)
def learning_curve(spark, sf):
    """The best F0.5 on held-out entities of models that learned from a share of the other queries."""
    rows, (e, g) = x.planted_features(spark, sf), _held_out(spark, sf)
    held, seen, out = rows.where("fold = 0"), rows.where("fold <> 0"), []
    for percent in (25, 50, 100):
        fitted = model.train(splits.sample(seen, "q_rid", percent, 3), feats.FEATURES, **_SMALL)
        sweep = metrics.threshold_sweep(model.predict(fitted, held).select("q_rid", "e_rid", "p"), g, e, 20, 95)
        out.append((percent, *sweep.agg(F.max_by("thr", "f05"), F.max("f05")).first()))
    return spark.createDataFrame(out, "percent int, thr double, f05 double")


@query(None)
def copy_check(spark, sf):
    """F0.5 of decisions by models that learned without and with copies of queries that match nothing, on rows without."""
    rows, truth = _stage2_rows(spark, sf), x.planted_truth(spark, sf)
    crowded = settled(splits.with_copies(rows, truth, 1))
    both = settled(model.copy_check(rows, crowded, _STAGE2, 5, **_SMALL))
    e = x.planted(spark, sf).where("src = 1").select(F.col("rid").alias("e_rid"))
    f = lambda p: metrics.macro_f05(decide.assign(both.select("q_rid", "e_rid", F.col(p).alias("p")), 0.5), truth, e).select(F.lit(p).alias("model"), "f05")
    return rounded(f("p_plain").unionByName(f("p_crowded")), "f05", digits=9)
