"""Queries on normalisation and tokens, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinlink.functions import tables as t
from kinlink.functions import textnorm as n
from kinlink.operators import fine, simjoin
from kinlink.operators.features import native_script
from kinlink.operators.relational import dense_rid
from kinlink.operators.tokens import pairs, tokenize
from kinlink.plans import fixtures as x
from kinlink.plans.fixtures import sql_ascii, sql_case, sql_clean, sql_replace, sql_skeleton, sql_text, sql_words, table, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


_CORE_SQL = """CASE WHEN len(core) > 0 THEN core WHEN len(rest) > 0 THEN rest ELSE w END"""
_DROPPED = ", ".join(map(sql_text, sorted({*t.LEGAL, *t.STOP, *t.HONORIFIC})))
_LEGAL_KEYS = ", ".join(map(sql_text, sorted({n.skeleton_of(w) for w in t.LEGAL_SPELLINGS})))
_STOP = ", ".join(map(sql_text, t.STOP))
_NAME_SQL = f"SELECT rid, {sql_clean(sql_replace(sql_replace(sql_ascii('business_name'), chr(92) + '.', ' '), t.WEB, ' ' + chr(92) + '1 '))} AS s FROM raw"


@query(f"SELECT doc_id, {sql_clean(sql_ascii('text'))} AS clean FROM documents")
def norm_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", n.clean(n.to_ascii(F.col("text"))).alias("clean"))


@query(f"SELECT p_partkey, array_to_string(list_transform({sql_words('lower(p_name)')}, lambda w: {sql_skeleton('w')}), ' ') AS key FROM part")
def norm_skeleton(spark, sf):
    return table(spark, sf, "part").select("p_partkey", n.each_word(F.lower("p_name"), n.skeleton).alias("key"))


@query(f"SELECT page_id, {sql_replace(sql_replace(sql_replace('lower(url)', '[^a-z0-9.]', ' '), chr(92) + '.', ' '), t.WEB, ' ' + chr(92) + '1 ')} AS name FROM pages")
def norm_web_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", n.web_strip(F.regexp_replace(F.lower("url"), "[^a-z0-9.]", " ")).alias("name"))


@query(with_sql(f"SELECT rid, array_to_string({_CORE_SQL}, ' ') AS core FROM (SELECT rid, w, list_filter(w, lambda v: v NOT IN ({_DROPPED}) AND NOT (length(v) > 3 AND {sql_skeleton('v')} IN ({_LEGAL_KEYS}))) AS core, list_filter(w, lambda v: v NOT IN ({_STOP})) AS rest FROM (SELECT rid, {sql_words('s')} AS w FROM ({_NAME_SQL})))", "raw"))
def norm_legal_strip(spark, sf):
    name = n.clean(n.web_strip(n.to_ascii(F.col("business_name"))))
    return x.raw(spark, sf).select("rid", n.strip_legal(name).alias("core"))


KIND_SQL = "CASE " + " ".join(
    f"WHEN list_has_any(w, {x.sql_list(tells)})" + (f" OR list_contains(list_transform(w, lambda v: {sql_skeleton('v')}), 'prvt')" if kind == "pvt" else "") + f" THEN '{kind}'" for kind, tells in t.LEGAL_KINDS
) + " ELSE '' END"


@query(with_sql(f"SELECT rid, {KIND_SQL} AS legal FROM (SELECT rid, {sql_words('s')} AS w FROM ({_NAME_SQL}))", "raw"))
def norm_legal_kind(spark, sf):
    name = n.clean(n.web_strip(n.to_ascii(F.col("business_name"))))
    return x.raw(spark, sf).select("rid", n.legal_kind(n.words(name)).alias("legal"))


@query(with_sql(f"SELECT rid, array_to_string(list_filter(list_transform(regexp_split_to_array(s, {sql_text(t.AKA)}), lambda p: trim(p)), lambda p: p <> ''), '|') AS parts FROM ({_NAME_SQL})", "raw"))
def norm_aka_split(spark, sf):
    name = n.clean(n.web_strip(n.to_ascii(F.col("business_name"))))
    return x.raw(spark, sf).select("rid", F.array_join(n.aka_parts(name), "|").alias("parts"))


_PARTS_SQL = f"list_filter(list_transform(regexp_split_to_array({sql_ascii('business_address')}, '[,;|]'), lambda c: {sql_clean('c')}), lambda c: c <> '')"


@query(with_sql(f"SELECT rid, array_to_string({_PARTS_SQL}, '|') AS parts FROM raw", "raw"))
def addr_components(spark, sf):
    return x.raw(spark, sf).select("rid", F.array_join(n.components(F.col("business_address")), "|").alias("parts"))


_EXACT, _SOUND, _FRANCE = n.state_tables()


def _state_sql(c: str, cty: str) -> str:
    other = f"coalesce({sql_case(f'''{cty} || ',' || {c}''', _EXACT, 'NULL')}, {sql_case(f'''concat('*,', {c})''', _EXACT, 'NULL')}, CASE WHEN length({c}) > 3 THEN {sql_case('sk', _SOUND, 'NULL')} END)"
    return f"CASE WHEN {c} = '' THEN NULL WHEN {cty} = 'france' THEN {sql_case(c, _FRANCE, 'NULL')} ELSE {other} END"


@query(with_sql(f"SELECT rid, part, coalesce({_state_sql('part', 'cty')}, '') AS state FROM (SELECT rid, cty, part, {sql_skeleton('flat')} AS sk FROM (SELECT rid, lower(cty) AS cty, part, replace(part, ' ', '') AS flat FROM (SELECT rid, cty, unnest({_PARTS_SQL}) AS part FROM raw)))", "raw"))
def addr_state_lookup(spark, sf):
    parts = x.raw(spark, sf).select("rid", F.lower("cty").alias("cty"), F.explode(n.components(F.col("business_address"))).alias("part"))
    return parts.select("rid", "part", F.coalesce(n.state_of(F.col("part"), F.col("cty")), F.lit("")).alias("state"))


#: Every name of a record in order, with its words that count.
CORES_SQL = f"""ns AS MATERIALIZED (SELECT rid, s, list_filter(list_transform(regexp_split_to_array(s, {sql_text(t.AKA)}), lambda p: trim(p)), lambda p: p <> '') AS ps FROM ({_NAME_SQL})),
np AS MATERIALIZED (SELECT rid, s, unnest(CASE WHEN len(ps) = 0 THEN [''] ELSE ps END) AS p, unnest(range(1, greatest(len(ps), 1) + 1)) AS i FROM ns),
nw AS MATERIALIZED (SELECT rid, s, i, {sql_words('p')} AS w FROM np),
nc AS MATERIALIZED (SELECT rid, s, i, w, list_filter(w, lambda v: v NOT IN ({_DROPPED}) AND NOT (length(v) > 3 AND {sql_skeleton('v')} IN ({_LEGAL_KEYS}))) AS core, list_filter(w, lambda v: v NOT IN ({_STOP})) AS rest FROM nw),
nk AS MATERIALIZED (SELECT rid, s, list(array_to_string({_CORE_SQL}, ' ') ORDER BY i) AS cores FROM nc GROUP BY ALL),
names AS MATERIALIZED (SELECT rid, s AS name_full, cores[len(cores)] AS core, CASE WHEN len(cores) > 1 THEN cores[1] ELSE '' END AS alt FROM nk)"""


@query(x.more_sql(CORES_SQL, f"SELECT rid, name_full, core, array_to_string(list_transform({sql_words('core')}, lambda v: {sql_skeleton('v')}), ' ') AS core_sk, alt, {KIND_SQL} AS legal FROM (SELECT *, {sql_words('name_full')} AS w FROM names)", "raw"))
def name_parts(spark, sf):
    return x.raw(spark, sf).select("rid", n.name_parts(F.col("business_name")).alias("p")).select("rid", "p.*")


#: Components of addresses in order with the state that each tells, and their words as they count.
_ADDRESS_SQL = f"""ac AS MATERIALIZED (SELECT rid, lower(cty) AS cty, unnest(parts) AS part, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT rid, cty, {_PARTS_SQL} AS parts FROM raw)),
ad AS MATERIALIZED (SELECT *, {_state_sql('part', 'cty')} AS st FROM (SELECT *, {sql_skeleton('flat')} AS sk FROM (SELECT *, replace(part, ' ', '') AS flat FROM ac))),
aw AS MATERIALIZED (SELECT rid, cty, i, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS j FROM (SELECT rid, cty, i, {sql_words('part')} AS w FROM ad WHERE st IS NULL)),
av AS MATERIALIZED (SELECT rid, cty, i, j, regexp_replace(v, '^([0-9]+)(st|nd|rd|th)$', '\\1') AS v FROM aw),
atok AS MATERIALIZED (SELECT rid, i, j, CASE WHEN regexp_matches(v, '^[0-9]+$') THEN regexp_replace(v, '^0+([0-9])', '\\1') WHEN cty = 'france' THEN {sql_case('v', t.ADDRESS_WORDS | t.ADDRESS_WORDS_FRANCE, 'v')} ELSE {sql_case('v', t.ADDRESS_WORDS, 'v')} END AS v FROM av),
an AS MATERIALIZED (SELECT rid, i, j, unnest(ds) AS d, unnest(range(1, len(ds) + 1)) AS k FROM (SELECT rid, i, j, regexp_extract_all(v, '([0-9]+)') AS ds FROM atok))"""


@query(x.more_sql(_ADDRESS_SQL, """SELECT rid, coalesce(addr, '') AS addr, coalesce(nums, '') AS nums, coalesce(state, '') AS state FROM raw LEFT JOIN (SELECT rid, string_agg(v, ' ' ORDER BY i, j) AS addr FROM atok GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, string_agg(regexp_replace(d, '^0+([0-9])', '\\1'), ' ' ORDER BY i, j, k) AS nums FROM an GROUP BY rid) USING (rid) LEFT JOIN (SELECT rid, arg_max(st, i) AS state FROM ad WHERE st IS NOT NULL GROUP BY rid) USING (rid)""", "raw"))
def addr_parts(spark, sf):
    return x.raw(spark, sf).select("rid", n.addr_parts(F.col("business_address"), F.col("cty")).alias("p")).select("rid", "p.addr", F.array_join("p.nums", " ").alias("nums"), "p.state")


@query("SELECT c_custkey, regexp_replace(regexp_extract(c_name, '([0-9]+)', 1), '^0+([0-9])', '\\1') AS number FROM customer")
def addr_number_canon(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", n.canonical_number(F.regexp_extract("c_name", "([0-9]+)", 1)).alias("number"))


@query(with_sql(f"SELECT rid, CASE WHEN cty = 'france' THEN array_to_string(list_transform(w, lambda v: {sql_case('v', t.ADDRESS_WORDS | t.ADDRESS_WORDS_FRANCE, 'v')}), ' ') ELSE array_to_string(list_transform(w, lambda v: {sql_case('v', t.ADDRESS_WORDS, 'v')}), ' ') END AS addr FROM (SELECT rid, lower(cty) AS cty, {sql_words(sql_clean(sql_ascii('business_address')))} AS w FROM raw)", "raw"))
def addr_abbrev(spark, sf):
    return x.raw(spark, sf).select("rid", n.each_word(n.clean(n.to_ascii(F.col("business_address"))), lambda w: n.address_word(w, F.lower("cty"))).alias("addr"))


@query(with_sql(f"SELECT rid, array_to_string(list_transform(regexp_extract_all(business_address, '([0-9]+)'), lambda d: regexp_replace(d, '^0+([0-9])', '\\1')), ' ') AS nums FROM raw", "raw"))
def addr_embedded_digits(spark, sf):
    return x.raw(spark, sf).select("rid", F.array_join(n.numbers_in(F.col("business_address")), " ").alias("nums"))


@query(with_sql("SELECT rid, regexp_replace(w, '^([0-9]+)(st|nd|rd|th)$', '\\1') AS word FROM (SELECT rid, string_split(business_address, ' ')[1] AS w FROM raw)", "raw"))
def ordinal_strip(spark, sf):
    return x.raw(spark, sf).select("rid", n.ordinal_strip(F.get(F.split("business_address", " "), 0)).alias("word"))


@query("SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS BIGINT) AS rid FROM customer")
def dense_row_id(spark, sf):
    return dense_rid(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment", "c_custkey"]).select("c_custkey", F.col("rid").cast("long").alias("rid"))


@query("SELECT doc_id, trim(coalesce(lang, '')) AS country FROM documents")
def country_clean(spark, sf):
    return table(spark, sf, "documents").select("doc_id", n.country_clean(F.col("lang")).alias("country"))


@query(with_sql("SELECT rid, CAST(i - 1 AS BIGINT) AS pos, nw[i] AS w FROM (SELECT rid, nw, unnest(range(1, len(nw) + 1)) AS i FROM rwords)", "rwords"))
def tok_words(spark, sf):
    return x.rec(spark, sf).select("rid", F.posexplode(n.words(F.col("name"))).alias("pos", "w")).select("rid", F.col("pos").cast("long").alias("pos"), "w")


@query(with_sql("SELECT rid, unnest(p_sk) AS pair FROM rsk", "rsk"))
def tok_bigrams(spark, sf):
    r = x.rec(spark, sf).select("rid", F.transform(n.words(F.col("name")), n.skeleton).alias("sk"))
    return r.select("rid", F.explode(pairs(F.col("sk"))).alias("pair"))


@query(with_sql("SELECT rid, tok FROM tok_f", "tok_f"))
def tok_bag(spark, sf):
    return x.tokens(spark, sf)


_VIEW = "CASE WHEN split_part(tok, '|', 2) = 'a' AND split_part(tok, '|', 3)[1] = '#' THEN 'num' WHEN split_part(tok, '|', 2) IN ('n', 'm') THEN 'name' ELSE 'addr' END"


@query(with_sql(f"SELECT rid, tok, {_VIEW} AS view FROM tok_v", "tok_v"))
def tok_view(spark, sf):
    return x.views(spark, sf)


@query(with_sql("SELECT tok, df, round(ln((SELECT count(*) FROM rec WHERE src = 1) + 1.0) - ln(CAST(df AS DOUBLE)), 6) AS w FROM (SELECT tok, count(*) AS df FROM tok_v JOIN rec USING (rid) WHERE src = 1 GROUP BY tok)", "tok_v"))
def idf_vocab(spark, sf):
    r = x.linkage_records(spark, sf).where("src = 1")
    return simjoin.vocabulary(tokenize(r), simjoin.count_of(r), None).select("tok", "df", F.round("w", 6).alias("w"))


@query(with_sql("SELECT tok, count(*) AS df FROM tok_v JOIN rec USING (rid) WHERE src = 1 GROUP BY tok HAVING count(*) <= 20", "tok_v"))
def maxdf_cut(spark, sf):
    r = x.linkage_records(spark, sf).where("src = 1")
    return simjoin.vocabulary(tokenize(r), simjoin.count_of(r), 20).select("tok", "df")


@query(with_sql("SELECT rid, tok, round(x, 6) AS x FROM x_f", "x_f"))
def tfidf_norm(spark, sf):
    r = x.linkage_records(spark, sf)
    own = tokenize(r.where("src = 1"), raw=True)
    return simjoin.weighted(tokenize(r, raw=True), simjoin.vocabulary(own, simjoin.count_of(r.where("src = 1")))).select("rid", "tok", F.round("x", 6).alias("x"))


_VIEWVOC = f"vv AS MATERIALIZED (SELECT tok, {_VIEW} AS view, ln((SELECT count(*) FROM rec WHERE src = 1) + 1.0) - ln(CAST(count(*) AS DOUBLE)) AS w FROM tok_v JOIN rec USING (rid) WHERE src = 1 GROUP BY tok)"


@query(with_sql("SELECT rid, view, count(*) AS n, round(sum(w), 6) AS s, round(sqrt(sum(w * w)), 6) AS norm FROM tok_v JOIN vv USING (tok) GROUP BY rid, view", "tok_v").replace("\nSELECT rid, view", f",\n{_VIEWVOC}\nSELECT rid, view"))
def view_matrices(spark, sf):
    r = x.linkage_records(spark, sf)
    vocab = simjoin.vocabulary(tokenize(r.where("src = 1")), simjoin.count_of(r.where("src = 1")), None)
    return x.views(spark, sf).join(vocab, "tok").groupBy("rid", "view").agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("s"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


@query(with_sql("SELECT sk, count(*) AS df FROM (SELECT unnest(list_distinct(sk)) AS sk FROM rsk WHERE src = 1) GROUP BY sk", "rsk"))
def skel_df(spark, sf):
    return fine.skeleton_df(x.linkage_records(spark, sf).where("src = 1"))


@query(r"SELECT doc_id, regexp_matches(text, '[^\x{0000}-\x{024F}]') AS native FROM documents")
def native_script_flag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", native_script(F.col("text")).alias("native"))


_LEGAL_WORDS = ", ".join(map(sql_text, sorted({*t.LEGAL, *t.LEGAL_EXTRA})))


@query(with_sql(f"SELECT rid, array_to_string(list_sort(list_distinct(list_filter(w, lambda v: v IN ({_LEGAL_WORDS})))), ' ') AS legal, array_to_string(list_sort(list_distinct(list_filter(w, lambda v: v IN ({', '.join(map(sql_text, t.TITLES))})))), ' ') AS titles FROM (SELECT rid, regexp_extract_all(s, '([a-z0-9]+)') AS w FROM ({_NAME_SQL}))", "raw"))
def legal_and_titles(spark, sf):
    name = n.clean(n.web_strip(n.to_ascii(F.col("business_name"))))
    return x.raw(spark, sf).select("rid", F.array_join(F.array_sort(fine.legal_words(name)), " ").alias("legal"), F.array_join(F.array_sort(fine.title_words(name)), " ").alias("titles"))
