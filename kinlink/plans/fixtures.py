"""Linkage records, ground truth and scores made of the driver's tables, in DataFrames and in SQL.

The tables have no business names, so a document's first six words stand for a name and the next ten for
an address; all documents are records. Records, candidates and links are settled once a session and folder of tables,
as the linkage pipeline settles them: the first query that needs them makes them.

Each view has two forms that must agree: a function of (spark, sf_dir), and a common table expression of
the same name for DuckDB. with_sql() puts the expressions that a query needs before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.functions import tables as t
from kinlink.functions import textnorm as n
from kinlink.operators import simjoin
from kinlink.operators.features import stage1_features
from kinlink.operators.splits import folds, hash_bucket, label
from kinlink.operators.tokens import indexed, name_marked, tokenize, view_of
from kinlink.sources.tables import settled, settled_alone

MARKED, PLAIN = "àâäáéèêëíîïóôöúûùüçñ", "aaaaeeeeiiiooouuuucn"
#: What is put after a record's name and before its address, by record (fixed values).
NAME_ENDS = ("private limited", "Inc.", "LLC dba Barfood's", "& Co", "aka Foo Traders", "SARL", "praivet limitet", "", ".com", "the", "null")
STATES = ("MH", "Texas", "new delhi", "Tamil Nadu", "Nord", "CA", "Miami", "somewhere", "")
COUNTRIES = ("US", "India", "France")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_settled: dict[tuple[str, str, str], DataFrame] = {}


def once(name: str):
    """Settles what a view makes, once a session and folder; tables that were settled on the way are removed."""

    def wrap(make):
        def view(spark: SparkSession, sf_dir: str) -> DataFrame:
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _settled:
                _settled[key] = settled_alone(lambda: make(spark, sf_dir))
            return _settled[key]

        view.__doc__ = make.__doc__
        return view

    return wrap


#: Characters that are letters or digits of a word once they are lower-cased and without marks.
_WORD = f"a-zA-Z0-9{MARKED}{MARKED.upper()}\u0130\u212A"


@once("rec")
def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, src, country, name (words 1 to 6 of the text) and addr (words 7 to 16)."""
    # the pattern ends after the sixteenth word: what follows isn't normalised
    head = F.regexp_extract(F.coalesce("text", F.lit("")), f"^[^{_WORD}]*+(?:[{_WORD}]++[^{_WORD}]*+){{0,16}}+", 0)
    text = F.translate(F.lower(head), MARKED, PLAIN)
    norm = F.trim(F.regexp_replace(F.regexp_replace(text, "[^a-z0-9 ]", " "), " +", " "))
    src = F.when(F.col("doc_id") % 3 == 0, 1).when(F.col("doc_id") % 3 == 1, 2).otherwise(3)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.split(norm, " ").alias("t")).select(
        F.col("doc_id").alias("rid"), src.alias("src"), F.col("lang").alias("country"), F.array_join(F.slice("t", 1, 6), " ").alias("name"), F.array_join(F.slice("t", 7, 10), " ").alias("addr")
    )


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rid, business_name, business_address, cty: texts with legal forms, numbers and states."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("rid") % len(values)).cast("int"))
    return rec(spark, sf_dir).select(
        "rid",
        F.concat("name", F.lit(" "), pick(NAME_ENDS)).alias("business_name"),
        F.concat(F.lpad(F.col("rid").cast("string"), 6, "0"), F.lit("th St, "), F.col("addr"), F.lit(" 0"), F.col("rid").cast("string"), F.lit("b; "), pick(STATES)).alias("business_address"),
        pick(COUNTRIES).alias("cty"),
    )


@once("linkage_records")
def linkage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec with the columns that the feature operators read."""
    r = rec(spark, sf_dir)
    number = F.filter(n.words(F.col("addr")), lambda w: w.rlike("^[0-9]+$"))
    return r.select(
        "rid", "src", "country", F.col("name").alias("business_name"), F.col("name").alias("name_full"), F.col("name").alias("core"),
        n.each_word(F.col("name"), n.skeleton).alias("core_sk"), n.legal_kind(n.words(F.col("name"))).alias("legal"), F.lit("").alias("alt"), "addr",
        F.array_join(number, " ").alias("nums"), F.lit("").alias("state"), F.col("rid").cast("string").alias("entity_id"),
    )


def gt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_rid, true_e): the first entity of the same name and address."""
    r = rec(spark, sf_dir)
    e = r.where("src = 1").groupBy("name", "addr").agg(F.min("rid").alias("true_e"))
    return r.where("src <> 1").join(e, ["name", "addr"]).select(F.col("rid").alias("q_rid"), "true_e")


#: How a planted query differs from its entity, by the entity's hash (fixed values).
_CHANGES = (
    ("name", lambda w: F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(1)))),
    ("name", lambda w: F.concat(F.slice(w, 2, 1), F.slice(w, 1, 1), F.slice(w, 3, 20))),
    ("name", lambda w: F.transform(w, lambda x, i: F.when(i == 0, F.concat(F.substring(x, 1, 1), F.substring(x, 3, 99))).otherwise(x))),
    ("name", lambda w: F.concat(w, F.array(F.lit("trading")))),
    ("addr", lambda w: F.slice(w, 2, 20)),
    ("addr", lambda w: F.slice(w, 1, 3)),
)


@once("planted")
def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for the models: entities of linkage_records, and two queries an entity, each changed in its own way.

    A tenth of the entities is left out of src 1, so their queries match nothing. of is a query's entity.
    """
    e = linkage_records(spark, sf_dir).where("src = 1")
    out = e.withColumn("of", F.col("rid")).where(hash_bucket(F.col("rid"), 10, 3) > 0)
    base = e.agg((F.max("rid") + 1).alias("base"))
    for k in (1, 2):
        q = e.crossJoin(F.broadcast(base)).withColumn("how", hash_bucket(F.col("rid"), len(_CHANGES), 50 + k))
        changed = {c: F.col(c) for c in ("name", "addr")}
        q = q.withColumn("name", F.col("core"))
        for at, (column, change) in enumerate(_CHANGES):
            text = F.array_join(F.filter(change(F.filter(F.split(column, " "), lambda w: w != "")), lambda w: w != ""), " ")
            changed[column] = F.when(F.col("how") == at, text).otherwise(changed[column])
        q = q.withColumns(changed)
        number = F.array_join(F.filter(n.words(F.col("addr")), lambda w: w.rlike("^[0-9]+$")), " ")
        own = (F.col("rid") + F.col("base") * k).alias("rid")
        q = q.select(
            own, F.lit(k + 1).alias("src"), "country", *[F.col("name").alias(c) for c in ("business_name", "name_full", "core")], n.each_word(F.col("name"), n.skeleton).alias("core_sk"),
            "legal", "alt", "addr", number.alias("nums"), "state", own.cast("string").alias("entity_id"), F.col("rid").alias("of"),
        )
        out = out.unionByName(q)
    return out


def planted_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_rid, true_e) of the planted queries whose entity is there."""
    r = planted(spark, sf_dir)
    return r.where("src <> 1").select(F.col("rid").alias("q_rid"), F.col("of").alias("true_e")).join(r.where("src = 1").select(F.col("rid").alias("true_e")), "true_e", "left_semi")


@once("planted_features")
def planted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-stage features of the planted candidates with y and a fold; a query's fold is that of its entity."""
    r = planted(spark, sf_dir)
    found = simjoin.candidates(lambda: settled(name_marked(tokenize(r, True, True, (indexed(),)))), r.where("src = 1"), r.where("src <> 1"))
    # joined while a row is a few figures: features are shuffled once, for their gaps
    own = label(settled(found), planted_truth(spark, sf_dir)).join(r.select(F.col("rid").alias("q_rid"), "of"), "q_rid")
    return stage1_features(settled(folds(own, F.col("of"), 5)), r, ("y", "of", "fold"))


def tokens(spark: SparkSession, sf_dir: str, with_addr: bool = True) -> DataFrame:
    return tokenize(linkage_records(spark, sf_dir), with_addr, raw=True)


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: q_rid, e_rid, bs_f, br_f, bs_n, br_n, made anew."""
    r = linkage_records(spark, sf_dir)
    return simjoin.candidates(lambda: settled(name_marked(tokenize(r, True, True, (indexed(),)))), r.where("src = 1"), r.where("src <> 1"))


#: The same, kept: most queries use them more than once.
cand = once("cand")(blocked)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_rid, e_rid, p): candidates of the full index, the cosine as probability."""
    return cand(spark, sf_dir).where("bs_f > 0").select("q_rid", "e_rid", F.col("bs_f").alias("p"))


@once("links")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q_rid, r_rid, s, r_rank): like records of each query."""
    r = linkage_records(spark, sf_dir)
    return simjoin.neighbours(settled(tokenize(r, True, False)), r.where("src <> 1"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(linkage_records(spark, sf_dir)).withColumn("view", view_of(F.col("tok")))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_replace(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, {sql_text(pattern)}, {sql_text(by)}, 'g')"


def sql_skeleton(w: str) -> str:
    """skeleton(); repeats are collapsed letter by letter, as the pattern language has no back reference."""
    s = w
    for pattern, by in t.SKELETON:
        s = sql_replace(s, pattern, by)
    for c in "bfgklnprstv0123456789":
        s = sql_replace(s, f"{c}{c}+", c)
    return f"CASE WHEN regexp_matches({w}, '^[0-9]+$') THEN {w} ELSE coalesce(nullif({s}, ''), {w}[1:2]) END"


def sql_words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def sql_case(value: str, table: dict[str, str], otherwise: str) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {sql_text(k)} THEN {sql_text(v)}" for k, v in table.items()) + f" ELSE {otherwise} END"


def sql_ascii(x: str) -> str:
    return sql_replace(f"translate(lower(coalesce({x}, '')), '{n.MARKED}', '{n.PLAIN}')", t.NULLISH, " ")


def sql_clean(x: str) -> str:
    s = sql_replace(sql_replace(x, "&", " and "), "['`]", "")
    return f"trim({sql_replace(sql_replace(s, '[^a-z0-9 ]+', ' '), ' +', ' ')})"


def sql_pairs(x: str) -> str:
    return f"list_transform(range(1, len({x})), lambda i: {x}[i] || '_' || {x}[i + 1])"


def _marked(kind: str, x: str) -> str:
    return f"list_transform({x}, lambda w: country || '|{kind}|' || w)"


def _token_sql(with_addr: bool, raw_words: bool, source: str = "rsk") -> str:
    parts = [_marked("n", "sk"), _marked("m", "p_sk"), "CASE WHEN len(sk) > 1 THEN [country || '|n|' || array_to_string(sk, '')] ELSE [] END"]
    parts += [_marked("a", "ak"), _marked("b", "p_ak")] if with_addr else []
    parts += [_marked("r", "nw"), _marked("s", "p_nw")] if raw_words else []
    return f"SELECT rid, unnest(list_distinct(flatten([{', '.join(parts)}]))) AS tok FROM {source}"


def _cosine_sql(tok: str, index: str, queries: str, k: int, tag: str, other: str = "") -> dict[str, tuple[str, ...]]:
    """Expressions voc_, x_ and top_ of a tag."""
    return {
        f"voc_{tag}": (tok, f"SELECT tok, count(*) AS df, ln((SELECT count(*) FROM rec WHERE {index}) + 1.0) - ln(CAST(count(*) AS DOUBLE)) AS w FROM {tok} JOIN rec USING (rid) WHERE {index} GROUP BY tok HAVING count(*) <= 3000"),
        f"x_{tag}": (f"voc_{tag}", f"SELECT rid, src, tok, w / coalesce(nullif(sqrt(sum(w * w) OVER (PARTITION BY rid)), 0), 1) AS x FROM {tok} JOIN voc_{tag} USING (tok) JOIN rec USING (rid)"),
        f"sim_{tag}": (f"x_{tag}", f"SELECT q.rid AS q_rid, e.rid AS e_rid, round(sum(q.x * e.x), 9) AS s FROM x_{tag} q JOIN x_{tag} e USING (tok) WHERE {queries} {other} GROUP BY ALL HAVING round(sum(q.x * e.x), 9) > 0.01"),
        f"top_{tag}": (f"sim_{tag}", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_rid ORDER BY s DESC, e_rid) AS r FROM sim_{tag}) WHERE r <= {k}"),
    }


#: name -> (names it needs …, text).
CTES: dict[str, tuple[str, ...]] = {
    "rec": (
        "SELECT doc_id AS rid, CASE doc_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS src, lang AS country, array_to_string(t[1:6], ' ') AS name, array_to_string(t[7:16], ' ') AS addr "
        f"FROM (SELECT doc_id, lang, string_split(trim({sql_replace(sql_replace(f'''translate(lower(coalesce(text, '')), '{MARKED}', '{PLAIN}')''', '[^a-z0-9 ]', ' '), ' +', ' ')}), ' ') AS t FROM documents)",
    ),
    "raw": (
        "rec",
        f"SELECT rid, name || ' ' || {sql_list(NAME_ENDS)}[rid % {len(NAME_ENDS)} + 1] AS business_name, lpad(CAST(rid AS VARCHAR), 6, '0') || 'th St, ' || addr || ' 0' || rid || 'b; ' || {sql_list(STATES)}[rid % {len(STATES)} + 1] AS business_address, {sql_list(COUNTRIES)}[rid % {len(COUNTRIES)} + 1] AS cty FROM rec",
    ),
    "gt": ("rec", "SELECT q.rid AS q_rid, true_e FROM rec q JOIN (SELECT name, addr, min(rid) AS true_e FROM rec WHERE src = 1 GROUP BY ALL) e USING (name, addr) WHERE q.src <> 1"),
    "rwords": (
        "rec",
        f"SELECT rid, src, country, name, addr, {sql_words('name')} AS nw, list_filter({sql_words('addr')}, lambda w: w NOT IN ({', '.join(map(sql_text, t.ADDRESS_GENERIC))})) AS aw FROM rec",
    ),
    "rsk0": (
        "rwords",
        f"SELECT rid, src, country, name, addr, nw, list_transform(nw, lambda w: {sql_skeleton('w')}) AS sk, list_transform(aw, lambda w: CASE WHEN regexp_matches(w, '^[0-9]+$') THEN '#' || w ELSE {sql_skeleton('w')} END) AS ak FROM rwords",
    ),
    "rsk": ("rsk0", f"SELECT *, {sql_pairs('sk')} AS p_sk, {sql_pairs('ak')} AS p_ak, {sql_pairs('nw')} AS p_nw FROM rsk0"),
    "tok_f": ("rsk", _token_sql(True, True)),
    "tok_n": ("rsk", _token_sql(False, True)),
    "tok_v": ("rsk", _token_sql(True, False)),
    **_cosine_sql("tok_f", "src = 1", "q.src <> 1 AND e.src = 1", 20, "f"),
    **_cosine_sql("tok_n", "src = 1", "q.src <> 1 AND e.src = 1", 10, "n"),
    "cand": (
        "top_f", "top_n",
        "SELECT coalesce(f.q_rid, n.q_rid) AS q_rid, coalesce(f.e_rid, n.e_rid) AS e_rid, coalesce(f.s, 0) AS bs_f, coalesce(f.r, 99) AS br_f, coalesce(n.s, 0) AS bs_n, coalesce(n.r, 99) AS br_n FROM top_f f FULL JOIN top_n n ON f.q_rid = n.q_rid AND f.e_rid = n.e_rid",
    ),
    "scores": ("cand", "SELECT q_rid, e_rid, bs_f AS p FROM cand WHERE bs_f > 0"),
    "best": ("scores", "SELECT q_rid, e_rid, p FROM (SELECT *, row_number() OVER (PARTITION BY q_rid ORDER BY p DESC, e_rid) AS r FROM scores) WHERE r = 1"),
    **_cosine_sql("tok_v", "src <> 1", "q.src <> 1 AND e.src <> 1", 5, "nb", "AND q.rid <> e.rid"),
    "links": ("top_nb", "SELECT q_rid, e_rid AS r_rid, s, r AS r_rank FROM top_nb"),
    "votes": (
        "links", "scores",
        "SELECT l.q_rid, e_rid, coalesce(max(CASE WHEN r_rank = 1 THEN p END), 0) AS nb_v1, max(p) AS nb_vmax, max(s * p) AS nb_vw, sum(s * p) AS nb_vsum, CAST(sum(CASE WHEN p > 0.5 THEN 1 ELSE 0 END) AS DOUBLE) AS nb_nv FROM links l JOIN scores c ON l.r_rid = c.q_rid GROUP BY ALL",
    ),
    "keys": (
        "rwords",
        f"SELECT rid, nw AS tk, coalesce(list_filter({sql_words('addr')}, lambda w: regexp_matches(w, '^[0-9]+$'))[1], '') AS hn FROM rwords",
    ),
}


def with_sql(query: str, *need: str) -> str:
    """query after the expressions that it needs, each once and in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for x in CTES[name][:-1]:
                visit(x)
            order.append(name)

    for name in need:
        visit(name)
    return "WITH " + ",\n".join(f"{name} AS MATERIALIZED ({CTES[name][-1]})" for name in order) + "\n" + query


def more_sql(more: str, query: str, *need: str, recursive: bool = False) -> str:
    """query after the expressions that it needs and those of `more`."""
    found = with_sql("", *need).rstrip() + f",\n{more}\n{query}"
    return found.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else found
