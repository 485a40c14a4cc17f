"""Queries that write with the sinks and read back with the sources, and on whole-table reshaping; with their SQL twins.

Everything is written below the shared folder, under a name of its own.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.operators import decide, rates, relational, splits
from kinlink.plans import fixtures as x
from kinlink.plans.fixtures import table, with_sql
from kinlink.sources import tables as s

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


_RAW_ROWS = "SELECT CAST(rid AS VARCHAR) AS entity_id, nullif(business_name, '') AS business_name, nullif(business_address, '') AS business_address, nullif(cty, '') AS country FROM raw"


@query(with_sql(_RAW_ROWS, "raw"))
def tsv_round_trip(spark, sf):
    """Records written as tab-separated text and scanned again: all strings, '' is null."""
    path = s.shared_path(spark, "tsv")
    s.write_tsv(x.raw(spark, sf).select(F.col("rid").cast("string").alias("entity_id"), "business_name", "business_address", F.col("cty").alias("country")), path)
    return s.read_tsv(spark, path, s.RAW)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_filtered(spark, sf):
    """A lazy scan: the filter and the columns reach the reader."""
    return table(spark, sf, "lineitem").where("l_quantity > 45 and l_returnflag = 'R'").select("l_orderkey", "l_linenumber", "l_quantity")


@query(with_sql("SELECT rid, src, country, name FROM rec", "rec"))
def scan_glob(spark, sf):
    """Parts of a table, read together by a pattern of their names."""
    path = s.shared_path(spark, "parts")
    s.write_parts(x.rec(spark, sf).select("rid", "src", "country", "name"), "rid", path, 5)
    return spark.read.parquet(f"{path}/rows/bucket=*").select("rid", "src", "country", "name")


@query(with_sql("SELECT rid, src, country, name, addr FROM rec", "rec"))
def sink_parquet(spark, sf):
    path = s.shared_path(spark, "records")
    s.write_table(x.rec(spark, sf), path)
    return spark.read.parquet(path)


@query(with_sql("SELECT rid, src FROM rec", "rec"))
def sink_parts(spark, sf):
    """A run that was stopped goes on: a part that is there stays, one that is missing is made."""
    path, rows = s.shared_path(spark, "resumed"), x.rec(spark, sf).select("rid", "src")
    s.write_parts(rows, "rid", path, 4)
    s.drop_part(spark, path, 2)
    return s.write_parts(rows, "rid", path, 4)


_LISTS = "SELECT CAST(rid AS VARCHAR) AS source1_entity_id, ids AS {name} FROM (SELECT rid FROM rec WHERE src = 1) LEFT JOIN (SELECT e_rid AS rid, string_agg(DISTINCT CAST(q_rid AS VARCHAR), ',' ORDER BY CAST(q_rid AS VARCHAR)) AS ids FROM {pairs} GROUP BY ALL) USING (rid)"


@query(with_sql(_LISTS.format(name="matched_entity_ids", pairs="best WHERE p >= 0.3"), "best"))
def sink_result_lists(spark, sf):
    path = s.shared_path(spark, "lists")
    s.write_lists(decide.assign(x.scores(spark, sf), 0.3), x.linkage_records(spark, sf), "matched_entity_ids", path)
    return s.read_tsv(spark, path, s.TRUTH)


@query(with_sql(_LISTS.format(name="candidate_entity_ids", pairs="cand"), "cand"))
def sink_candidate_lists(spark, sf):
    path = s.shared_path(spark, "candidates")
    s.write_lists(x.cand(spark, sf), x.linkage_records(spark, sf), "candidate_entity_ids", path)
    return s.read_tsv(spark, path)


@query("SELECT 0.35 AS thr, 'expected' AS rule, 0.5 AS shift, CAST(2 AS BIGINT) AS stage")
def config_round_trip(spark, sf):
    path = s.shared_path(spark, "config")
    s.save_config(spark, {"thr": 0.35, "rule": "expected", "shift": 0.5, "stage": 2}, path)
    c = s.load_config(spark, path)
    return spark.createDataFrame([(c["thr"], c["rule"], c["shift"], c["stage"])], "thr double, rule string, shift double, stage long")


@query("SELECT 1 AS k, count(*) AS n FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 2, count(*) FROM nation WHERE n_regionkey = 2")
def cached_by_parameters(spark, sf):
    """A table is made once for each set of parameters; other ones make another."""
    base, made = s.shared_path(spark, "cache"), []

    def of(k: int):
        def make():
            made.append(k)
            return table(spark, sf, "nation").where(F.col("n_regionkey") == k)

        return s.cached(make, spark, base, "nations", region=k).agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n")

    of(1)
    out = of(1).unionByName(of(2))
    if made != [1, 2]:
        raise AssertionError(f"made {made}")
    return out


@query("SELECT c_custkey, c_name AS before, upper(c_name) AS after FROM customer")
def backup_and_patch(spark, sf):
    """A copy is kept beside a table before it is patched; a patch that runs again keeps the first copy."""
    path = s.shared_path(spark, "patched")
    table(spark, sf, "customer").select("c_custkey", "c_name").write.parquet(path)
    for _ in range(2):
        copy = s.backup(spark, path, "backup")
        s.settled(spark.read.parquet(copy).withColumn("c_name", F.upper("c_name"))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(copy).select("c_custkey", F.col("c_name").alias("before")).join(spark.read.parquet(path).select("c_custkey", F.col("c_name").alias("after")), "c_custkey")


@query("SELECT o_orderkey, o_totalprice, CAST(o_orderkey // 4000 AS INTEGER) AS part FROM orders")
def read_by_id_range(spark, sf):
    """The table in ranges of its key, each read by itself."""
    last = table(spark, sf, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    parts = [s.id_range(table(spark, sf, "orders"), "o_orderkey", at, at + 4000).select("o_orderkey", "o_totalprice", F.lit(at // 4000).alias("part")) for at in range(0, last + 1, 4000)]
    return relational.union_ragged(*parts)


@query("SELECT chunk, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM (SELECT c_custkey, (row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1) // 64 AS chunk FROM customer) GROUP BY chunk")
def chunks_of_rows(spark, sf):
    rows = relational.chunked(table(spark, sf, "customer"), ["c_mktsegment", "c_custkey"], 64)
    return rows.groupBy("chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"), F.max("c_custkey").alias("last"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY ((o_orderkey % 1000003) * (2 * 11 + 7919) + 104729 * 12) % 1000003, o_orderkey) - 1 AS BIGINT) AS place FROM orders")
def seeded_shuffle(spark, sf):
    return splits.shuffled(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=11).select("o_orderkey", F.col("place").cast("long").alias("place"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS DOUBLE) AS l_linenumber, CAST(l_quantity AS BIGINT) AS l_quantity, CAST(NULL AS VARCHAR) AS note FROM lineitem")
def schema_cast(spark, sf):
    """Columns of a given schema, in its order and types; those that are missing are null."""
    want = T.StructType([T.StructField("l_orderkey", T.StringType()), T.StructField("l_linenumber", T.DoubleType()), T.StructField("l_quantity", T.LongType()), T.StructField("note", T.StringType())])
    return relational.cast_to(table(spark, sf, "lineitem"), want)


@query("SELECT a.n_nationkey AS n_nationkey_q, a.n_name AS n_name_q, b.n_nationkey AS n_nationkey_e, b.n_name AS n_name_e FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def rename_by_suffix(spark, sf):
    n = table(spark, sf, "nation")
    q, e = relational.suffixed(n, "_q"), relational.suffixed(n, "_e")
    return q.join(e, (F.col("n_regionkey_q") == F.col("n_regionkey_e")) & (F.col("n_nationkey_q") < F.col("n_nationkey_e"))).drop("n_regionkey_q", "n_regionkey_e")


@query(with_sql("SELECT rid, string_agg(coalesce(CAST(df AS VARCHAR), '-'), ' ' ORDER BY i) AS dfs FROM (SELECT rid, unnest(nw) AS w, unnest(range(1, len(nw) + 1)) AS i FROM rwords) LEFT JOIN (SELECT w, count(*) AS df FROM (SELECT unnest(list_distinct(nw)) AS w FROM rwords WHERE src = 1) GROUP BY w) USING (w) GROUP BY rid", "rwords"))
def join_in_order(spark, sf):
    """The words of a name looked up in a table of frequencies, in the order in which they stand."""
    r = x.rec(spark, sf)
    words = F.filter(F.split("name", " "), lambda w: w != "")
    df = r.where("src = 1").select(F.explode(F.array_distinct(words)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    found = relational.join_in_order(r.select("rid", words.alias("ws")), "rid", "ws", df, "w", "df")
    return found.select("rid", F.array_join("df", " ", "-").alias("dfs"))


@query("SELECT * FROM (SELECT l_suppkey, l_returnflag, count(*) AS n, round((sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) + 20 * (SELECT avg(CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0 END) FROM lineitem)) / (count(*) + 20), 6) AS rate FROM lineitem GROUP BY ALL HAVING count(*) >= 20)")
def rates_round_trip(spark, sf):
    """Fitted rates, kept as a table and read again."""
    path = s.shared_path(spark, "rates")
    rows = table(spark, sf, "lineitem").withColumn("y", (F.col("l_linestatus") == "F").cast("int"))
    s.write_table(rates.smoothed_rate(rows, ["l_suppkey", "l_returnflag"]), path)
    return spark.read.parquet(path).withColumn("rate", F.round("rate", 6))
