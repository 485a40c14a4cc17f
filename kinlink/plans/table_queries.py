"""Queries on joins, aggregates, windows, samples and set operations, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinlink.operators import rates, relational, splits, windows
from kinlink.operators.features import three_valued
from kinlink.plans import fixtures as x
from kinlink.plans.fixtures import table, with_sql

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, coalesce(n, 0) AS n_orders, round(coalesce(s, 0), 2) AS spent FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY ALL) ON o_custkey = c_custkey")
def join_left_fill(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("s"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("spent"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(c, 0) AS n_customers, coalesce(s, 0) AS n_suppliers FROM (SELECT c_nationkey * 3 AS k, count(*) AS c FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey * 2 AS k, count(*) AS s FROM supplier GROUP BY ALL) b ON a.k = b.k")
def join_full_coalesce(spark, sf):
    c = table(spark, sf, "customer").groupBy((F.col("c_nationkey") * 3).alias("k")).agg(F.count("*").alias("c"))
    s = table(spark, sf, "supplier").groupBy((F.col("s_nationkey") * 2).alias("k")).agg(F.count("*").alias("s"))
    return c.join(s, "k", "full").select("k", F.coalesce("c", F.lit(0)).alias("n_customers"), F.coalesce("s", F.lit(0)).alias("n_suppliers"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def join_semi(spark, sf):
    big = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(big, "c_custkey", "left_semi").select("c_custkey", "c_acctbal")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def join_anti(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS inside, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS outside FROM orders")
def membership(spark, sf):
    inside = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return table(spark, sf, "orders").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query("SELECT s.s_suppkey, s_name, s_nationkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE s_acctbal END AS s_acctbal FROM supplier s LEFT JOIN customer ON c_custkey = s_suppkey")
def keyed_upsert(spark, sf):
    new = table(spark, sf, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("s_acctbal"))
    return relational.keyed_upsert(table(spark, sf, "supplier"), new, "s_suppkey")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def replace_by_key(spark, sf):
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    return relational.replace_by_key(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, "c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL")
def group_counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS qty, max(l_discount) AS top, round(avg(l_extendedprice), 2) AS mean FROM lineitem GROUP BY ALL")
def group_stats(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.max("l_discount").alias("top"), F.round(F.avg("l_extendedprice"), 2).alias("mean"))


@query("SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0) AS top_f, count(*) FILTER (WHERE o_totalprice > 100000) AS n_big FROM orders GROUP BY ALL")
def cond_agg(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("top_f"), F.count_if(F.col("o_totalprice") > 100000).alias("n_big"))


@query("SELECT source, n, round((ys + 20 * prior) / (n + 20), 6) AS rate FROM (SELECT source, count(*) AS n, sum(toxic) AS ys FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 10), (SELECT avg(toxic) AS prior FROM documents JOIN labels USING (doc_id))")
def smoothed_rate(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    return rates.smoothed_rate(d, ["source"], "toxic", least=10).select("source", "n", F.round("rate", 6).alias("rate"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1")
def argmax_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.first_of(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("SELECT l_partkey, l_orderkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def head_k_group(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return windows.first_of(li, "l_partkey", [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 3, "r").select("l_partkey", "l_orderkey", "l_linenumber", F.col("r").cast("long").alias("r"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY ALL")
def count_distinct(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("n_users"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_orderpriority")
def value_counts(spark, sf):
    return relational.value_counts(table(spark, sf, "orders"), "o_orderpriority")


@query("SELECT c_custkey, coalesce(ids, '') AS ids FROM customer LEFT JOIN (SELECT o_custkey, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT o_custkey, CAST(o_orderkey AS VARCHAR) AS k FROM orders) GROUP BY ALL) ON o_custkey = c_custkey")
def string_agg_sorted(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.joined_lists(o, table(spark, sf, "customer").select("c_custkey"), "c_custkey", "o_orderkey", "ids")


@query("SELECT avg(CASE WHEN toxic = 1 THEN 1.0 ELSE 0.0 END) AS share, max(doc_id) AS top, min(doc_id) AS least FROM labels")
def global_scalars(spark, sf):
    return table(spark, sf, "labels").agg(F.avg((F.col("toxic") == 1).cast("double")).alias("share"), F.max("doc_id").alias("top"), F.min("doc_id").alias("least"))


@query("SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS top FROM lineitem")
def rowwise_max(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("top"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders")
def rank_ordinal(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("r"))


@query("SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC) AS r FROM lineitem")
def rank_min(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.rank().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_quantity"))).cast("long").alias("r"))


@query("SELECT o_orderkey, max(o_totalprice) OVER w AS top, round(sum(o_totalprice) OVER w, 2) AS total, count(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey)")
def partition_stats(spark, sf):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf, "orders").select("o_orderkey", F.max("o_totalprice").over(w).alias("top"), F.round(F.sum("o_totalprice").over(w), 2).alias("total"), F.count("*").over(w).alias("n"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, max(l_quantity) OVER (PARTITION BY l_orderkey) AS m1 FROM lineitem),
b AS (SELECT *, sum(CASE WHEN q = m1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey) AS n1, coalesce(max(CASE WHEN q < m1 THEN q END) OVER (PARTITION BY l_orderkey), 0) AS m2 FROM a)
SELECT l_orderkey, l_linenumber, q - CASE WHEN q = m1 AND n1 = 1 THEN m2 ELSE m1 END AS gap FROM b""")
def gap_to_best_other(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return windows.gap_to_best_other(li, ["l_quantity"], "l_orderkey").select("l_orderkey", "l_linenumber", F.col("l_quantity_gap").alias("gap"))


@query("SELECT l_orderkey, l_linenumber, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS next_part FROM lineitem")
def lead_next(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).alias("next_part"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey) - l_quantity, 2) AS others FROM lineitem")
def sum_of_others(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(Window.partitionBy("l_orderkey")) - F.col("l_quantity"), 2).alias("others"))


@query("SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 2) AS running FROM lineitem")
def running_sum(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS place FROM orders) WHERE place < 24")
def topk_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return windows.first_of(o, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 24, "r").select("o_custkey", "o_orderkey", (F.col("r") - 1).cast("long").alias("place"))


def _bucket_sql(key: str, n: int, seed: int) -> str:
    return f"((({key}) % 1000003) * {2 * seed + 7919} + {104729 * (seed + 1)}) % 1000003 % {n}"


@query(f"SELECT o_orderkey FROM orders WHERE {_bucket_sql('o_orderkey', 100, 42)} < 10")
def hash_sample(spark, sf):
    return splits.sample(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 10, 42)


@query(f"SELECT c_custkey, CAST({_bucket_sql('c_custkey', 5, 7)} AS INTEGER) AS fold FROM customer")
def hash_fold(spark, sf):
    return splits.folds(table(spark, sf, "customer").select("c_custkey"), F.col("c_custkey"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def multi_key_sort(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def union_all(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")).unionByName(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("SELECT s_suppkey AS id, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, NULL, c_mktsegment FROM customer")
def union_ragged(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return relational.union_ragged(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))


@query("SELECT s_nationkey AS nation FROM supplier UNION SELECT c_nationkey FROM customer")
def union_distinct(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")).union(table(spark, sf, "customer").select("c_nationkey")).distinct()


@query("SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def explode_array(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("SELECT s_suppkey AS q_rid, s_acctbal AS p, s_suppkey AS orig FROM supplier UNION ALL SELECT s_suppkey + (SELECT max(s_suppkey) + 1 FROM supplier) * i, s_acctbal, s_suppkey FROM supplier, range(1, 3) r(i) WHERE s_suppkey NOT IN (SELECT n_nationkey FROM nation)")
def copy_rows(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("q_rid"), F.col("s_acctbal").alias("p"))
    return splits.with_copies(s, table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("q_rid")), 2)


@query(with_sql("SELECT rid, length(addr) AS n_chars, len(list_intersect(nw, string_split(addr, ' '))) AS shared, len(list_filter(list_distinct(nw), lambda w: NOT list_contains(string_split(addr, ' '), w))) AS own FROM rwords", "rwords"))
def set_overlap(spark, sf):
    a, b = F.split("name", " "), F.split("addr", " ")
    return x.rec(spark, sf).select("rid", F.length("addr").cast("long").alias("n_chars"), F.size(F.filter(F.array_intersect(a, b), lambda w: w != "")).cast("long").alias("shared"), F.size(F.filter(F.array_except(a, b), lambda w: w != "")).cast("long").alias("own"))


@query("SELECT a.o_orderkey, CASE WHEN s = '' OR t = '' THEN 0 WHEN s = t THEN 1 ELSE -1 END AS eq FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END AS s, substr(o_orderpriority, 3, 1) AS t FROM orders) a")
def tri_state_eq(spark, sf):
    s = F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf, "orders").select("o_orderkey", three_valued(s, F.substring("o_orderpriority", 3, 1)).alias("eq"))


@query("SELECT l_orderkey, l_linenumber, round(0.5 * l_discount / (0.5 * l_discount + 1 - l_discount), 9) AS p FROM lineitem")
def odds_shift(spark, sf):
    from kinlink.operators.decide import odds_shift as shift

    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(shift(F.col("l_discount"), 0.5), 9).alias("p"))
