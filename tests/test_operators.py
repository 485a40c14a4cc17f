import functools
import itertools

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinlink.operators import decide, graph, metrics, rates, relational, splits, windows


def brute_f(p, k):
    total = 0.0
    for hit in itertools.product((0, 1), repeat=len(p)):
        w = np.prod([q if h else 1 - q for h, q in zip(hit, p, strict=True)])
        f = float(sum(hit) == 0) if k == 0 else 1.25 * sum(hit[:k]) / (0.25 * sum(hit) + k)
        total += w * f
    return total


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=1, max_size=7))
def test_expected_f_is_exact(p):
    p = sorted(p, reverse=True)
    f = decide.expected_f(p)
    assert f == pytest.approx([brute_f(p, k) for k in range(len(p) + 1)], abs=1e-9)


def test_sampling_comes_near():
    p = np.array([0.9, 0.6, 0.2])
    assert decide.sampled_f(p, 20000, 0) == pytest.approx(decide.expected_f(p), abs=0.02)


def test_decide(spark):
    s = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.9), (2, 10, 0.8), (3, 10, 0.05), (4, 12, 0.01)], "q_rid long, e_rid long, p double")
    got = {(r.q_rid, r.e_rid) for r in decide.decide(s).collect()}
    assert got == {(1, 10), (2, 10)}  # ties go to the lower entity; what is under the floor is left out
    assert decide.decide(s.where("p < 0.02")).count() == 0
    assert decide.decide(s, method="mc").where("e_rid = 10").count() >= 2


def table_f(p):
    """All expectations by tables of both distributions, without steps or trimming."""
    d = lambda q: functools.reduce(np.convolve, [[1 - x, x] for x in q], np.ones(1))
    out = [d(p)[0]]
    for k in range(1, len(p) + 1):
        a, b = np.arange(k + 1)[:, None], np.arange(len(p) - k + 1)[None, :]
        out.append((d(p[:k])[:, None] * d(p[k:])[None, :] * 1.25 * a / (0.25 * (a + b) + k)).sum())
    return np.array(out)


MANY = {
    "even": lambda n, rng: rng.random(n),
    "low": lambda n, rng: rng.beta(0.3, 1, n),
    "ties": lambda n, rng: np.round(rng.random(n), 1),
    "sure": lambda n, rng: np.where(rng.random(n) < 0.5, 1.0, 0.3 * rng.random(n)),
    "alike": lambda n, rng: np.full(n, rng.random()),
}


@pytest.mark.parametrize("kind", sorted(MANY))
def test_expected_f_of_many(kind, monkeypatch):
    """Steps, trimmed ends and sizes that are passed over change no expectation and no decision."""
    rng = np.random.default_rng(3)
    for n in (1, 2, 25, 70, 130):
        p = np.sort(MANY[kind](n, rng))[::-1]
        f = table_f(p)
        for step in (4, 512):
            monkeypatch.setattr(decide, "STEP", step)
            assert decide.expected_f(p) == pytest.approx(f, abs=1e-13)
            assert decide.best_size(p, 0) == decide.best_size(p) == decide.best_k(f)


def test_draws_do_not_depend_on_how_many_are_made_at_once():
    p = np.array([0.9, 0.6, 0.2])
    assert decide.sampled_f(p, 100, 0, cells=21) == pytest.approx(decide.sampled_f(p, 100, 0), abs=1e-12)


@pytest.mark.parametrize("method", ["exact", "mc"])
def test_decide_keeps_every_query_of_an_entity(spark, method):
    """However many there are, in whichever batches they come."""
    s = spark.range(2000).select(F.col("id").alias("q_rid"), F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("e_rid"), F.lit(0.95).alias("p")).repartition(5)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, "64")
    try:
        got = [tuple(r) for r in decide.decide(s, method=method).collect()]
    finally:
        spark.conf.unset(name)
    assert sorted(got) == [(i, 7 if i < 1500 else i, 0.95) for i in range(2000)]


def test_decide_of_many_queries_equals_its_sql(spark):
    from kinlink.plans.linkage_queries import _DECIDE

    rng = np.random.default_rng(5)
    p = np.concatenate([np.round(rng.random(70), 2), rng.beta(0.4, 1, 60), rng.random(9)])
    best = pd.DataFrame({"q_rid": np.arange(len(p)), "e_rid": np.repeat([10, 11, 12], [70, 60, 9]), "p": p})
    con = duckdb.connect()
    con.register("best", best)
    want = con.execute(f"WITH RECURSIVE {_DECIDE} SELECT q_rid, e_rid, p FROM top JOIN kk USING (e_rid) WHERE r <= k").fetchall()
    got = [tuple(r) for r in decide.decide(spark.createDataFrame(best)).collect()]
    assert sorted(got) == sorted(want) and sum(e == 10 for _, e, _ in got) > 24


def test_macro_f05(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "e_rid long")
    gt = spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "q_rid long, true_e long")
    pred = spark.createDataFrame([(10, 1), (12, 3)], "q_rid long, e_rid long")
    f = {r.e_rid: r.f for r in metrics.entity_f05(pred, gt, e).collect()}
    assert f == {1: pytest.approx(1.25 * 0.5 / (0.25 + 0.5)), 2: 0.0, 3: 0.0}


def test_gap(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 4.0), (2, 4.0), (3, 2.0)], "q_rid long, v double")
    got = sorted((r.q_rid, r.v, r.v_gap) for r in windows.gap_to_best_other(df, ["v"]).collect())
    assert got == [(1, 3.0, -2.0), (1, 5.0, 2.0), (2, 4.0, 0.0), (2, 4.0, 0.0), (3, 2.0, 2.0)]


def test_number_edits(spark):
    cases = [("7012", "702", "drop"), ("2611", "2623", "shift"), ("12", "21", "swap"), ("12", "13", "1dig"), ("5", "5", "same"), ("100", "9000", "other"), (None, "1", "noq"), ("1", None, "noe"), (None, None, "none")]
    arr = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.array(c))
    df = spark.createDataFrame(cases, "a string, b string, want string")
    assert df.where(rates.number_edit_kind(arr("a"), arr("b")) != F.col("want")).count() == 0


def test_dense_rid(spark):
    df = spark.createDataFrame([(s, f"e{i:03d}") for s in (2, 1, 3) for i in range(50)], "src int, entity_id string")
    got = [r.rid for r in relational.dense_rid(df, ["src", "entity_id"]).orderBy("src", "entity_id").collect()]
    assert got == list(range(150))


def test_copies(spark):
    s = spark.createDataFrame([(1, 5, 0.5), (2, 5, 0.4)], "q_rid long, e_rid long, p double")
    gt = spark.createDataFrame([(1, 5)], "q_rid long, true_e long")
    got = sorted((r.q_rid, r.orig) for r in splits.with_copies(s, gt, 2).collect())
    assert got == [(1, 1), (2, 2), (5, 2), (8, 2)]


def test_votes_and_proposals(spark):
    links = spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.5, 2)], "q_rid long, r_rid long, s double, r_rank int")
    scores = spark.createDataFrame([(2, 7, 0.8), (3, 7, 0.6), (3, 8, 0.9), (1, 8, 0.1)], "q_rid long, e_rid long, p double")
    v = {r.e_rid: r for r in graph.votes(links, scores).collect()}
    assert v[7].nb_v1 == 0.8 and v[7].nb_nv == 2 and v[7].nb_vw == pytest.approx(0.72) and v[8].nb_v1 == 0
    assert [(r.q_rid, r.e_rid) for r in graph.propose(graph.votes(links, scores), scores).collect()] == [(1, 7)]


def test_empty_tables(spark):
    s = spark.createDataFrame([], "q_rid long, e_rid long, p double")
    assert decide.assign(s, 0.1).count() == 0
    assert windows.query_context(s).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_pairs_that_share_a_token_are_not_shuffled(spark):
    """300 entities and 1200 queries with 30 tokens in common meet 10.8 million times; records are all that is dealt."""
    from kinlink.operators import simjoin

    tokens = spark.range(1500).selectExpr("id AS rid", "explode(transform(sequence(1, 31), x -> IF(x < 31, 't' || x, 'own' || id % 250))) AS tok", "true AS name")
    ids = spark.range(1500).withColumnRenamed("id", "rid")
    before = shuffled(spark)
    assert simjoin.candidates(tokens, ids.where("rid < 300"), ids.where("rid >= 300"), 5, 5, threshold=0.0).count() >= 6000
    assert shuffled(spark) - before < 8e6


def test_blocks_of_the_index_give_the_candidates_of_one(spark):
    """Ranks of several blocks are those of the whole index, ties and scores by one kind included; a record isn't its own neighbour."""
    from kinlink.operators import simjoin

    words = [(i, f"w{(i * k) % p}", k < 4) for i in range(90) for k, p in ((1, 7), (2, 11), (3, 5), (5, 13))]
    tokens = spark.createDataFrame(words, "rid long, tok string, name boolean").groupBy("rid", "tok").agg(F.max("name").alias("name"))
    ids = spark.range(90).withColumnRenamed("id", "rid")
    for make in (
        lambda **how: simjoin.candidates(tokens, ids.where("rid < 40"), ids.where("rid >= 40"), 6, 3, **how),
        lambda **how: simjoin.neighbours(tokens.drop("name"), ids, 4, **how),
    ):
        one, many = (sorted(map(tuple, make(**how).collect())) for how in ({}, {"block_rows": 7, "salt_rows": 11}))
        assert one == many and one
    assert all(q != r for q, r, *_ in one)


def test_copies_of_the_index_follow_the_rows_and_not_the_cores():
    from types import SimpleNamespace

    from kinlink.operators import simjoin

    wide = SimpleNamespace(sparkContext=SimpleNamespace(defaultParallelism=1000))
    for n_queries, n_index in ((340_000, 170_000), (2_000, 1_000), (500, 40_000)):
        groups, blocks = simjoin.cells_of(wide, n_queries, n_index, 250_000, 500_000)
        assert groups * n_index <= max(simjoin.SPREAD * n_queries, -(-n_queries // 250_000) * n_index)
    assert simjoin.cells_of(wide, 10_000_000, 5_000_000, 250_000, 500_000) == (40, 10)


def test_shuffled_tokens_are_given_back_before_records_are_dealt(spark):
    """What is left to run begins at settled records, so no shuffle of tokens stays on the disk beside that of records."""
    from kinlink.operators import simjoin

    tokens = spark.range(60).selectExpr("id AS rid", "explode(array('a' || id % 7, 'b' || id % 5)) AS tok", "true AS name")
    ids = spark.range(60).withColumnRenamed("id", "rid")
    for df in (simjoin.candidates(tokens, ids.where("rid < 20"), ids.where("rid >= 20"), 5, 5), simjoin.neighbours(tokens.drop("name"), ids, 4)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_planted_features_are_shuffled_once(spark):
    """A pair's label and entity come along with it, so its features aren't joined with them."""
    from kinlink.operators.features import stage1_features

    r, pairs = met_table(spark)
    marked = pairs.where("q_rid < 204 and e_rid < 5").selectExpr("*", "cast(q_rid - 200 = e_rid as int) AS y", "q_rid - 200 AS of")
    found = stage1_features(marked, r, ("y", "of"))
    assert sorted(map(tuple, found.select("q_rid", "e_rid", "y", "of").collect())) == sorted(map(tuple, marked.select("q_rid", "e_rid", "y", "of").collect()))
    assert sorted(map(tuple, found.drop("y", "of").collect())) == sorted(map(tuple, stage1_features(marked, r).collect()))


def test_no_index_and_no_queries(spark):
    from kinlink.operators import simjoin

    tokens = spark.createDataFrame([(1, "a", True), (2, "a", False)], "rid long, tok string, name boolean")
    ids = spark.range(3).withColumnRenamed("id", "rid")
    assert simjoin.candidates(tokens, ids.where("rid > 5"), ids).count() == simjoin.candidates(tokens, ids, ids.where("rid > 5")).count() == 0
    assert simjoin.neighbours(tokens.limit(0), ids).count() == 0


def test_tokens_of_pairs_are_not_shuffled(spark):
    """40,000 pairs of 40 tokens each: figures by hand, and only records and pairs are dealt."""
    from kinlink.operators import simjoin

    tokens = spark.range(400).selectExpr("id AS rid", "explode(transform(sequence(1, 41), x -> IF(x < 41, 'x|n|t' || x, 'x|n|own' || id))) AS tok", "'name' AS view")
    pairs = spark.range(200).selectExpr("id + 200 AS q_rid", "explode(sequence(0L, 199L)) AS e_rid")
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # small tables are joined as large ones
    try:
        got = simjoin.view_dots(pairs, tokens, spark.range(200).withColumnRenamed("id", "rid")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 3e6
    w, own = np.log(201) - np.log(200), np.log(201)
    assert len(got) == 40000 and {(r.nq_name, r.ne_name, r.covq_name, r.nq_num) for r in got} == {(40.0, 41.0, 1.0, 0.0)}
    assert got[0].cos_name == pytest.approx(40 * w * w / np.sqrt(40 * w * w) / np.sqrt(40 * w * w + own * own), abs=1e-9)


def met_table(spark):
    """400 records of six own words and ten of an address, and the 40,000 pairs of two halves."""
    word = lambda salt: F.lower(F.substring(F.translate(F.sha2(F.concat("rid", F.lit(salt)), 256), "0123456789", "ghijklmnop"), 1, 6))
    text = lambda kind, n: F.concat_ws(" ", *[word(f"{kind}{k}") for k in range(n)])
    r = spark.range(400).withColumnRenamed("id", "rid").withColumn("core", text("n", 6)).select(
        "rid", F.when(F.col("rid") < 200, 1).otherwise(2).alias("src"), F.lit("US").alias("country"), *[F.col("core").alias(c) for c in ("business_name", "name_full", "core", "core_sk")], F.lit("").alias("legal"), F.lit("").alias("alt"),
        text("a", 10).alias("addr"), F.concat_ws(" ", F.col("rid"), F.lit("12")).alias("nums"), F.lit("").alias("state"), F.col("rid").cast("string").alias("entity_id"),
    )
    pairs = spark.range(200).selectExpr("id + 200 AS q_rid", "explode(sequence(0L, 199L)) AS e_rid", "0.5D AS bs_f", "1 AS br_f", "0.5D AS bs_n", "1 AS br_n", "0.5D AS p")
    return r, pairs


def bytes_shuffled(spark, df):
    """What writing df shuffles, small tables being joined as large ones."""
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return shuffled(spark) - before


def test_texts_of_pairs_are_not_shuffled(spark):
    from kinlink.operators.features import stage1_features

    r, pairs = met_table(spark)
    assert bytes_shuffled(spark, lambda: stage1_features(pairs.where("q_rid < 240"), r)) < 2e6


def test_words_of_pairs_are_not_shuffled(spark):
    from kinlink.operators.fine import FINE, fine_features

    r, pairs = met_table(spark)
    words = spark.createDataFrame([("abc", "q", 5, 0.5)], "w string, side string, n long, rate double")
    sigs = spark.createDataFrame([("drop|a2|r2", "coarse", 5, 0.5)], "sig string, kind string, n long, rate double")
    assert fine_features(pairs.where("q_rid < 203"), r, words, sigs).select(*FINE).na.drop().count() == 600
    assert bytes_shuffled(spark, lambda: fine_features(pairs, r, words, sigs)) < 2e6


def test_pairs_are_not_multiplied_by_neighbours(spark):
    r, pairs = met_table(spark)
    links = spark.range(200).selectExpr("id + 200 AS q_rid", "explode(sequence(200L, 239L)) AS r_rid", "0.9D AS s", "1 AS r_rank")
    c = graph.consensus(pairs, links, graph.keys(r))
    row = c.where("q_rid = 205 and e_rid = 7").first()
    assert (row.nb_nclose, row.nb_hn_e, row.nb_hn_q, row.nb_xe) == (40, 0, 1, 0) and row.nb_xq == pytest.approx(1 / 40)
    assert bytes_shuffled(spark, lambda: graph.consensus(pairs, links, graph.keys(r))) < 3e6


def test_marked_tokens_spare_a_shuffle(spark):
    """Tokens that tell entities from queries give the same candidates, and aren't shuffled by record for it."""
    from kinlink.operators import simjoin
    from kinlink.sources import tables

    tokens = tables.settled(spark.range(1500).selectExpr("id AS rid", "id < 300 AS indexed", "explode(transform(sequence(1, 31), x -> IF(x < 20, 't' || x, 'own' || id % 250 || x))) AS tok", "true AS name"))
    ids = spark.range(1500).withColumnRenamed("id", "rid")
    found, wrote = [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for own in (tokens.drop("indexed"), tokens):
            before = shuffled(spark)
            found.append(sorted(map(tuple, simjoin.candidates(own, ids.where("rid < 300"), ids.where("rid >= 300"), 5, 5, threshold=0.0).collect())))
            wrote.append(shuffled(spark) - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found[0] == found[1] and found[0]
    assert wrote[1] < 0.9 * wrote[0], wrote
