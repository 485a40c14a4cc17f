import pytest
from oracle import connect, same

from kinlink.plans import catalog

ORACLES = catalog.oracles()
QUERIES = catalog.queries()
MODELS = {"gbt_stage1", "gbt_stage2_oof", "feature_importance", "learning_curve", "copy_check"}


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, data, name):
    same(spark, con, data, QUERIES[name], ORACLES[name])


def test_only_models_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == MODELS


def auc(p):
    rank, y = p.p.rank(), p.y == 1
    return (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def test_models_on_entities_that_they_have_not_seen(spark, data):
    """The label is what was planted, not a feature."""
    from kinlink.plans import fixtures

    first, second = (QUERIES[n](spark, data).toPandas() for n in ("gbt_stage1", "gbt_stage2_oof"))
    for p in (first, second):
        assert p.p.between(0, 1).all() and not p.duplicated(["q_rid", "e_rid"]).any()
        assert auc(p) > 0.95
    rows = fixtures.planted_features(spark, data)
    assert len(second) == rows.count() and len(first) == rows.where("fold = 0").count() > 0
    assert rows.groupBy("q_rid").agg({"fold": "max"}).count() == rows.select("q_rid", "fold").distinct().count()
    gains = QUERIES["feature_importance"](spark, data).toPandas()
    assert abs(gains.gain.sum() - 1) < 1e-6 and len(gains) == 66
    curve = QUERIES["learning_curve"](spark, data).toPandas()
    assert curve.percent.tolist() == [25, 50, 100] and curve.f05.iloc[-1] > 0.7
    check = QUERIES["copy_check"](spark, data).toPandas().set_index("model").f05
    assert (check > 0.7).all() and check["p_crowded"] > check["p_plain"] - 0.1


def test_filters_and_columns_reach_the_scan(spark, data):
    name = "spark.sql.maxMetadataStringLength"
    spark.conf.set(name, "2000")
    try:
        plan = QUERIES["scan_filtered"](spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name)
    assert "GreaterThan(l_quantity,45.0)" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "l_extendedprice" not in plan.split("ReadSchema")[1]


def test_a_hot_token_is_dealt_over_keys(spark):
    """The same candidates however finely the queries of a token are dealt."""
    from kinlink.operators import simjoin

    rows = [(i, t, t != "a3") for i in range(60) for t in {"hot", f"a{i % 7}", f"b{i % 11}"}]
    tokens = spark.createDataFrame(rows, "rid long, tok string, name boolean")
    ids = spark.range(60).withColumnRenamed("id", "rid")
    found = [sorted(map(tuple, simjoin.candidates(tokens, ids.where("rid < 20"), ids.where("rid >= 20"), 5, 3, salt_rows=n).collect())) for n in (50_000, 3)]
    assert found[0] == found[1] and found[0]


def test_invariants_of_candidates(spark, data):
    from kinlink.plans import fixtures

    c = fixtures.cand(spark, data).toPandas()
    assert not c.duplicated(["q_rid", "e_rid"]).any()
    assert c.br_f[c.br_f < 99].max() <= 20
    assert c.br_n[c.br_n < 99].max() <= 10
    assert c.bs_f.max() <= 1 + 1e-6


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
