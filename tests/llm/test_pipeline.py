import random

import corpus_pipeline as c
from kinlink.llm import decontaminate, quality, secrets


def test_stages():
    assert [n for n, _ in c.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    assert c.ORACLE_SQL is None


def corpus(make_docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["an", "er", "ko", "mi", "ta", "lu", "so"]) for _ in range(3))
    good = [" ".join(word() for _ in range(120)) for _ in range(6)]
    leak = " ".join(f"item{i}" for i in range(12))
    rows = list(enumerate(good))
    rows += [(10, good[0]), (11, good[1].replace(good[1].split()[60], "changed", 1)), (12, f"{good[2][:300]} {leak} " + " ".join(word() for _ in range(80)))]
    rows += [(13, " ".join(word() for _ in range(80)) + ' token = "abcdef0123456789"'), (14, "too short"), (15, None), (16, "spam " * 80)]
    return make_docs(rows), leak


def test_run_against_brute_force(spark, make_docs, save):
    docs, leak = corpus(make_docs)
    sf = save(documents=docs, benchmark=spark.createDataFrame([(1, leak)], "item_id long, text string"))
    packed = c.run(spark, sf).toPandas()
    assert sorted(packed.doc_id.unique()) == [0, 1, 2, 3, 4, 5, 13]
    # every stage by itself
    kept = quality.passing(docs)
    assert {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 5, 10, 11, 12, 13}
    once = c.near_duplicates(spark, kept, sf)
    assert {r.doc_id for r in once.collect()} == {0, 1, 2, 3, 4, 5, 12, 13}
    clean = c.decontamination(spark, once, sf)
    assert {r.doc_id for r in clean.collect()} == {0, 1, 2, 3, 4, 5, 13}
    safe = c.secret_scan(spark, clean, sf)
    assert safe.count() == clean.count() and "abcdef0123456789" not in safe.where("doc_id = 13").first().text
    for stage in (kept, once, clean, safe):
        assert stage.columns == docs.columns
    assert decontaminate.words("A b") == [b"a", b"b"] and secrets.redact(None) is None


def test_odd_and_empty_tables(spark, odd, empty, save):
    bench = spark.createDataFrame([(None, None), (1, "")], "item_id long, text string")
    for docs, n in ((odd, 1), (empty, 0)):
        sf = save(documents=docs, benchmark=bench)
        for _, stage in c.STAGES[:-1]:
            assert stage(spark, docs, sf).columns == docs.columns
        assert c.run(spark, sf).select("doc_id").distinct().count() <= n
