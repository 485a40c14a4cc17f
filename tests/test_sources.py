from pyspark.sql import functions as F

from kinlink.plans.linkage import Linker, block, records
from kinlink.sources import tables
from kinlink.streaming import ingest


def test_tsv_round_trip(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tFoo "Bar"\t\tUS\n2\t\t5 Elm\tUS\n')
    df = tables.read_tsv(spark, str(p))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("1", 'Foo "Bar"', None, "US"), ("2", None, "5 Elm", "US")]
    tables.write_tsv(df.fillna(""), str(tmp_path / "out"))
    back = tables.read_tsv(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_lists_and_truth(spark, tmp_path):
    rec = spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "x", 2), (3, "y", 3)], "rid long, entity_id string, src int")
    pairs = spark.createDataFrame([(3, 0), (2, 0), (2, 0)], "q_rid long, e_rid long")
    tables.write_lists(pairs, rec, "matched_entity_ids", str(tmp_path / "out"))
    back = tables.read_tsv(spark, str(tmp_path / "out"), tables.TRUTH)
    assert sorted(map(tuple, back.collect())) == [("a", "x,y"), ("b", None)]
    assert sorted(map(tuple, tables.truth_pairs(back, rec).collect())) == [(2, 0), (3, 0)]


def test_parts_resume(spark, tmp_path):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    path = str(tmp_path / "parts")
    assert tables.write_parts(df, "id", path, 4).count() == 100
    again = tables.write_parts(df.withColumn("v", F.lit(0)), "id", path, 4)  # all parts are there: nothing is written
    assert again.agg(F.sum("v")).first()[0] == 9900


def test_cache_and_config(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(make, spark, str(tmp_path), "t", k=5).count() == 3
    assert tables.cached(make, spark, str(tmp_path), "t", k=6).count() == 3
    assert len(made) == 2
    tables.save_config(spark, {"thr": 0.5}, str(tmp_path / "c"))
    assert tables.load_config(spark, str(tmp_path / "c")) == {"thr": 0.5}


HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def sources(spark, folder):
    """Sixty businesses, each with two noisy records."""
    names = [f"{a} {b}" for a in ("alpha", "bravo", "cobalt", "dover", "ember", "falcon") for b in ("bakery", "motors", "florist", "printing", "plumbing", "dental", "travel", "books", "garden", "optics")]
    one = "".join(f"s1_{i}\t{n.title()} LLC\t{100 + 7 * i} Main St, Austin, TX\tUS\n" for i, n in enumerate(names))
    two = "".join(f"s2_{i}\t{n.upper()}\t{100 + 7 * i} Main Street, Austin\tUS\n" for i, n in enumerate(names))
    three = "".join(f"s3_{i}\tThe {n.title()} Inc\t{100 + 7 * i} main st., TX\tUS\n" for i, n in enumerate(names))
    out = {}
    for s, body in ((1, one), (2, two), (3, three)):
        p = folder / f"s{s}.tsv"
        p.write_text(HEAD + body)
        out[s] = tables.read_tsv(spark, str(p))
    return out, len(names)


def test_linker_end_to_end(spark, tmp_path):
    tsv, n = sources(spark, tmp_path)
    rec = records(tsv).cache()
    assert rec.count() == 3 * n
    truth = rec.where("src = 1").select("entity_id", F.regexp_extract("entity_id", "_(.*)", 1).alias("i")).select(F.col("entity_id").alias("source1_entity_id"), F.concat(F.lit("s2_"), "i", F.lit(",s3_"), "i").alias("matched_entity_ids"))
    gt = tables.truth_pairs(truth, rec)
    assert gt.count() == 2 * n
    cand = block(rec)
    assert gt.join(cand, [gt.q_rid == cand.q_rid, gt.true_e == cand.e_rid]).count() >= 1.9 * n
    small = {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}
    linker = Linker(stage1=small, stage2=small, least=3)
    found = linker.fit(rec, gt, 30)
    assert max(found.values()) > 0.5
    decided, scored = linker.link(rec)
    decided = decided.cache()
    assert decided.count() == decided.select("q_rid").distinct().count()
    hits = decided.join(gt.withColumnRenamed("true_e", "e_rid"), ["q_rid", "e_rid"]).count()
    assert hits > 0.8 * decided.count() > n
    linker.save(spark, str(tmp_path / "model"))
    again = Linker.load(spark, str(tmp_path / "model"))
    assert again.config() == linker.config() and again.word_rates.count() == linker.word_rates.count()
    # one country made anew: the same texts give the same records, and all its scores are replaced
    from kinlink.plans import repair

    fresh, scores = repair.repair(rec, cand, scored, "us", lambda pairs, r: pairs.select("q_rid", "e_rid", F.lit(0.5).alias("p")))
    assert fresh.exceptAll(rec).count() == 0 == rec.exceptAll(fresh).count()
    assert scores.where("p <> 0.5").count() == 0


def test_backup_is_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    copy = tables.backup(spark, path, "v2")
    spark.range(9).write.mode("overwrite").parquet(path)
    assert tables.backup(spark, path, "v2") == copy
    assert spark.read.parquet(copy).count() == 3


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.tsv").write_text(HEAD + "1\tFoo Pvt Ltd\t1 Elm St\tIndia\n")
    run = lambda: ingest.append(ingest.read_stream(spark, str(tmp_path / "in"), 2), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    run()
    (tmp_path / "in/b.tsv").write_text(HEAD + "2\tBar Inc\t2 Oak St\tUS\n")
    run()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("entity_id").select("entity_id", "core", "legal", "src").collect()
    assert [tuple(r) for r in got] == [("1", "foo", "pvt", 2), ("2", "bar", "inc", 2)]


def test_tables_on_the_way_are_removed(spark):
    """settled_alone() leaves the table it makes, and what inner calls of it have made."""
    kept = []

    def make():
        kept.append(tables.settled_alone(lambda: tables.settled(spark.range(3))))
        return kept[0].join(tables.settled(spark.range(2)), "id")

    path = lambda df: df.inputFiles()[0].rsplit("/", 1)[0]
    found = tables.settled_alone(make)
    assert found.count() == 2 and kept[0].count() == 3
    way = tables.settled(spark.range(1))
    gone = []
    tables.settled_alone(lambda: gone.append(path(tables.settled(spark.range(4)))) or way)
    assert not tables.exists(spark, gone[0]) and tables.exists(spark, path(way))
