from collections import Counter

from oracle import connect, same
from pyspark.sql import functions as F

from kinlink.llm import quality as q


def plain(text):
    import re

    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " ", "a b c a b c", "a a a a", "a a a", "a b", "x\ny\nx\n\n \nx", "# * $ % & | < >", "é 日本 é x", "w " * 60, "one two three four " * 30, " ".join(f"u{i}" for i in range(70)), "\v\f a\rb\tc"]


def test_figures(spark, make_docs):
    rows = q.judged(make_docs(list(enumerate(TEXTS)))).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}
    kept = {r.doc_id for r in rows if r.kept}
    assert kept == {12}
    assert all(not r.kept for r in rows if r.base_failed)


def test_rows_kept_and_rules_named_do_not_depend_on_the_order(spark, make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    rules = q.default_rules()
    kept = lambda rs: {r.doc_id for r in docs.where(~q.rejected(F.col("text"), rs)).collect()}
    assert kept(rules) == kept(rules[::-1]) == {r.doc_id for r in q.passing(docs).collect()} == {12}
    named = lambda rs: {r.doc_id: r.by for r in docs.select("doc_id", q.rejected_by(F.col("text"), rs, rules).alias("by")).collect()}
    assert named(rules) == named(rules[::-1]) == {r.doc_id: r.rejected_by for r in q.judged(docs).collect()}
    assert named(rules)[12] is None and named(rules)[10] == "word_length" and named(rules)[11] == "repeated_windows" and named(rules)[0] == "min_words"


def test_figures_tell_what_the_text_tells(spark, make_docs):
    docs = make_docs(list(enumerate(TEXTS)))
    by_text = [q.Rule(r.name, r.rejects) for r in q.default_rules()]
    assert q.judged(docs, rules=by_text).exceptAll(q.judged(docs)).isEmpty()


def test_order_by_rejection_per_cost(spark, make_docs):
    docs = make_docs([(i, f"word{i} " * 200) for i in range(50)])
    never, always = q.Rule("never", lambda t: F.length(t) > 10**6), q.Rule("always", lambda t: F.length(t) > 0)
    ordered, figures = q.order_rules(docs, [never, always])
    assert [r.name for r in ordered] == ["always", "never"]
    assert figures["always"][1] == 1 and figures["never"][1] == 0
    dear = q.Rule("dear", lambda t: F.size(F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.xxhash64(t, i)))) > 0)
    ordered, figures = q.order_rules(docs, [dear, always])
    assert [r.name for r in ordered] == ["always", "dear"] and figures["dear"][0] > 4 * figures["always"][0]


def test_the_order_repeats(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    orders = {tuple(r.name for r in q.order_rules(docs, q.default_rules())[0]) for _ in range(5)}
    assert len(orders) == 1


def test_the_sample_is_of_the_table_given(spark, make_docs, save):
    folder = save(documents=make_docs([(i, f"word{i}") for i in range(900)], partitions=9).repartition(9))
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumnRenamed("text", "body")
    assert len(docs.inputFiles()) == 9
    drawn = q.sample_of(docs.where("doc_id >= 500"), "body", 50, 3)
    assert drawn.count() == 50 and all(int(r.text[4:]) >= 500 for r in drawn.collect())
    assert len(q.sample_of(docs, "body", 50, 3).join(docs.select(F.col("body").alias("text"), F.input_file_name().alias("f")), "text").select("f").distinct().collect()) <= 3
    assert q.order_rules(docs.where("doc_id < 0"), q.default_rules(), "body")[1] == {}
    grouped = docs.groupBy("doc_id").agg(F.max("body").alias("body"))
    assert q.sample_of(grouped, "body", 10, 3).count() == 10
    assert q.passing(grouped, text_col="body").count() == 0


def test_edge_cases(spark, odd, empty):
    assert q.passing(odd).columns == odd.columns
    assert q.passing(empty).count() == 0
    assert q.judged(odd).count() == 9
    assert q.judged(empty).count() == 0


def test_native(spark, data):
    plan = q.op2_quality(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_equals_its_sql(spark, data):
    same(spark, connect(data), data, q.op2_quality, q.ORACLE)
