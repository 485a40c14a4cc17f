import re

from oracle import connect, same

from kinlink.llm import decontaminate as d


def plain(docs, items, size=10):
    """Hit words and items by looking at every place of every window."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for name, t in items:
            v = words(t)
            for k in range(max(1, len(v) - size + 1) if v else 0):
                win = v[k : k + size]
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit.update(range(a, a + len(win)))
                        found.update([] if name is None else [str(name)])
        out.append((i, len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, " ".join(f"w{i}" for i in range(14))), (2, "short item"), (3, ""), (4, None), (5, "a a a a a a a a a a a a"), (1, "again under one"), (None, "no id here")]
TEXTS = [
    (1, "x y " + " ".join(f"W{i}" for i in range(3, 14)) + " z"),
    (2, "the Short, item! and short item"),
    (3, "a " * 15),
    (4, None),
    (5, ""),
    (6, "clean words w1 w2 w3"),
    (6, "clean words w1 w2 w3"),
    (None, "no id here"),
    (7, "again under one"),
]


def test_against_brute_force(spark, make_docs):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(plain(TEXTS, ITEMS), key=str)
    for block in (16_000_000, 1):  # one block, and a block an item
        found = d.contain(make_docs(TEXTS), bench, block_chars=block).collect()
        got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found), key=str)
        assert got == want


def test_clean(spark, make_docs, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = d.clean(make_docs(TEXTS), bench)
    assert sorted(str(r.doc_id) for r in got.collect()) == ["4", "5", "6", "6"]
    assert got.columns == odd.columns
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert d.clean(odd, nothing).count() == 9
    assert d.clean(empty, bench).count() == 0
    assert d.contain(odd, nothing).count() == 9


def test_blocks_are_taken_one_at_a_time(spark, make_docs, monkeypatch):
    """No more than two blocks are ever made ahead of the pass over the documents."""
    made, passed = [], []
    first = d.Windows.__init__
    monkeypatch.setattr(d.Windows, "__init__", lambda self, items, size: (made.append(len(made)), first(self, items, size))[1])
    frequency = d.document_frequency
    monkeypatch.setattr(d, "document_frequency", lambda *a: (passed.append(len(made) - len(passed)), frequency(*a))[1])
    bench = spark.createDataFrame([(i, f"words of item {i} and some more of its own {i}") for i in range(6)], "item_id long, text string")
    assert d.contain(make_docs(TEXTS), bench, block_chars=1).count() == len(TEXTS)
    assert len(made) == 6 and max(passed) <= 2


def test_null_item_ids_and_sql(spark, make_docs, save):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make_docs([(k, t) for k, (_, t) in enumerate(TEXTS)])
    folder = save(documents=docs, benchmark=bench)
    con = __import__("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    same(spark, con, folder, d.op5_decontaminate, d.ORACLE)


def test_query_equals_its_sql(spark, data):
    same(spark, connect(data), data, d.op5_decontaminate, d.ORACLE)
