import random
import zlib

from kinlink.llm import toxicity as x


def distance(a, b):
    """Edits, with two neighbours swapped as one (no part is edited twice)."""
    d = [[i + j if i == 0 or j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    word = lambda lo, hi: "".join(rng.choice("abc") for _ in range(rng.randint(lo, hi)))
    for _ in range(1500):
        terms = sorted({word(5, 8) for _ in range(6)})
        lexicon, w = x.Lexicon(terms, []), word(3, 9)
        d = min(distance(w, t) for t in terms)
        assert (lexicon.look(w) is not None) == (d <= 1)
        for errors in (1, 2, 3):
            found = lexicon.trie.walk(w, errors)
            assert (found is not None) == (d <= errors)
            assert found is None or (found[1] == d == distance(w, found[0]))


def test_context_weighs_hits():
    lexicon = x.Lexicon(["idiot"], [])
    abuse, plain, quote, said = (x.features(t, lexicon)[0] for t in ("you idiot", "the idiot", 'a "idiot" b', "he said idiot"))
    assert abuse > plain > said > 0
    assert plain > quote
    for text in ("an idoit", "an idiiot", "an idot", "an id1ot", "an id*ot", "an !d|ot id!0t"):
        assert x.features(text, lexicon)[1] > 0, text
    assert x.features("id 1 ot i*d", lexicon)[1] == 0
    assert x.features(None, lexicon) == x.features("", lexicon) == [0.0] * len(x.FEATURES)


def test_quotations_are_found_over_the_whole_line():
    """However far the marks are, and whatever was closed before; by comparing with a scan of each place."""
    lexicon = x.Lexicon(["idiot"], [])
    for n in (10, 90, 5000):
        assert x.features(f'he called me "a {"word " * n}idiot" there', lexicon)[3] == 1.0
        assert x.features(f'"one" {"word " * n}idiot and "two"', lexicon)[3] == 0.0
        assert x.features(f'„so {"wort " * n}idiot“ da', lexicon)[3] == 1.0
        assert x.features(f'a " {"word " * n}idiot\n" b', lexicon)[3] == 0.0
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice('ab"“”«»\n') for _ in range(rng.randint(0, 25)))
        inside = set()
        for line_at, line in ((sum(len(k) + 1 for k in text.split("\n")[:n]), k) for n, k in enumerate(text.split("\n"))):
            for o, c in (('"', '"'), ("“", "”"), ("«", "»")):
                begin = None
                for i, ch in enumerate(line):
                    if begin is None and ch == o:
                        begin = i
                    elif begin is not None and ch == c:
                        inside.update(range(line_at + begin, line_at + i))
                        begin = None
        spans = x.quotations(text)
        assert all(x.quoted(spans, i) == (i in inside) for i in range(len(text)) if text[i] in "ab")
    assert x.quotations("“" * 200_000) == []


def test_terms_and_beginnings():
    nodes = [("bad$", 9, 9), ("badly$", 3, 40), ("foob$", 5, 5), ("foo", 12, 12), ("food$", 4, 4), ("mild$", 5, 50)]
    assert x.select_terms(nodes, 0.85) == (["bad"], ["foo"])


def test_held_out_quality(spark):
    """Against the labels of the rows that are never learned from."""
    sf = "/root/testdata/sf0.1"
    p = x.op9_toxicity(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().drop_duplicates("doc_id")
    assert (p.held_out == p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert p.score.between(0, 1).all() and (p.predicted == (p.score >= 0.3)).all()
    q = p[p.held_out].merge(labels, on="doc_id")
    rank, y = q.score.rank(), q.toxic == 1
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.93
    assert (q.predicted[y] == 1).mean() > 0.85 and (q.predicted[~y] == 1).mean() < 0.03


def test_edge_cases(spark, odd, empty, make_docs, save):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (5, 1, 1), (None, 0, 1), (6, None, None)], "doc_id long, quality int, toxic int")
    rows = x.op9_toxicity(spark, save(documents=odd, labels=labels)).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert x.op9_toxicity(spark, save(documents=empty, labels=labels)).count() == 0
    assert x.op9_toxicity(spark, save(documents=odd, labels=labels.limit(0))).count() == 9
    clash = make_docs([(1, "x"), (2, None)]).withColumnRenamed("spans", "score")
    model = x.Model(x.Lexicon([], []), __import__("numpy").array([0.0] * len(x.FEATURES) + [-4.0]))
    assert x.score(clash, model).count() == 2
