from kinlink.llm import licenses as x


def plain(text, matcher):
    """Licenses whose shingles some window of the template's length and a quarter holds, all windows tried."""
    words = [w.lower() for w in x._WORD.findall(text or "")]
    found, whole = set(), set(x.shingles(words, matcher.size))
    for name, own, n in zip(matcher.names, matcher.sets, matcher.lengths, strict=True):
        if len(own & whole) < matcher.containment * len(own):  # then no window of the text holds enough
            continue
        stride = max(1, n // 4)
        for b in range(max(1, len(words))):
            if len(own & set(x.shingles(words[b : b + n + stride], matcher.size))) >= matcher.containment * len(own):
                found.add(name)
                break
    return found


def test_templates_find_themselves():
    m = x.default_matcher()
    for name, text in x.TEMPLATES:
        for near in (text, text.upper(), "foo bar " + text + " baz" * 9, text.replace(" ", "\n  ")):
            assert [f[0] for f in m.find(near)] == [name]
        start, end = m.find("x y z. " + text)[0][1:3]
        assert ("x y z. " + text)[start:end].lower().split()[0].strip('"(') == text.lower().split()[0].strip('"(')


def test_edited_and_absent():
    m = x.default_matcher()
    edited = x.TEMPLATES[0][1].replace("free of charge", "at no charge").replace("sublicense", "relicense")
    assert [f[0] for f in m.find(edited)] == ["MIT"]
    for text in ("", None, "licensed", "the license of this software is unknown", "a b", "under the terms of the"):
        assert m.find(text) == []


def test_bands_are_enough():
    assert (1 - x.least_similarity(0.8) ** 2) ** x.bands_for(x.least_similarity(0.8), 2, 1e-4) <= 1e-4


def test_against_brute_force(spark, data):
    m = x.default_matcher()
    rows = {r.doc_id: r for r in x.op8_licenses(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for d in docs:
        got = set(filter(None, rows[d.doc_id].licenses.split(",")))
        assert got == plain(d.text, m)


def test_many_notices_take_linear_time():
    import time

    m, took = x.default_matcher(), []
    text = x.TEMPLATES[0][1] + " other words" * 100 + "\n"
    for n in (200, 400):
        began = time.perf_counter()
        assert len(m.find(text * n)) >= 0.9 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 4 * took[0]


def test_edge_cases(spark, odd, empty, save):
    assert x.op8_licenses(spark, save(documents=odd)).where("n_matches = 0").count() == 9
    assert x.op8_licenses(spark, save(documents=empty)).count() == 0
