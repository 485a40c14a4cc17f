import random

import numpy as np
import pytest
import xxhash

from kinlink.llm import simhash as s
from kinlink.llm.components import components


def plain_fingerprint(text, words=3):
    w = [x for x in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "a b c", "A b c d É e", "x y z x y z x y z", "one\ttwo\nthree\vfour\ffive\rsix"])
def test_fingerprint(text):
    assert s.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_null():
    assert s.fingerprint(None) == 0


def classes(values, distance):
    """Classes by comparing every pair."""
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize(("distance", "bucket"), [(2, 32768), (2, 16), (7, 32768), (0, 8), (5, 40)])
def test_links_lose_none(spark, distance, bucket):
    """Clouds of near values, against all pairs; small buckets go block by block."""
    rng = random.Random(distance)
    values = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(25):
            v = center
            for _ in range(rng.randint(0, 2 * distance + 1)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    prints = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "id long, fp long")
    got = {r.id: r.class_id for r in s.link(prints, distance, bucket).collect()}
    assert [got[i] for i in range(len(values))] == classes(values, distance)


def test_chains_of_segments():
    """Every pair within the distance starts a chain somewhere."""
    rng = np.random.default_rng(1)
    for distance in (1, 2, 3, 7):
        for _ in range(300):
            x = 0
            for b in rng.choice(64, rng.integers(0, distance + 1), replace=False):
                x |= 1 << int(b)
            assert any(len(s.within(np.array([x], np.uint64), k, distance)) for k in range(distance + 1))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, odd, empty, save):
    rows = s.op7_simhash(spark, save(documents=odd)).collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.fingerprint, r.component_id))
    assert by[1] == by[2] == by[3] == [("0" * 16, 1)]
    assert by[5] == [by[6][0]] * 2 and by[6][0][1] == 5
    assert sorted(by[None], key=str)[0] == ("0" * 16, 1)
    assert s.op7_simhash(spark, save(documents=empty)).count() == 0


def test_keep_one(spark, make_docs, odd, empty):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(300)]
    near = base[:150] + ["changed"] + base[151:]
    other = [word() for _ in range(300)]
    half = base[:180] + other[180:]
    docs = make_docs([(9, " ".join(base)), (3, " ".join(base)), (4, " ".join(near)), (5, " ".join(other)), (6, " ".join(half))])
    assert sorted(r.doc_id for r in s.keep_one(docs).collect()) == [3, 5, 6]
    assert s.keep_one(docs).columns == docs.columns
    kept = s.keep_one(odd).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "4", "5", "None"]
    assert s.keep_one(empty).count() == 0


def jaccard(x, y, words=5):
    x, y = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (x.split(), y.split()))
    return len(x & y) / len(x | y)


def brute_kept(texts, similarity=0.8):
    """Ids (places) that stay if every pair is compared."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and jaccard(texts[i], texts[j]) >= similarity:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return sorted(set(root))


def variants(n, seed=7, words=200, edits=6):
    """n texts that differ from one text by up to `edits` words each."""
    rng = random.Random(seed)
    base, out = [f"w{rng.randrange(5000)}" for _ in range(words)], []
    for k in range(n):
        w = list(base)
        for at in rng.sample(range(words), rng.randint(1, edits)):
            w[at] = f"v{k}x{at}"
        out.append(" ".join(w))
    return out


def test_keep_one_of_variants(spark, make_docs):
    """A link that fails the similarity check hides no other link."""
    texts = variants(300)
    kept = sorted(r.doc_id for r in s.keep_one(make_docs(list(enumerate(texts)))).collect())
    assert kept == brute_kept(texts)


def test_similar_in_blocks(spark):
    """Groups that are cut into blocks have the same classes as whole ones."""
    texts = variants(80)
    df = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "g long, node long, text string")
    for sizes in ((128, 24, 8 << 20), (8, 24, 8 << 20), (8, 3, 8 << 20), (128, 24, 5000)):
        found = {r.node: r.root for r in s.grouped(s.similar(df, 5, 0.8, *sizes), "node").collect()}
        assert sorted({found.get(i, i) for i in range(80)}) == brute_kept(texts)


def edited(rng, words, kind, similarity):
    """A text of random words and one of about that Jaccard similarity to it, by one kind of edit."""
    base = [f"w{rng.randrange(20_000)}" for _ in range(words)]
    share = (1 - similarity) / (1 + similarity)  # of the shingles of each that the other lacks
    new = lambda n: [f"n{rng.randrange(10**9)}" for _ in range(n)]
    if kind == "words":  # single words all over the text
        other = list(base)
        for at in rng.sample(range(words), max(1, round(words * share / 5))):
            other[at] = new(1)[0]
    elif kind == "appended":
        other = base + new(round(words * (1 - similarity) / similarity))
    else:  # a passage in another place
        at = rng.randrange(words // 2)
        n = max(1, round(words * share) - 4)
        other = base[:at] + new(n) + base[at + n :]
    return " ".join(base), " ".join(other)


def test_recall_by_kind_of_edit(spark, make_docs):
    """Pairs of similarity 0.8 to 0.86, 60 of each kind of edit and length; only those of 0.8 or more count."""
    rng, texts, pairs = random.Random(13), [], []
    for words in (60, 250, 800):
        for kind in ("words", "appended", "passage"):
            for _ in range(60):
                a, b = edited(rng, words, kind, rng.uniform(0.81, 0.86))
                if jaccard(a, b) >= 0.8:
                    pairs.append((len(texts), len(texts) + 1))
                texts += [a, b]
    assert len(pairs) > 300
    kept = {r.doc_id for r in s.keep_one(make_docs(list(enumerate(texts)))).collect()}
    missed = sum(b in kept for _, b in pairs)
    assert missed <= 0.02 * len(pairs)
    paired = {b for _, b in pairs}
    assert all(i in kept for i in range(len(texts)) if i not in paired)  # the others aren't alike


def test_classes_of_a_table_equal_all_pairs(spark, data):
    """Every link of 0.8 or more among the documents of the smallest table, by comparing all."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    texts = [t.lower() for _, t in rows]
    assert sorted(r.doc_id for r in s.keep_one(docs).collect()) == [rows[i][0] for i in brute_kept(texts)]


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_band_links_span_the_buckets(spark, batch):
    """Also where buckets lie across batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, batch)
    try:
        check_band_links(spark)
    finally:
        spark.conf.unset(name)


def check_band_links(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(40) + 1000 * k for k in range(3)]) for i in range(300)] + [(1000 + i, [7, 8, 9]) for i in range(50)]
    df = spark.createDataFrame(rows, "node long, keys array<long>").repartition(7)
    edges = {(r.u, r.v) for r in s.bands.links(df).collect()}
    root = {n: n for n, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    got = [find(n) for n, _ in rows]
    want = {n: n for n, _ in rows}
    first = {}
    for n, keys in rows:
        for k in keys:
            first.setdefault(k, n)
    changed = True
    while changed:
        changed = False
        for n, keys in rows:
            low = min([want[n], *(want[first[k]] for k in keys)])
            for m in [n, *(first[k] for k in keys)]:
                changed |= want[m] != low and (want.update({m: low}) is None)
    assert len(set(got)) == len(set(want.values()))
    assert len(edges) <= sum(len(k) for _, k in rows)
    assert s.bands.links(df.limit(0)).count() == 0
    assert abs(s.bands.probability(0.8, 32, 8) - 0.997) < 0.001


def repeated(n, words=2000, share=0.45, seed=11):
    """n texts of one fingerprint: a phrase makes up `share` of the words, the rest differs."""
    rng = random.Random(seed)
    phrase = ["alpha", "beta", "gamma"] * int(words * share / 3)
    return [" ".join(phrase + [f"x{rng.getrandbits(40):x}" for _ in range(words - len(phrase))]) for _ in range(n)]


def test_keep_one_checks_texts_of_one_fingerprint(spark, make_docs):
    """An equal fingerprint alone makes no duplicate; equal texts and near texts of it do."""
    texts = repeated(4)
    assert len({s.fingerprint(t) for t in texts}) == 1
    near = texts[2] + " more"
    assert s.fingerprint(near) == s.fingerprint(texts[2])
    docs = make_docs([*enumerate(texts), (4, texts[1]), (5, near)])
    assert sorted(r.doc_id for r in s.keep_one(docs).collect()) == [0, 1, 2, 3]
