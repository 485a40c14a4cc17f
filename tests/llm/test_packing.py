import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinlink.llm import packing as p

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    texts = ["Don't STOP, it's <|endoftext|>. a<|startoftext|>,x İstanbul' 3.14% é! É́.. foo bar. \x1c\x85 tab\there 'S 'Re he'LL. ...", "", " ", "\n\n", "ß. ΣΑΣ, ΣΑΣ", "x" * 300 + "!!", "don'ts. 's 's, ''s", "The the THE the. the, The.", None]
    for kept in (3, 100_000):
        e = p.Encoder(PATH, kept=kept)
        for text in texts * 2:
            assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids + [0]


def test_encoder_equals_the_tokenizer_after_every_letter():
    """Every letter and digit of Unicode before marks; some have a small or composed form that ends in a mark."""
    t, e = Tokenizer.from_file(PATH), p.Encoder(PATH)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalnum()]
    for tail in ("-", '"', "'s", "!?"):
        for c, want in zip(letters, t.encode_batch([f"a{c}{tail}" for c in letters], add_special_tokens=False), strict=True):
            assert np.frombuffer(e.encode(f"a{c}{tail}"), "<u4").tolist() == [*want.ids, 0], (c, tail)
    text = 'İSTANBULLULAR VE TÜRKİ, ANKARALI "İ" İ<'
    assert np.frombuffer(e.encode(text), "<u4").tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]


def places(plan, histogram):
    """Bins as lists of (offset, length)."""
    bins = {}
    for length, n in histogram.items():
        own = plan[plan[:, 0] == length]
        for rank in range(n):
            x = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            nth = rank - x[1]
            bins.setdefault(int(x[3] + nth // x[2]), []).append((int(x[4] + nth % x[2] * length), length))
    return bins


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_plan_keeps_every_constraint(rule):
    rng = random.Random(3)
    for _ in range(150):
        h = {rng.randint(1, 50): rng.randint(1, 200) for _ in range(rng.randint(1, 30))}
        documents, attention = rng.choice([None, 3, 7]), rng.choice([None, 3000])
        for content in places(p.plan(h, 60, documents, attention, rule, (1, 0.5, 0.5)), h).values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= 60 and len(content) <= (documents or 60)
            assert attention is None or sum(x * x for _, x in content) <= attention


def test_plan_is_best_fit():
    """The same number of bins as best-fit decreasing, one piece at a time."""
    rng = random.Random(5)
    for _ in range(60):
        h = {rng.randint(1, 40): rng.randint(1, 30) for _ in range(12)}
        left = []
        for length in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
            fits = [r for r in left if r >= length]
            if fits:
                left.remove(min(fits))
            left.append((min(fits) if fits else 40) - length)
        assert len(places(p.plan(h, 40), h)) == len(left)


@pytest.mark.parametrize("rule", ["residual_norm", "dot_product"])
def test_plan_is_vector_best_fit(rule):
    """Bin by bin what vector best-fit gives that looks at every bin for every piece."""
    rng = random.Random(11)
    for _ in range(40):
        h = {rng.randint(1, 30): rng.randint(1, 12) for _ in range(8)}
        documents, attention = rng.choice([2, 3, 5]), rng.choice([400, 900, 1300])
        w, cap = [rng.uniform(0.2, 2) for _ in range(3)], (40, documents, attention)
        if max(h) ** 2 > attention:
            continue
        left = []
        for length in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
            need = (length, 1, length * length)
            score = lambda r: -sum(a * ((b - n) / c) ** 2 for a, b, n, c in zip(w, r, need, cap)) if rule == "residual_norm" else sum(a * n * b / c**2 for a, b, n, c in zip(w, r, need, cap))  # noqa: B023, E731
            fits = [r for r in left if all(x >= n for x, n in zip(r, need))]
            best = max(fits, key=score) if fits else cap
            if fits:
                left.remove(best)
            left.append(tuple(x - n for x, n in zip(best, need)))
        content = places(p.plan(h, 40, documents, attention, rule, tuple(w)), h).values()
        got = [(40 - sum(x for _, x in c), documents - len(c), attention - sum(x * x for _, x in c)) for c in content]
        assert sorted(got) == sorted(left)


def test_every_capacity_binds_on_documents(spark, data):
    """Real documents where the number of sequences is set by tokens, by documents and by attention."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    plain = p.pack(docs, PATH).toPandas()
    for more, used in (({"documents": 3}, lambda g: len(g) == 3), ({"attention": 300_000}, lambda g: (g.length**2).sum() > 250_000)):
        got = p.pack(docs, PATH, weights=(1.0, 0.5, 0.5), **more).toPandas()
        groups = [g for _, g in got.groupby("sequence_id")]
        assert got.length.sum() == plain.length.sum() and got.sequence_id.nunique() > plain.sequence_id.nunique()
        assert all(g.length.sum() <= 2048 and len(g) <= more.get("documents", 2048) and (g.length**2).sum() <= more.get("attention", 2048**2) for g in groups)
        assert sum(map(used, groups)) > 0.3 * len(groups)


def test_impossible_piece():
    with pytest.raises(ValueError, match="fits no bin"):
        p.plan({50: 1}, 40)


def test_query(spark, odd, make_docs, empty, save):
    t = Tokenizer.from_file(PATH)
    rows = p.op6_packing(spark, save(documents=odd)).toPandas()
    want = []
    for r in odd.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(r.doc_id), n, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for n, a in enumerate(range(0, len(ids), 2048))]
    ids = rows.doc_id.map(lambda x: "None" if x != x else str(int(x)))
    assert sorted(zip(ids, rows.piece, rows.start, rows.length, rows.ids_crc32, strict=True)) == sorted(want)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert rows.sequence_id.nunique() == -(-rows.length.sum() // 2048)
    assert p.op6_packing(spark, save(documents=empty)).count() == 0


def test_attention_bounds_pieces(spark, make_docs):
    rows = p.pack(make_docs([(1, "a b c d e f g h i j k l")]), PATH, tokens=100, attention=25).toPandas()
    assert rows.length.max() <= 5 and rows.length.sum() == 13
