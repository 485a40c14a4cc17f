import pytest
from pyspark.sql import types as T

from kinlink.llm import extract as x
from kinlink.llm.htmltext import blocks

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("host", T.StringType())])


def main(page):
    """What the markup alone decides; doubtful parts in brackets."""
    parts, places, _ = x.parse(page)
    return "\n".join(t if p < 0 else f"[{t}]" for t, p in zip(parts, places, strict=True))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav><ul><li>Home</ul></nav><article><h1>T &amp; U</h1><p>a <b>b</b>\n c</p><p>d</article><footer>f</footer>", "T & U\na b c\nd"),
        ("<article><p>one</p><script>var t='</p>';</script><style>p{}</style><p>two</p><!-- no --><form><input>no</form></article>", "one\ntwo"),
        ("<main><div class='ad'>no</div><p>yes</p><aside>no</aside><div id='newsletter-signup'>no</div></main>", "yes"),
        ("<div class='page has-sidebar'><main><p>yes</p></main><div class='sidebar'>no</div></div>", "yes"),
        ("<article><p>x</p><section class='comments'><p>no</p><article><p>no</p></article></section></article>", "x"),
        ("<article><p>un<a href='q", "un"),
        ("<article><p>a&nbsp;b&#233;&lt;i&gt;", "a bé<i>"),
        ("<article><ul><li>a<li>b<ul><li>c</ul></ul><table><tr><td>1<td>2</table>", "a\nb\nc\n1\n2"),
        ("<header><p>no</p></header><article><header><h1>T</h1></header><p hidden>no</p><p>y<br>z</p>", "T\ny z"),
        ("<article><p>a < b > c</p></article>", "a < b > c"),
        ("<form id=aspnetForm><nav>no</nav><article><p>yes</p><form><p>no</p></form></article></form>", "yes"),
        ("<form action=/><h1>T</h1><p>text</p></form>", "[T]\n[text]"),
        ("<article><p>yes</p><form><p>Subscribe to our letter</p><input></form></article>", "yes"),
        ("<article class='post tag-related category-ads'><p>yes</p></article>", "yes"),
        ("<article><p>yes</p></article><article class='comment'><p>no</p></article>", "yes"),
        ("<main><div class='search-results'><p>one</p></div><p id='reply'>two</p><h2 id=comments>three</h2></main>", "[one]\ntwo\nthree"),
        ("<main><div class='has-sidebar no-ads'><p>yes</p></div><div class='share-buttons'>x</div></main>", "yes\n[x]"),
        ("<article><p>yes</p></article><div>outside</div>", "yes"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, text):
    assert main(page) == text


def test_broken_markup_ends():
    for page in ("<", "<a", "<!--", "<p", "</", "<a b='", "<script>", "<![CDATA[", "<p/><<<>>", "<a " * 2000, "<div>" * 5000):
        blocks(page)


def longest_repeats(streams, run, least):
    """Covered tokens of each stream by all substrings of run tokens or more that `least` distinct streams hold, and the longest of them; by looking at all."""
    where = {}
    for t in set(map(tuple, streams)):
        for i in range(len(t)):
            for j in range(i + run, len(t) + 1):
                where.setdefault(t[i:j], set()).add(t)
    found = {k for k, v in where.items() if len(v) >= least}
    covered = [{n for i in range(len(t)) for j in range(i + run, len(t) + 1) if tuple(t[i:j]) in found for n in range(i, j)} for t in streams]
    return covered, found


def without(parts, places, covered, run):
    """Parts of a page without stretches of covered tokens of `run` or more, and without parts that are covered whole."""
    out = []
    for text, at in zip(parts, places, strict=True):
        words, keep, i = text.split(), [], 0
        while i < len(words):
            j = i
            while j < len(words) and at >= 0 and at + j in covered:
                j += 1
            if j - i < run and not (i == 0 and j == len(words)):
                keep += words[i : max(j, i + 1)]
            i = max(j, i + 1)
        out += [" ".join(keep)] if keep else []
    return "\n".join(out)


@pytest.mark.parametrize("seed", range(3))
def test_undecided_pages_against_all_substrings(spark, seed):
    """Pages of few words, so that repeats of all lengths occur; the array, its intervals and its longest prefixes."""
    import random

    rng = random.Random(seed)
    words = [f"w{n}" for n in range(40)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (4, 6, 9, 20, 30)]
    rows = []
    for n in range(60):
        body = []
        for _ in range(rng.randint(1, 6)):
            body.append(f"<{rng.choice(['p', 'div', 'nav'])}>" + (rng.choice(shared) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randint(1, 25)))) + "</p></div></nav>")
        if rng.random() < 0.3:
            body.append(f"<article><p>an article {n}</p><div class=widget>{rng.choice(shared)}</div><div class=social>{n} of its own</div></article>")
        rows.append((n, f"http://{rng.choice('ab')}.example/{n}", "".join(body), None, None))
    rows += rows[:5]
    df = spark.createDataFrame(rows, PAGES).repartition(5)
    run, got = 5, {}
    for r in x.main_text(df, run=run, repeats=3, depth=7).collect():
        got.setdefault(r.page_id, set()).add(r.text)
    for host in ("a", "b"):
        own = [(r[0], *x.parse(r[2])) for r in rows[:60] if x.host_of(r[1]) == f"{host}.example"]
        streams = [" ".join(stream).split() for _, _, _, stream in own]
        covered, found = longest_repeats(streams, run, 3)
        for (page, parts, places, _), cover in zip(own, covered, strict=True):
            assert got[page] == {without(parts, places, cover, run)}
        assert found
        hashed = [tuple(x.tokens([" ".join(t)])[4 * i : 4 * i + 4] for i in range(len(t))) for t in streams]
        walk = x.Neighbours(run, 3)
        suffixes = {}
        for k, t in enumerate(hashed):
            for i in range(len(t) - run + 1):
                suffixes.setdefault(b"".join(t[i : i + 12]), set()).add(hash(t))
        for suffix in sorted(suffixes):
            walk.add(host, suffix, sorted(suffixes[suffix])[:3])
        walk.end(border=True)
        best = {}
        for k in found:
            head = x.tokens([" ".join(k[:run])])
            best[head] = max(best.get(head, 0), min(12, len(k)))
        assert {h: n for _, h, n, p in walk.out if len(p) >= 3} == best


def test_menus_and_notices_of_a_host_go(spark):
    menu = "Home About our company Products Services Contact us today Imprint"
    notice = "We value your privacy and use small files to make this site work"
    body = [f"Story {i} tells of number {i * 7} and of nothing else at {i * 13} places in town" for i in range(6)]
    rows = [(i, "http://www.Host.example/a", f"<div>{menu}</div><p>{b}</p><div>{notice}</div>", None, None) for i, b in enumerate(body)]
    rows += [(10, "http://other.example/", f"<div>{menu}</div><p>alone</p>", None, None), (11, None, None, None, None), (12, "::bad", "", None, None), (0, "http://www.Host.example/a", rows[0][2], None, None)]
    df = spark.createDataFrame(rows, PAGES)
    got = sorted(((r.page_id, r.text) for r in x.main_text(df).collect()), key=str)
    want = [(i, b) for i, b in enumerate(body)] + [(0, body[0]), (10, f"{menu}\nalone"), (11, ""), (12, "")]
    assert got == sorted(want, key=str)


def test_copied_articles_stay(spark):
    page = "<article><p>the very same article on many pages of one host again</p></article>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", f"<nav>menu {i}</nav>{page}", None, None) for i in range(5)], PAGES)
    assert {r.text for r in x.main_text(df).collect()} == {"the very same article on many pages of one host again"}
    assert x.main_text(df.limit(0)).count() == 0


def test_query_equals_the_articles(spark, data):
    """On the given pages the article is what stands between its tags, block by block."""
    import html
    import re

    rows = {r.page_id: r for r in x.op10_extract(spark, data).collect()}
    for p in spark.read.parquet(f"{data}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", p.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", body)]
        assert rows[p.page_id].text == "\n".join(b for b in parts if b)
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text)


def test_articles_go_through_the_array(spark):
    """What a host's articles repeat is found by the array, and the check puts it back; unique ones have nothing repeated."""
    same = "the very same article of ten words on many pages"
    rows = [(i, f"http://h.example/{i}", f"<article><p>{same}</p><p>story {i}</p></article>", None, None) for i in range(5)]
    rows += [(9, "http://h.example/9", "<article><p>one that no other page of the host has at all</p></article>", None, None), (10, "http://o.example/", f"<article><p>{same}</p></article>", None, None)]
    got = {r.page_id: (r.text, r.n_repeated) for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {**{i: (f"{same}\nstory {i}", 11) for i in range(5)}, 9: ("one that no other page of the host has at all", 0), 10: (same, 0)}
    # undecided pages keep what only articles repeat
    rows += [(20, "http://h.example/20", f"<p>{same}</p>", None, None)]
    assert {r.text for r in x.main_text(spark.createDataFrame(rows, PAGES)).collect() if r.page_id == 20} == {same}


def test_equal_runs_have_equal_anchors():
    import numpy as np

    rng = np.random.default_rng(5)
    for run in (1, 2, 5, 8):
        stream = [f"w{n}" for n in rng.integers(0, 3, 300)]
        a = x.anchors("h", x.tokens([" ".join(stream)]), run)
        seen = {}
        for i in range(len(stream) - run + 1):
            assert seen.setdefault(tuple(stream[i : i + run]), a[i]) == a[i]
        assert len(a) == len(stream) - run + 1 and not len(x.anchors("h", b"", run))


def test_words_hash_alike_in_any_slice(monkeypatch):
    words = [f"w{n}" * (1 + n % 30) for n in range(300)] + ["é" * 200, "z" * 1000, "\ud800"]
    whole = x.hashed(" ".join(words))
    assert len(set(whole.tolist())) == len(words)
    monkeypatch.setattr(x, "SLICE", 50)
    assert x.hashed("\n".join(words)).tolist() == whole.tolist()
    assert x.tokens([]) == x.tokens([""]) == b""


def test_a_hot_run_is_a_few_suffixes_a_task(spark):
    """What many pages of a task share goes to the array for `repeats` of them, of the others go the places."""
    import numpy as np

    line = " ".join(f"word{n}" for n in range(20))
    rows = [(i, "http://h.example/", f"<article><p>start{i} {line} end{i}</p></article>", None, None) for i in range(200)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    read = df.selectExpr("page_id as row", "'h.example' as host", "'' as stream", f"concat('start', page_id, ' {line} end', page_id) as text", "cast(null as array<string>) as parts", "cast(null as array<int>) as places")
    full = spark.sparkContext.broadcast(x.pa.compress(np.full(1 << 23, 255, np.uint8).tobytes(), "zstd", asbytes=True))
    found = x.dealt(read, full, 4, 8, 3, 16).collect()
    runs = sum(int(x._unpacked(r.runs, np.uint32, r.n).sum()) for r in found)
    told = sum(r.n_told for r in found)
    assert runs + told == 200 * (22 - 8 + 1) and told == 197 * (20 - 8 + 1)
    assert sum(len(r.tokens) + sum(len(r[c]) for c in (*x.STRETCHES, *x.SETTLED)) for r in found) < 40_000  # each suffix with its page would be 200 KB
    assert {r.n_repeated for r in x.main_text(df).collect()} == {20}


def test_anchors_are_packed_to_under_three_bytes(spark):
    import numpy as np

    values = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 200_000, dtype=np.uint32))
    assert x._unpacked(x._packed(np.diff(values, prepend=np.uint32(0))), np.uint32, len(values)).cumsum(dtype=np.uint32).tolist() == values.tolist()
    assert len(x._packed(np.diff(values, prepend=np.uint32(0)))) < 3 * len(values)
