import gzip

from kinlink.llm import warc as w


def response(uri="http://a.example/", body=b"<p>Hi <b>there</b></p><script>x</script>", kind="text/html; charset=utf-8", rid="<urn:uuid:1>"):
    http = w.http_response(body, kind)
    return {"WARC-Type": "response", "WARC-Record-ID": rid, "WARC-Target-URI": uri, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Block-Digest": w.digest(http), "Content-Type": "application/http; msgtype=response"}, http


def test_round_trip():
    headers, http = response()
    for compress in (True, False):
        data = w.serialise(headers, http, compress) + w.serialise({"WARC-Type": "warcinfo", "WARC-Record-ID": "<i>"}, b"x", compress)
        a, b = w.parse(data)
        assert a["body"] == http and a["error"] is None and a["headers"]["warc-block-digest"] == headers["WARC-Block-Digest"]
        assert b["record_type"] == "warcinfo" and b["body"] == b"x"


def test_broken_records():
    headers, http = response()
    data = w.serialise(headers, http, False)
    assert [r["error"] for r in w.parse(data[:-20])] == ["cut short"]
    assert [r["error"] for r in w.parse(b"junk")] == ["no header block"]
    assert [r["error"] for r in w.parse(b"WARC/1.0\r\nA: b\r\n\r\n")] == ["no content-length"]
    assert list(w.parse(b"")) == []
    assert any(r["error"] for r in w.parse(gzip.compress(b"WARC/1.0")[:-12] + b"\x00" * 4))
    # what follows bytes of no record is read, and a member that is cut is told even if its record is whole
    assert [r["error"] for r in w.parse(b"junk\r\n" + data + b"more junk")] == ["no header block", None, "no header block"]
    member = w.serialise(headers, http)
    for cut in (1, 8, 9):
        got = list(w.parse(member + member[:-cut]))
        assert got[0]["error"] is None and got[-1]["error"] == "gzip: member cut short" and got[0]["body"] == http
    assert [r["error"] for r in w.parse(member + b"junk")] == [None, "gzip: bytes that aren't a member"]
    assert [r["error"] for r in w.parse(member + member[:30] + b"\xff" * 40 + member[70:])][0] is None
    assert list(w.parse(b"\r\n\r\n")) == [] and [r["error"] for r in w.parse(b"WARC")] == ["no header block"]


def test_one_record_at_a_time():
    """Bytes that unpack to 400 times their size are read without holding them."""
    import tracemalloc

    headers, _ = response()
    big = w.serialise(headers, b"x" * 5_000_000)
    data = big * 40
    tracemalloc.start()
    sizes = [len(r["body"]) for r in w.parse(data)]
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert sizes == [5_000_000] * 40 and peak < 40_000_000


def test_http_bodies():
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n"
    z = gzip.compress(b"hello")
    body = b"%x\r\n%s\r\n0\r\n\r\n" % (len(z), z)
    assert w.split_http(chunked + body)[2] == b"hello"
    assert w.split_http(b"")[2] == b""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nContent-Encoding: %s\r\n\r\n"
    for coding, data in ((b"br", b"\x0b\x02\x80hello\x03"), (b"gzip", z[:-3]), (b"gzip", b"not gzip"), (b"zstd", b"not zstd"), (b"deflate", b"x")):
        _, _, payload, error = w.split_http(head % coding + data)
        assert payload == data and error
        made = w.derivatives({"record_type": "response", "record_id": "<i>", "target_uri": None, "date": None, "headers": {}, "body": head % coding + data, "error": None})
        assert [(m["record_type"], m["error"]) for m in made] == [("metadata", error)]
    zstd = __import__("zstandard").compress(b"hello")
    assert w.split_http(head % b"zstd" + zstd)[2:] == (b"hello", None)
    assert w.split_http(head % b"gzip, zstd" + __import__("zstandard").compress(z))[2:] == (b"hello", None)
    assert w.plain_text("text/html", "<p>é</p>".encode()) == "é"
    assert w.plain_text("text/plain; charset=nonsense", b"x") == "x"
    assert w.plain_text("image/png", b"x") is None


def test_derivatives_are_linked(spark, tmp_path):
    parts = [response(), response("http://b.example/i.png", b"\x89PNG", "image/png", "<urn:uuid:2>")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc.gz").write_bytes(b"".join(w.serialise(*p) for p in parts))
    (tmp_path / "in/b.warc").write_bytes(b"not a record")
    records = w.read(spark, str(tmp_path / "in"))
    assert records.count() == 3
    made = w.derive(records)
    got = {(r.record_type, r.refers_to): r for r in made.collect()}
    assert set(got) == {("metadata", "<urn:uuid:1>"), ("conversion", "<urn:uuid:1>"), ("metadata", "<urn:uuid:2>")}
    conversion, about = got["conversion", "<urn:uuid:1>"], bytes(got["metadata", "<urn:uuid:1>"].body).decode()
    assert bytes(conversion.body) == b"Hi there"
    assert conversion.headers["WARC-Block-Digest"] == w.digest(b"Hi there")
    assert f"conversion: {conversion.record_id}\r\n" in about and f"source-block-digest: {parts[0][0]['WARC-Block-Digest']}\r\n" in about
    assert "http-status: HTTP/1.1 200 OK\r\n" in about and "http-header-content-type: text/html; charset=utf-8\r\n" in about
    # the members one after the other are a WARC file again
    back = list(w.parse(b"".join(bytes(r.member) for r in w.members(made).collect())))
    assert sorted(r["record_id"] for r in back) == sorted(r.record_id for r in got.values())
    assert all(r["headers"]["warc-block-digest"] == w.digest(r["body"]) for r in back)


def test_bytes_of_any_kind(spark):
    headers, http = response()
    rows = [(1, None, "x"), (2, b"", "x"), (3, w.serialise(headers, http) * 2, "x"), (3, w.serialise(headers, http) * 2, "x"), (4, b"junk", None)]
    df = spark.createDataFrame(rows, "n long, data binary, record_id string")
    got = w.parsed(df, "data", "n").collect()
    assert sorted((r.n, r.error) for r in got if r.error) == [(4, "no header block")]
    assert [r.record_id for r in got if not r.error] == ["<urn:uuid:1>"] * 4
    assert len(w.parsed(df, "data", "n", batch_bytes=1).collect()) == 5
    assert w.parsed(df.limit(0), "data").count() == 0
    assert w.derive(w.parsed(df, "data")).count() == 8


def test_query(spark, data, save):
    rows = w.op4_warc(spark, data).toPandas()
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas()
    assert len(rows) == 2 * len(pages)
    conv = rows[rows.record_type == "conversion"].set_index("target_uri")
    from kinlink.llm.htmltext import blocks

    for p in pages.head(20).itertuples():
        text = "\n".join(b.text for b in blocks(p.html))
        got = conv.loc[[p.url]]
        assert text in got.content.tolist()
        assert w.digest(text.encode()) in got.block_digest.tolist()
    odd = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "y"), (1, None, None, "x")], "page_id long, url string, html string, record_id string")
    assert w.op4_warc(spark, save(pages=odd)).count() == 6
    assert w.op4_warc(spark, save(pages=odd.limit(0))).count() == 0
