"""WARC derivatives: linked metadata and plain-text conversion records of response records.

parsed() turns WARC bytes (gzip members or plain) into records, one row each, one record in memory at a
time; read() does so for files. derive() makes of every response a metadata record and, if its body is
text or HTML, a conversion record. Both name the response in WARC-Refers-To and carry its target, its
date and the digests of what they hold; the metadata keeps the response's own headers (HTTP status, fields
and digests). serialise() writes a record as one gzip member, so any number of them can be put one after
the other.

Record ids of derivatives are name-based (UUID 5 of the response's id), so a task that runs again makes
the same records. Nothing is shuffled: a response's derivatives are made where it is read.

Edge cases: null bytes or a null body are empty ones; bytes that begin no record become a row with error
set, up to the next record; so does a record without a type or an id; a body cut short keeps what is there
and sets error; a gzip member that is broken or cut short adds a row with error set and nothing else. A
payload whose coding isn't known or doesn't decode has no conversion, and its metadata has error set. Other
record types have no derivatives; repeated responses give repeated records; an empty table gives none; other
columns are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.llm.common import map_rows, schema
from kinlink.llm.htmltext import blocks

HEADERS = T.MapType(T.StringType(), T.StringType())
RECORD = schema(record_type=T.StringType(), record_id=T.StringType(), target_uri=T.StringType(), date=T.StringType(), headers=HEADERS, body=T.BinaryType(), error=T.StringType())
#: Derivatives keep their source's place in the columns that the caller names.
DERIVED = T.StructType([*RECORD.fields, T.StructField("refers_to", T.StringType())])


def digest(data: bytes) -> str:
    """sha1 in base 32, as WARC files label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(record_id: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record_id} {kind}')}>"


def http_response(body: bytes, content_type: str = "text/html; charset=utf-8", status: str = "200 OK") -> bytes:
    return f"HTTP/1.1 {status}\r\nContent-Type: {content_type}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body


def split_http(data: bytes) -> tuple[str, dict[str, str], bytes, str | None]:
    """Status line, header fields (lower case; repeated ones joined) and payload of an HTTP message, and why it isn't decoded."""
    head, gap, payload = data.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = data.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            fields[name] = f"{fields[name]}, {value.strip()}" if name in fields else value.strip()
    body = payload if gap else b""
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    error = None
    for coding in reversed(fields.get("content-encoding", "").lower().split(",")):
        if body and not error:
            body, error = _decoded(body, coding.strip())
    return lines[0] if lines else "", fields, body, error


def _decoded(body: bytes, coding: str) -> tuple[bytes, str | None]:
    """body without a content coding; if that fails body as it is, and why."""
    try:
        if coding in ("", "identity"):
            return body, None
        if coding == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompressobj().decompress(body), None
        if coding in ("gzip", "x-gzip", "deflate"):
            d = zlib.decompressobj(31 if coding != "deflate" else 15 if body[:1] == b"\x78" else -15)
            plain = d.decompress(body) + d.flush()
            return (plain, None) if d.eof else (body, f"{coding}: cut short")
    except (zlib.error, ImportError) as e:
        return body, f"{coding}: {e}"
    except Exception as e:  # zstandard has an error class of its own
        if type(e).__module__.partition(".")[0] != "zstandard":
            raise
        return body, f"{coding}: {e}"
    return body, f"content coding {coding} isn't known"


def _unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        try:
            size = int(data[at:end].split(b";")[0], 16) if end >= 0 else 0
        except ValueError:
            return data
        if not size:
            return b"".join(out) if end >= 0 else data
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2


def plain_text(content_type: str, payload: bytes) -> str | None:
    """Visible text of an HTML payload, one block a line; plain text as it is; None for other types."""
    kind, _, rest = content_type.partition(";")
    kind = kind.strip().lower()
    if not (kind.startswith("text/") or kind == "application/xhtml+xml"):
        return None
    charset = rest.lower().partition("charset=")[2].strip(" \"'").partition(";")[0] or "utf-8"
    try:
        text = payload.decode(charset, "replace")
    except LookupError:
        text = payload.decode("utf-8", "replace")
    return "\n".join(b.text for b in blocks(text)) if "html" in kind else text


def plain_chunks(data: bytes, size: int = 1 << 20) -> Iterator[bytes | str]:
    """The bytes that data holds, gzip members or plain, in pieces; a string is an error."""
    view, at = memoryview(data), 0
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), size):
            yield bytes(view[at : at + size])
        return
    while at < len(data):
        if data[at : at + 2] != b"\x1f\x8b":
            yield "gzip: bytes that aren't a member"
            return
        member = zlib.decompressobj(31)
        try:
            while at < len(data) and not member.eof:
                piece = view[at : at + size]
                found = member.decompress(piece)
                at += len(piece) - len(member.unused_data)
                if found:
                    yield found
        except zlib.error as e:
            yield f"gzip: {e}"
            return
        if not member.eof:
            yield "gzip: member cut short"


class _Stream:
    """Bytes that come in pieces, read from the front; errors on the way are kept."""

    def __init__(self, chunks: Iterator[bytes | str]) -> None:
        self.chunks, self.held, self.errors = chunks, bytearray(), []

    def more(self) -> bool:
        for c in self.chunks:
            if isinstance(c, bytes):
                self.held += c
                return True
            self.errors.append(c)
        return False

    def until(self, mark: bytes, start: int = 0) -> int:
        """The first place of mark at start or later, -1 if there is none."""
        while (at := self.held.find(mark, start)) < 0:
            start = max(start, len(self.held) - len(mark) + 1)
            if not self.more():
                return -1
        return at

    def take(self, n: int) -> bytes:
        """The next n bytes, fewer at the end."""
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def parse(data: bytes) -> Iterator[dict]:
    """The records of WARC bytes, gzip members or plain; one is in memory at a time."""
    stream = _Stream(plain_chunks(data))
    while len(stream.held) >= 5 or stream.more() or stream.held:
        if stream.held[:2] == b"\r\n":
            stream.take(2)
            continue
        if len(stream.held) < 5 and stream.more():
            continue
        end = stream.until(b"\r\n\r\n") if stream.held[:5] == b"WARC/" else -1
        if end < 0:
            at = stream.until(b"\r\nWARC/")
            yield dict.fromkeys(RECORD.names) | {"error": "no header block", "body": stream.take(at if at >= 0 else len(stream.held))}
            continue
        headers = {}
        for line in stream.take(end + 4)[:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if colon:
                headers[name.strip().lower()] = value.strip()
        size = headers.get("content-length", "")
        sized = size.isascii() and size.isdecimal()
        body = stream.take(int(size)) if sized else b""
        error = "no content-length" if not sized else "cut short" if len(body) < int(size) else None if headers.get("warc-type") and headers.get("warc-record-id") else "no type or id"
        yield {
            "record_type": headers.get("warc-type"),
            "record_id": headers.get("warc-record-id"),
            "target_uri": headers.get("warc-target-uri"),
            "date": headers.get("warc-date"),
            "headers": headers,
            "body": body,
            "error": error,
        }
    for error in stream.errors:
        yield dict.fromkeys(RECORD.names) | {"error": error}


def serialise(headers: dict[str, str], body: bytes, compress: bool = True, level: int = 1) -> bytes:
    """A record as WARC 1.1 bytes; one gzip member if compress."""
    lines = "".join(f"{n}: {v}\r\n" for n, v in headers.items() if v is not None and n.lower() != "content-length")
    out = f"WARC/1.1\r\n{lines}Content-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    if not compress:
        return out
    member = zlib.compressobj(level, zlib.DEFLATED, 31)
    return member.compress(out) + member.flush()


def derivatives(record: dict) -> list[dict]:
    """Metadata and conversion of a response; none of any other record."""
    if record["record_type"] != "response" or not record["record_id"]:
        return []
    status, fields, payload, undecoded = split_http(bytes(record["body"] or b""))
    source = record["headers"] or {}
    block = source.get("warc-block-digest") or digest(bytes(record["body"] or b""))
    pay = source.get("warc-payload-digest") or digest(payload)
    text = plain_text(fields.get("content-type", ""), payload) if undecoded is None else None
    conversion = derived_id(record["record_id"], "conversion") if text is not None else None
    about = [
        ("http-status", status),
        *((f"http-header-{n}", v) for n, v in sorted(fields.items())),
        ("source-block-digest", block),
        ("source-payload-digest", pay),
        ("source-payload-length", str(len(payload))),
        *((("conversion", conversion),) if conversion else ()),
    ]
    out = []
    for kind, content_type, body in (
        ("metadata", "application/warc-fields", "".join(f"{n}: {' '.join(v.split())}\r\n" for n, v in about).encode()),
        ("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "surrogatepass") if text is not None else None),
    ):
        if body is None:
            continue
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": derived_id(record["record_id"], kind),
            "WARC-Refers-To": record["record_id"],
            "WARC-Target-URI": record["target_uri"],
            "WARC-Date": record["date"],
            "WARC-Block-Digest": digest(body),
            "Content-Type": content_type,
        }
        if kind == "conversion":
            headers["WARC-Payload-Digest"] = headers["WARC-Block-Digest"]
        out.append(
            {
                "record_type": kind,
                "record_id": headers["WARC-Record-ID"],
                "target_uri": record["target_uri"],
                "date": record["date"],
                "headers": {k: v for k, v in headers.items() if v is not None},
                "body": body,
                "error": record.get("error") or undecoded,
                "refers_to": record["record_id"],
            }
        )
    return out


def parsed(files: DataFrame, bytes_col: str, keep: str | None = None, batch_bytes: int = 16 << 20) -> DataFrame:
    """One row for each record of the WARC bytes in bytes_col, with the column `keep` beside it.

    Records leave in batches of about batch_bytes.
    """
    kept = [T.StructField(keep, files.schema[keep].dataType)] if keep else []
    out = T.StructType([*kept, *RECORD.fields])

    def rows(batches):
        for b in batches:
            made, held = {f.name: [] for f in out}, 0
            for n, content in enumerate(b[bytes_col]):
                for record in parse(content or b""):
                    for f in RECORD.names:
                        made[f].append(record[f])
                    if keep:
                        made[keep].append(b[keep][n])
                    held += len(record["body"] or b"")
                    if held > batch_bytes:
                        yield made
                        made, held = {f.name: [] for f in out}, 0
            yield made

    return map_rows(files.select(*[f.name for f in kept], bytes_col), rows, out)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the WARC files at path, with the file it is from.

    A file is a row of Spark's binary source and read by one task, so files are the unit of distribution and
    have to stay below that source's limit (2 GB); what they unpack to has no limit.
    """
    return parsed(spark.read.format("binaryFile").load(path).select("path", "content"), "content", "path")


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of the responses among records (columns of RECORD)."""
    need = records.where(F.col("record_type") == "response").select("record_type", "record_id", "target_uri", "date", "headers", "body", "error")

    def rows(batches):
        for b in batches:
            found = []
            for n in range(len(b["record_id"])):
                record = {k: v[n] for k, v in b.items()}
                record["headers"] = dict(record["headers"] or {})
                found += derivatives(record)
            yield {n: [list(r[n].items()) if n == "headers" else r[n] for r in found] for n in DERIVED.names}

    return map_rows(need, rows, DERIVED)


def members(records: DataFrame) -> DataFrame:
    """record_id and the gzip member of each of records; members one after the other are a WARC file."""

    def rows(batches):
        for b in batches:
            yield {"record_id": b["record_id"], "member": [serialise(dict(h or {}), bytes(body or b"")) for h, body in zip(b["headers"], b["body"], strict=True)]}

    return map_rows(records.select("record_id", "headers", "body"), rows, schema(record_id=T.StringType(), member=T.BinaryType()))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """A response record of each page, with its digests; the id names the page's id and url."""

    def rows(batches):
        for b in batches:
            found = []
            for page, url, text in zip(b["page"], b["url"], b["html"], strict=True):
                payload = (text or "").encode("utf-8", "surrogatepass")
                body = http_response(payload)
                record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>"
                headers = [("warc-type", "response"), ("warc-record-id", record_id), ("warc-date", date), ("content-type", "application/http; msgtype=response")]
                headers += [("warc-block-digest", digest(body)), ("warc-payload-digest", digest(payload))] + ([("warc-target-uri", url)] if url is not None else [])
                found.append({"page_id": page, "record_type": "response", "record_id": record_id, "target_uri": url, "date": date, "headers": headers, "body": body, "error": None})
            yield {n: [r[n] for r in found] for n in ["page_id", *RECORD.names]}

    source = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_rows(source, rows, T.StructType([T.StructField("page_id", T.LongType()), *RECORD.fields]))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """Both derivatives of the response record of every page, written as a gzip member and read again.

    Pages have no date of their own; the records have that of responses().
    """
    members_ = members(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    made = derive(parsed(members_, "member"))
    return made.select(
        "record_type",
        "record_id",
        "refers_to",
        "target_uri",
        "date",
        F.col("headers")["WARC-Block-Digest"].alias("block_digest"),
        F.col("headers")["Content-Type"].alias("content_type"),
        F.length("body").cast("long").alias("n_bytes"),
        F.decode("body", "utf-8").alias("content"),
    )
