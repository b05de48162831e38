"""WARC derivative builder.

From each response record come two derived records: a `metadata` record, linked to the response by
WARC-Refers-To, with the source's headers as fields, and a `conversion` record with the page's
plain text. Both keep the source's target URI and date, and carry the source's block and payload
digests beside their own. All of the source's header lines, WARC and HTTP, repeated ones included,
stand in the metadata record in their order. Record identifiers are name-based UUIDs of (source
identifier, type), so a rerun or a recomputed partition builds the same bytes.

`derive_records` takes any response records (a binary column, as `read_records` gives them);
`derivatives` makes response records of crawled pages first and goes the same way. Work is row by
row: nothing is shuffled, and a task holds one batch.

The body is read after transfer and content coding (chunked, gzip, deflate; at most BODY bytes are
unpacked, and a body beyond that or of another coding is an error), in the charset that the
Content-Type names, else UTF-8, bad bytes replaced.

Defined cases: a record that is null, cannot be parsed, is no response, or whose block does not match
the digest that it states gives one row of type `error` with the reason, and the job goes on; a
missing block digest is computed, one of an unknown algorithm is carried unchecked; a missing date,
URI or identifier is left out or made from the record's bytes. For pages: a null url or html counts
as empty; a null page_id gives the same records with page id `-`; rows that repeat give records that
repeat; a page without text gives a conversion record with an empty block; other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps

#: The date of every record of a crawled page.
DATE = "2020-01-01T00:00:00Z"
#: Bytes that a coded body may unpack to; rows and bytes of one step.
BODY, ROWS, STEP_BYTES = 256 << 20, 200, 8 << 20
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:sessionloom:warc")
#: Elements whose text is not shown; those that only stand in the head; those that begin a line.
_SKIP = {"script", "style", "noscript", "template", "head", "svg"}
_IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "br", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul",
}


class _Text(HTMLParser):
    """Shown text. The head ends where the body's content begins, also without tags that say so;
    drawings end at a block element; what an unclosed `noscript` or drawing held is text after all."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[tuple[str, list[str]]] = []
        self.title: list[str] | None = None
        self.titled = ""

    def _leave_head(self) -> None:
        if self.skip and self.skip[-1][0] == "head":
            self.skip.pop()

    def handle_starttag(self, tag, attrs):
        if tag == "title" and not self.titled and not any(t == "svg" for t, _ in self.skip):
            self.title = []
            return
        if tag not in _IN_HEAD and tag not in ("head", "html"):
            self._leave_head()
        if tag == "body":
            self.skip.clear()
        elif tag in _SKIP:
            self.skip.append((tag, []))
        elif tag in _BLOCK:
            while self.skip and self.skip[-1][0] == "svg":
                self.skip.pop()
            self._say("\n")

    def handle_startendtag(self, tag, attrs):
        if tag in _BLOCK or tag == "body":
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "title" and self.title is not None:
            self.titled, self.title = " ".join("".join(self.title).split()), None
        elif tag in _SKIP:
            at = max((k for k, (t, _) in enumerate(self.skip) if t == tag), default=None)
            if at is not None:
                del self.skip[at:]
        elif tag in _BLOCK:
            self._say("\n")

    def _say(self, data: str) -> None:
        (self.skip[-1][1] if self.skip else self.out).append(data)

    def handle_data(self, data):
        if self.title is not None:
            self.title.append(data)
            return
        if data.strip():
            self._leave_head()
        self._say(data)

    def close(self):
        super().close()
        if self.title is not None:  # never closed: it held the rest of the page
            self.out += self.title
        hidden = {"script", "style", "template"}
        for k, (_, held) in enumerate(self.skip):
            if not hidden & {t for t, _ in self.skip[: k + 1]}:
                self.out += held


def plain_text(html: str) -> tuple[str, str]:
    """(title, text): a line for each block with text, blanks collapsed."""
    p = _Text()
    p.feed(html)
    p.close()
    lines = (" ".join(x.split()) for x in "".join(p.out).split("\n"))
    return p.titled, "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, rid: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """The bytes of one WARC/1.1 record."""
    clean = lambda v: re.sub(r"[\r\n]+", " ", v)
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), *fields, ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def _header_lines(head: str) -> list[tuple[str, str]]:
    """(name, value) of each header line, in order; lines that begin with a blank continue the one before."""
    out: list[tuple[str, str]] = []
    for line in head.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def parse_lines(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(header lines, block) of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    try:
        named = head.decode("utf-8")
    except UnicodeDecodeError:
        named = head.decode("latin-1")
    first, _, lines = named.partition("\r\n")
    if not first.startswith("WARC/") or not gap:
        raise ValueError("not a WARC record")
    fields = _header_lines(lines)
    size = next((v for k, v in fields if k.lower() == "content-length"), "")
    if not size.isdecimal() or len(rest) < int(size) or rest[int(size) :].strip(b"\r\n"):
        raise ValueError("the block does not have its stated length")
    return fields, rest[: int(size)]


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of one record; of a repeated field, the last."""
    fields, block = parse_lines(data)
    return dict(fields), block


def matches(stated: str, data: bytes) -> bool:
    """Whether `algorithm:value`, in base 32 or hex, is the digest of data; True where the algorithm is not known."""
    name, _, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(name, data).digest()
    return value.strip().lower() in (own.hex(), base64.b32encode(own).decode().lower(), base64.b32encode(own).decode().lower().rstrip("="))


def _unpacked(data: bytes, wbits: int) -> bytes:
    got = zlib.decompressobj(wbits)
    out = got.decompress(data, BODY)
    if got.unconsumed_tail:
        raise ValueError(f"the body unpacks to more than {BODY} bytes")
    return out


def _dechunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size):
            raise ValueError("a chunk has no size")
        if int(size, 16) == 0:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + int(size, 16)])
        at = end + 4 + int(size, 16)


def body_text(headers: list[tuple[str, str]], body: bytes) -> str:
    """The body's characters, after transfer and content coding."""
    named = {k.lower(): v for k, v in headers}
    if "chunked" in named.get("transfer-encoding", "").lower():
        body = _dechunked(body)
    coding = named.get("content-encoding", "").strip().lower()
    if coding in ("gzip", "x-gzip"):
        body = _unpacked(body, 31)
    elif coding == "deflate":
        body = _unpacked(body, 15 if body[:1] == b"\x78" else -15)
    elif coding not in ("", "identity"):
        raise ValueError(f"the body has the unknown coding {coding}")
    charset = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", named.get("content-type", ""), re.I)
    try:
        return body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def response(page_id, url: str | None, html: str | None) -> bytes:
    """A response record for a crawled page."""
    body = (html or "").encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    rid = uuid.uuid5(_SPACE, f"response {'-' if page_id is None else page_id} {url or ''}").urn
    fields = [("WARC-Date", DATE), ("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", digest(body)), ("Content-Type", "application/http; msgtype=response")]
    return record("response", rid, fields, http + body)


def derive(source: bytes) -> tuple[bytes, bytes]:
    """(metadata record, conversion record) of one response record.

    Raises ValueError where the source is no response record or its block does not match its digest.
    """
    lines, block = parse_lines(source)
    fields = {k.lower(): v for k, v in reversed(lines)}  # of a repeated field, the first
    if fields.get("warc-type", "").lower() != "response":
        raise ValueError("not a response record")
    stated = fields.get("warc-block-digest")
    if stated and not matches(stated, block):
        raise ValueError("the source's block does not match its digest")
    http, _, body = block.partition(b"\r\n\r\n")
    status, _, rest = http.decode("latin-1").partition("\r\n")
    headers = _header_lines(rest)
    title, text = plain_text(body_text(headers, body))
    rid = fields.get("warc-record-id") or f"<{uuid.uuid5(_SPACE, 'source ' + digest(source)).urn}>"
    date, uri = fields.get("warc-date"), fields.get("warc-target-uri")
    linked = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", rid), ("WARC-Refers-To-Target-URI", uri), ("WARC-Refers-To-Date", date)]
    linked = [(k, v) for k, v in linked if v is not None]
    named = lambda kind: uuid.uuid5(_SPACE, f"{kind} {rid}").urn
    block_digest, payload = stated or digest(block), fields.get("warc-payload-digest") or digest(body)
    meta = [
        f"source-status: {status}",
        *(f"source-header-{k}: {v}" for k, v in headers),
        *(f"source-warc-{k}: {v}" for k, v in lines),
        f"source-block-digest: {block_digest}",
        f"source-payload-digest: {payload}",
        f"title: {title}",
        f"text-bytes: {len(text.encode('utf-8', 'surrogatepass'))}",
    ]
    metadata = record("metadata", named("metadata"), [*linked, ("Content-Type", "application/warc-fields")], ("\r\n".join(meta) + "\r\n").encode("utf-8"))
    digests = [("WARC-Source-Block-Digest", block_digest), ("WARC-Source-Payload-Digest", payload)]
    conversion = record("conversion", named("conversion"), [*linked, *digests, ("Content-Type", "text/plain; charset=utf-8")], text.encode("utf-8", "surrogatepass"))
    return metadata, conversion


_ROW = "record_type string, record_id string, refers_to string, target_uri string, source_payload_digest string, block_digest string, content_length long, record binary, error string"
_TYPES = (*[pa.string()] * 6, pa.int64(), pa.binary(), pa.string())


def _rows(source: bytes | None) -> list[tuple]:
    """What a reader of each derived record finds, and the record itself; or one row with the error."""
    try:
        if source is None:
            raise ValueError("no record")
        out, payload = [], None
        for data in derive(source):
            f, block = parse(data)
            payload = payload or re.search(rb"^source-payload-digest: ([^\r]*)\r$", block, re.M)[1].decode("utf-8", "replace")
            out.append((f["WARC-Type"], f["WARC-Record-ID"][1:-1], f["WARC-Refers-To"].strip("<>"), f.get("WARC-Target-URI"), payload, f["WARC-Block-Digest"], len(block), data, None))
        return out
    except (ValueError, zlib.error, EOFError, AssertionError) as e:
        return [("error", None, None, None, None, None, None, None, str(e) or type(e).__name__)]


def derive_records(records: DataFrame, record: str = "record", keep: tuple = ()) -> DataFrame:
    """Two rows for each response record, with the kept columns first; one `error` row for any other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "r", ROWS, STEP_BYTES):
                at, out = [], []
                for k, data in enumerate(part.column("r").to_pylist()):
                    for row in _rows(data):
                        at.append(k)
                        out.append(row)
                cols = [part.column(f"k{i}").take(pa.array(at, pa.int64())) for i in range(len(keep))]
                cols += [pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]
                yield pa.RecordBatch.from_arrays(cols, names=[*(f"k{i}" for i in range(len(keep))), *_NAMES])

    rows = records.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{record}`").cast("binary").alias("r"))
    kept = [f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(rows.schema.fields[:-1])]
    return rows.mapInArrow(run, ", ".join([*kept, _ROW])).toDF(*keep, *_NAMES)


_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def derivatives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """The derived records of the pages' response records, by page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in steps(b, "h", ROWS, STEP_BYTES):
                made = [response(i, u, h) for i, u, h in zip(*(part.column(c).to_pylist() for c in ("i", "u", "h")))]
                at, out = [], []
                for i, data in zip(part.column("i").to_pylist(), made):
                    for row in _rows(data):
                        at.append(i)
                        out.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *[pa.array(c, t) for c, t in zip(zip(*out), _TYPES)]], names=["page_id", *_NAMES])

    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("i"), F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{html}`").cast("string").alias("h"))
    return rows.mapInArrow(run, f"page_id long, {_ROW}")


def split_records(f: io.BufferedIOBase) -> Iterator[bytes]:
    """The records of an open, uncompressed WARC file, one at a time."""
    while line := f.readline():
        if not line.strip():
            continue
        head = [line]
        while (line := f.readline()) and line.strip():
            head.append(line)
        size = next((int(x.split(b":")[1]) for x in head if x.lower().startswith(b"content-length:") and x.split(b":")[1].strip().isdigit()), 0)
        yield b"".join(head) + b"\r\n" + f.read(size) + b"\r\n\r\n"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, place and record of every record in the WARC files under path, gzipped or not.

    A file is read by one task, record by record; its packed bytes are in memory (at most 2 GB).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b.column("path").to_pylist(), b.column("content")):
                data = raw.as_buffer()
                own = io.BufferedReader(pa.BufferReader(data))
                own = gzip.GzipFile(fileobj=own) if data[:2].to_pybytes() == b"\x1f\x8b" else own
                for k, one in enumerate(split_records(own)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([one], pa.binary())], names=["path", "place", "record"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, place long, record binary")
