"""Derived web-archive records: metadata and plain text for each archived response.

A response becomes a ``metadata`` record, with what its headers and markup say, and, if it
is a text, a ``conversion`` record with its plain text. Both name the response they come
from, keep its address, date and payload digest, and carry digests of their own blocks.
Record identifiers follow from the response's identifier, so a second run makes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What :func:`derive` needs: ``block`` is the whole HTTP response, head and body.
RESPONSE = ["record_id", "target_uri", "date", "block"]

#: The columns of derived records; ``headers`` are the lines of the record's head.
RECORD = (
    "record_id string, record_type string, refers_to string, target_uri string, date string,"
    " content_type string, content_length long, block_digest string,"
    " source_payload_digest string, headers string, block binary"
)

# Elements that begin a new line, and those whose content is no text.
_BLOCKS = (
    "address article aside blockquote body br caption dd div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section"
    " select summary table tbody td tfoot th thead title tr ul"
).split()
_SILENT = "script style template noscript svg math".split()

_COMMENT_END = re.compile(r"--!?>")
_QUIET = re.compile(rf"<(!--|(?:{'|'.join(_SILENT)}|/?head|body)(?=[\s/>]))", re.I)
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in _SILENT}
_UNQUOTED_END = re.compile(r"""=\s*+[^\s"'>]++\Z""")
_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_BREAK = re.compile(rf"</?(?:{'|'.join(_BLOCKS)})(?=[\s/>]){_ATTRIBUTES}>", re.I)
_TAG = re.compile(rf"</?[a-zA-Z]{_ATTRIBUTES}>|<[/!?a-zA-Z][^>]*+(?:>|\Z)")
_TITLE = re.compile(r"<title\b[^>]*+>(.*?)(?:</title\s*+>|\Z)", re.S | re.I)
_HREF = re.compile(r"""<a\s(?:[^>]*?\s)?href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"']++)""", re.I)
_PLAIN_PATH = re.compile(r"/(?:[\w~!$&'()*+,=:@%-][\w~!$&'()*+,=:@%/-]*+)?", re.A)
_META_CHARSET = re.compile(rb"""<meta\s[^>]*?charset\s*=\s*["']?([\w.:-]+)""", re.I)
_LANG = re.compile(r"""<html\s[^>]*?\blang\s*=\s*["']?([\w-]+)""", re.I)


def digest(data: bytes) -> str:
    """SHA-1 in base 32, as archives label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def split_response(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers in order, and body of an HTTP response."""
    head, mark, body = block.partition(b"\r\n\r\n")
    if not mark:
        head, mark, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    headers = [
        (name.strip(), value.strip())
        for name, colon, value in (line.partition(":") for line in lines[1:])
        if colon
    ]
    return (lines[0].strip() if lines else ""), headers, body


def payload(headers: list[tuple[str, str]], body: bytes) -> bytes:
    """The body without transfer and content coding; what cannot be undone stays as it is."""
    given = {name.lower(): value.lower() for name, value in headers}
    if "chunked" in given.get("transfer-encoding", ""):
        body = _unchunked(body)
    coding = given.get("content-encoding", "")
    try:
        if "gzip" in coding:
            return gzip.decompress(body)
        if "deflate" in coding:
            return zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return body


def _unchunked(body: bytes) -> bytes:
    rest, parts = io.BytesIO(body), []
    while line := rest.readline():
        try:
            size = int(line.split(b";")[0].strip() or b"0", 16)
        except ValueError:
            return body  # not chunked after all
        if size == 0:
            break
        parts.append(rest.read(size))
        rest.readline()
    return b"".join(parts)


def decoded(headers: list[tuple[str, str]], body: bytes) -> tuple[str, str]:
    """Text of a body, and the charset: of the header, else of the markup, else UTF-8."""
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    found = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", kind, re.I)
    charset = found[1] if found else ""
    if not charset and (marked := _META_CHARSET.search(body[:4096])):
        charset = marked[1].decode("ascii", "replace")
    for name in (charset, "utf-8"):
        try:
            return body.decode(name, "replace"), name.lower()
        except LookupError:
            continue
    raise AssertionError("UTF-8 is always known")


def visible(markup: str, *, xml: bool = False) -> str:
    """Markup without comments and elements whose content is no text.

    What begins first counts: a comment in a script is script, a script in a comment is comment. The
    head ends at ``</head>`` or ``<body``. An element that is not closed loses its tag alone, but a script
    or style goes on to the end, and is never closed by its own tag unless ``xml``.
    """
    parts: list[str] = []
    at = place = 0  # all before ``at`` is in parts or left out; all before ``place`` is looked at
    head, unclosed = None, set()
    while found := _QUIET.search(markup, place):
        start, name = found.start(), found[1].lower()
        if name == "!--":
            end = _COMMENT_END.search(markup, start + 2)
            parts.append(markup[at:start])
            at = place = end.end() if end else len(markup)
            continue
        after = place = markup.find(">", start) + 1
        if not after:
            break
        if name in ("/head", "body"):
            if head is not None:
                parts[head:] = [" "]
                at, head = (after if name == "/head" else start), None
            continue
        tag = markup[start:after]
        closed = tag.endswith("/>") and not _UNQUOTED_END.search(tag[:-1])
        if name == "head":
            if head is None and not closed:
                parts.append(markup[at:start])
                at, head = start, len(parts)
            continue
        raw = name in ("script", "style")
        if not closed or (raw and not xml):
            end = None if name in unclosed else _CLOSING[name].search(markup, after)
            if end is None and not raw:
                unclosed.add(name)
                continue
            after = end.end() if end else len(markup)
        parts += [markup[at:start], " "]
        at = place = after
    parts.append(markup[at:])
    return "".join(parts)


def plain_text(shown: str) -> str:
    """The text of :func:`visible` markup: a line for each block, white space folded, no empty lines."""
    shown = _TAG.sub("", _BREAK.sub("\n", " ".join(shown.split())))
    lines = (" ".join(line.split()) for line in html.unescape(shown).split("\n"))
    return "\n".join(line for line in lines if line)


def _record(kind: str, source: dict, content_type: str, block: bytes, checksum: str) -> dict:
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{source['record_id']}#{kind}")
    record = {
        "record_id": f"<urn:uuid:{name}>",
        "record_type": kind,
        "refers_to": source["record_id"],
        "target_uri": source["target_uri"],
        "date": source["date"],
        "content_type": content_type,
        "content_length": len(block),
        "block_digest": digest(block),
        "source_payload_digest": checksum,
        "block": block,
    }
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", record["record_id"]),
        ("WARC-Refers-To", record["refers_to"]),
        ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Date", record["date"]),
        ("WARC-Block-Digest", record["block_digest"]),
        ("Content-Type", content_type),
        ("Content-Length", str(len(block))),
    ]
    record["headers"] = "".join(f"{n}: {_one_line(v)}\r\n" for n, v in lines if v is not None)
    return record


def _one_line(value: str) -> str:
    if "\n" not in value and "\r" not in value:
        return value
    return re.sub(r"[\r\n]+", " ", value)


def derived(source: dict) -> list[dict]:
    """The records that one response gives; a response without a block gives none."""
    if source["block"] is None or source["record_id"] is None:
        return []
    status, headers, body = split_response(source["block"])
    checksum = digest(body)  # of the body as it was sent, like the response's own
    body = payload(headers, body)
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    media = kind.split(";")[0].strip().lower()
    markup = media in ("text/html", "application/xhtml+xml")
    facts = [("source-status", status), ("source-payload-digest", checksum)]
    facts += [("source-header", f"{name}: {value}") for name, value in headers]
    text = None
    if markup or media == "text/plain":
        text, charset = decoded(headers, body)
        facts.append(("source-charset", charset))
    if markup:
        if title := _TITLE.search(text):
            facts.append(("title", " ".join(html.unescape(title[1]).split())))
        if lang := _LANG.search(text):
            facts.append(("language", lang[1].lower()))
        shown = visible(text, xml=media == "application/xhtml+xml")
        links = (html.unescape(m.strip("\"'")).strip() for m in _HREF.findall(shown))
        for link in _outlinks(source["target_uri"], dict.fromkeys(links)):
            facts.append(("outlink", link))
        text = plain_text(shown)
    block = "".join(f"{name}: {_one_line(value)}\r\n" for name, value in facts).encode("utf-8", "replace")
    records = [_record("metadata", source, "application/warc-fields", block, checksum)]
    if text is not None:
        block = text.encode("utf-8", "replace")
        records.append(_record("conversion", source, "text/plain; charset=utf-8", block, checksum))
    return records


def _outlinks(base: str | None, links: Iterable[str]) -> Iterator[str]:
    """Links as addresses; those that cannot be resolved as they stand."""
    try:
        parts = urlsplit(base or "")
        root = f"{parts.scheme}://{parts.netloc}" if parts.scheme and parts.netloc else None
    except ValueError:
        root = None
    for link in links:
        # A plain path from the root needs no resolving, and most links are such.
        if root is not None and _PLAIN_PATH.fullmatch(link):
            yield root + link
            continue
        try:
            yield urljoin(base or "", link)
        except ValueError:
            yield link


def derive(responses: DataFrame, *, keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata and conversion records of responses.

    ``responses`` has the columns of :data:`RESPONSE`; the result those of :data:`RECORD` and the
    columns in ``keep``. Responses are worked on where they are read, each by itself: nothing is
    shuffled. A response without identifier or block gives no record, an empty block a
    metadata record alone; repeated responses give repeated records. A response whose media type is no
    text gives a metadata record alone.
    """
    names = [c.split()[0] for c in RECORD.split(",")]
    kept = [responses.schema[c] for c in keep]
    clash = set(keep) & set(names)
    if clash:
        raise ValueError(f"columns that records have themselves: {sorted(clash)}")
    schema = responses.sparkSession.createDataFrame([], RECORD).schema
    for field in kept:
        schema = schema.add(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in [*names, *keep]}
            given = {c: batch.column(batch.schema.get_field_index(c)) for c in [*RESPONSE, *keep]}
            rows, bytes_held = 0, 0
            for i in range(batch.num_rows):
                for record in derived({c: given[c][i].as_py() for c in RESPONSE}):
                    for name in names:
                        columns[name].append(record[name])
                    for c in keep:
                        columns[c].append(given[c][i].as_py())
                    rows, bytes_held = rows + 1, bytes_held + len(record["block"])
                if bytes_held > 16_000_000:
                    yield arrow(columns)
                    columns, rows, bytes_held = {c: [] for c in columns}, 0, 0
            if rows:
                yield arrow(columns)

    types = {"content_length": pa.int64(), "block": pa.binary()}

    def arrow(columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {c: pa.array(v, None if c in keep else types.get(c, pa.string())) for c, v in columns.items()}
        )

    return responses.select(*RESPONSE, *keep).mapInArrow(run, schema)


def page_responses(pages: DataFrame, *, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages as the responses an archive would hold, with ``page_id`` beside them.

    Their identifiers follow from id and address. A null page is an empty one.
    """
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.length(body).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return pages.select(
        "page_id",
        _urn(F.concat_ws(" ", F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("date"),
        F.concat(F.encode(head, "UTF-8"), body).alias("block"),
    )


def _urn(name: Column) -> Column:
    hexed = F.sha1(name)
    parts = [F.substring(hexed, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def page_derivatives(pages: DataFrame) -> DataFrame:
    """All records that the pages give, blocks as text."""
    found = derive(page_responses(pages), keep=("page_id",))
    return found.withColumn("block", F.decode("block", "UTF-8"))


def serialised(record: dict, *, compress: bool = True) -> bytes:
    """A record as it stands in an archive file; compressed ones can simply be joined."""
    data = b"WARC/1.1\r\n" + record["headers"].encode("utf-8") + b"\r\n" + record["block"] + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def with_archive_bytes(records: DataFrame, *, compress: bool = True) -> DataFrame:
    """Add ``warc``, each record as the bytes of an archive file. A column of that name goes."""
    records = records.drop("warc")
    schema = T.StructType([*records.schema, T.StructField("warc", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, blocks = (batch.column(batch.schema.get_field_index(c)) for c in ("headers", "block"))
            made = [
                serialised({"headers": h.as_py(), "block": b.as_py()}, compress=compress)
                for h, b in zip(heads, blocks, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, "warc"]
            )

    return records.mapInArrow(run, schema)


def parsed(data: bytes) -> Iterator[dict]:
    """The records of an archive file, compressed or not: ``headers`` as a dict, and ``block``."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        yield {"version": lines[0], "headers": headers, "block": data[start:stop]}
        at = stop + 4
