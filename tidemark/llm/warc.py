"""WARC records and what is derived from responses.

A record is a row ``record_id, warc_type, refers_to, target_uri, date, content_type, headers, block``; ``headers`` holds
all named fields in their order, one ``Name: value`` to a line. Files hold one gzip member per record.

Every response gives two linked records. The *metadata* record carries the source's status, header lines and digests,
the title and the id of the conversion; the *conversion* record carries the plain text. Both keep the response's id in
``WARC-Refers-To``, its address and date, and its payload digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bitplane import write_file
from tidemark.llm.common import arrow_map, slices
from tidemark.session import materialize

VERSION = "WARC/1.1"
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, headers string, block binary"
FIELDS = tuple(f.split()[0] for f in RECORD.split(", "))
NAMED = ("WARC-Record-ID", "WARC-Type", "WARC-Refers-To", "WARC-Target-URI", "WARC-Date", "Content-Type")
FILE_BYTES = 1 << 24
STEP = 1 << 13  # compressed bytes that a reader looks at at a time
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc")

# Fixed values of HTML: elements whose content is no text, and elements that start a new line.
SILENT = "script|style|template|noscript|title"  # a head has no other text, and its end tag may be left out
BREAKS = "address|article|aside|blockquote|br|dd|div|dl|dt|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
NAMED_SO = r"(?=[\s/>])"  # ends the name of an element; a custom element's goes on with a hyphen
MARKUP = re.compile(  # begins with one plain character, which lets the search skip text quickly
    rf"<(?:!--.*?(?:-->|\Z)|({SILENT}){NAMED_SO}[^>]*>.*?(?:</\1{NAMED_SO}[^>]*>|\Z)|(/?(?:{BREAKS}){NAMED_SO}[^>]*>)|[/!?a-zA-Z][^>]*(?:>|\Z))",
    re.S | re.I,
)
BROKEN = re.compile(r"\r[^\n]*\n")
TITLE = re.compile(rf"<title{NAMED_SO}[^>]*>(.*?)(?:</title{NAMED_SO}[^>]*>|\Z)", re.S | re.I)
CHUNK = re.compile(rb"\s*[0-9a-fA-F]+\s*(?:;[^\r\n]*)?\r\n")  # the size line of a chunk
CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
TEXTS = ("text/html", "application/xhtml+xml", "text/plain")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_urn(kind: str, name: str) -> str:
    """The same id for the same thing, so a task that runs again names its records alike."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{kind} {name}')}>"


def one_line(value: str) -> str:
    return " ".join(value.split())


def html_to_text(page: str) -> str:
    """Text of a page: no markup, scripts or styles; block elements break lines, other white space is one blank."""
    # The flat page holds neither \r nor \n, so they can mark what was markup: a breaking tag stays between the two, of all
    # other markup the empty pair is left.
    marked = MARKUP.sub("\r\\2\n", one_line(page)).replace("\r\n", "")
    lines = entities.unescape(BROKEN.sub("\n", marked)).split("\n")
    return "\n".join(" ".join(words) for words in map(str.split, lines) if words)


def record(kind: str, record_id: str, block: bytes, content_type: str, fields: dict[str, str | None]) -> tuple:
    """Row of a new record; ``fields`` with no value are left out."""
    named = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id,
        **{name: one_line(value) for name, value in fields.items() if value},
        "WARC-Block-Digest": digest(block),
        "Content-Type": content_type,
        "Content-Length": str(len(block)),
    }
    return (*map(named.get, NAMED), "\n".join(f"{k}: {v}" for k, v in named.items()), block)


def of_headers(headers: str, block: bytes) -> tuple:
    by = fields_of(headers)
    return (*(by.get(name.lower()) for name in NAMED), headers, block)


def fields_of(headers: str) -> dict[str, str]:
    """Named fields in lower case; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for line in headers.split("\n"):
        name, colon, value = line.partition(":")
        if colon:
            found.setdefault(name.strip().lower(), value.strip())
    return found


def responses_of_pages(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record for every page, as a crawler would have stored it. The page's id goes into the field
    ``WARC-Page-ID``; a null address or id leaves its field out, a null page has an empty payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, urls, pages_ in slices(batches):
            rows = []
            for page_id, url, page in zip(ids, urls, pages_, strict=True):
                payload = (page or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
                fields = {
                    "WARC-Target-URI": url,
                    "WARC-Date": date,
                    "WARC-Payload-Digest": digest(payload),
                    "WARC-Page-ID": None if page_id is None else str(page_id),
                }
                name = record_urn("response", f"{page_id} {url} {fields['WARC-Payload-Digest']}")
                rows.append(record("response", name, head.encode() + payload, "application/http; msgtype=response", fields))
            yield as_columns(rows)

    named = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return arrow_map(named, run, RECORD)


def as_columns(rows: list[tuple]) -> dict[str, list]:
    return dict(zip(FIELDS, map(list, zip(*rows, strict=True)), strict=True)) if rows else {f: [] for f in FIELDS}


def dechunked(payload: bytes) -> bytes:
    """Body of a chunked transfer; what lies behind the last whole chunk of a body that was cut short is left out."""
    parts, at = [], 0
    while True:
        end = payload.find(b"\r\n", at)
        if end < 0:
            break
        try:
            size = int(payload[at:end].partition(b";")[0].strip() or b"0", 16)
        except ValueError:
            break
        if size <= 0:
            break
        parts.append(payload[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return b"".join(parts)


def inflated(payload: bytes, gzipped: bool) -> bytes:
    """Content of gzip members or of a deflate stream, with or without its wrapper; as far as it can be read."""
    parts, rest = [], memoryview(payload)
    bits = 31 if gzipped else 15 if payload[:1] and payload[0] & 15 == 8 and int.from_bytes(payload[:2]) % 31 == 0 else -15
    while len(rest):
        unpack, at = zlib.decompressobj(bits), 0
        try:
            while not unpack.eof and at < len(rest):
                parts.append(unpack.decompress(rest[at : at + STEP]))
                at += STEP
        except zlib.error:
            break
        rest = rest[min(at, len(rest)) - len(unpack.unused_data) :] if unpack.eof and gzipped else rest[:0]
    return b"".join(parts)


def decoded_body(payload: bytes, http: dict[str, str]) -> bytes | None:
    """The payload without its transfer and content encodings, the outermost (last named) first; None where one of them is
    not known. A body that is not in the encoding that its head names, as some crawlers store it, is taken as it is."""
    names = [n.strip().lower() for field in ("content-encoding", "transfer-encoding") for n in http.get(field, "").split(",")]
    for name in reversed([n for n in names if n and n != "identity"]):
        if name == "chunked":
            payload = dechunked(payload) if CHUNK.match(payload) else payload
        elif name in ("gzip", "x-gzip"):
            payload = inflated(payload, True) if payload[:2] == b"\x1f\x8b" else payload
        elif name == "deflate":
            payload = inflated(payload, False) or payload
        else:
            return None
    return payload


def derived(headers: str, block: bytes) -> list[tuple]:
    """Metadata record and, for texts, conversion record of a response; nothing for other records."""
    by = fields_of(headers)
    source = by.get("warc-record-id")
    if by.get("warc-type") != "response" or not source:
        return []
    head, _, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.decode("latin-1").replace("\r\n", "\n").partition("\n")
    http = fields_of(lines)
    kind = http.get("content-type", "")
    payload_digest = by.get("warc-payload-digest") or digest(payload)
    shared = {
        "WARC-Refers-To": source,
        "WARC-Target-URI": by.get("warc-target-uri"),
        "WARC-Refers-To-Target-URI": by.get("warc-target-uri"),
        "WARC-Refers-To-Date": by.get("warc-date"),
        "WARC-Date": by.get("warc-date"),
        "WARC-Source-Payload-Digest": payload_digest,
        "WARC-Page-ID": by.get("warc-page-id"),
    }
    meta_id, text_id = record_urn("metadata", source), record_urn("conversion", source)
    body = decoded_body(payload, http) if kind.partition(";")[0].strip().lower() in TEXTS else None
    is_text = body is not None
    text = title = None
    if is_text:
        charset = CHARSET.search(kind)
        try:
            page = body.decode(charset[1] if charset else "utf-8", "replace")
        except LookupError:  # an encoding of that name does not exist
            page = body.decode("utf-8", "replace")
        plain = kind.lower().startswith("text/plain")
        text = page if plain else html_to_text(page)
        found = None if plain else TITLE.search(page)
        title = one_line(entities.unescape(found[1])) if found else None
    notes = [
        ("http-status", status),
        ("source-block-digest", by.get("warc-block-digest") or digest(block)),
        ("source-payload-digest", payload_digest),
        ("source-content-length", str(len(payload))),
        ("title", title),
        ("conversion-record", text_id if is_text else None),
        ("text-digest", digest(text.encode()) if is_text else None),
    ]
    told = "".join(f"{name}: {value}\r\n" for name, value in notes if value)
    told += "".join(f"source-header: {line}\r\n" for line in lines.split("\n") if line)
    rows = [record("metadata", meta_id, told.encode(), "application/warc-fields", shared)]
    if is_text:
        rows.append(record("conversion", text_id, text.encode(), "text/plain; charset=utf-8", shared | {"WARC-Concurrent-To": meta_id}))
    return rows


def derive(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses among ``records``; each record is worked on by itself.

    Records without an id or of another type give nothing. A response that is no text has a metadata record only, and so has
    one in an encoding other than chunked, gzip and deflate; those are undone for the text, while digests, lengths and
    source headers are those of the stored bytes. An empty
    payload has an empty conversion. Repeated responses give repeated records with equal ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for headers, blocks in slices(batches, 64):
            yield as_columns([r for h, b in zip(headers, blocks, strict=True) for r in derived(h or "", b or b"")])

    return arrow_map(records.filter("warc_type = 'response'").select("headers", "block"), run, RECORD)


def serialise(headers: str, block: bytes) -> bytes:
    head = f"{VERSION}\r\n" + headers.replace("\n", "\r\n") + "\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


def write_records(records: DataFrame, path: str) -> DataFrame:
    """Write records into files of bounded size in a folder; returns ``file, records, bytes``. A task writes its own files,
    each appears as a whole, and a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> dict:
            name = f"part-{task:08d}-{number:06d}.warc.gz"
            write_file(path, name, b"".join(held))
            return {"file": [name], "records": [len(held)], "bytes": [size]}

        for headers, blocks in slices(batches, 64):
            for h, b in zip(headers, blocks, strict=True):
                held.append(serialise(h, b))
                size += len(held[-1])
                if size >= FILE_BYTES:
                    yield close()
                    number, held, size = number + 1, [], 0
        if held:
            yield close()

    return materialize(arrow_map(records.select("headers", "block"), run, "file string, records long, bytes long"))


def parse(data: bytes | memoryview) -> Iterator[tuple[str, bytes]]:
    """Header lines and block of every record of a file, whether or not it is compressed."""
    for part in members(data):
        at = 0
        while True:
            while part[at : at + 2] == b"\r\n":
                at += 2
            if at >= len(part):
                break
            end = part.find(b"\r\n\r\n", at)
            if end < 0 or not part.startswith(b"WARC/", at):
                raise ValueError("not a WARC record, or cut short")
            _, _, headers = part[at:end].decode("utf-8", "replace").replace("\r\n", "\n").partition("\n")
            size = int(fields_of(headers)["content-length"])
            yield headers, part[end + 4 : end + 4 + size]
            at = end + 4 + size


def members(data: bytes | memoryview) -> Iterator[bytes]:
    """Content of a plain file, or of each gzip member. Members are fed in short steps: what lies beyond the end of one is
    at most a step, so the cost grows with the file and not with its number of records."""
    if bytes(data[:2]) != b"\x1f\x8b":
        yield bytes(data)
        return
    view, at = memoryview(data), 0
    while at < len(view):
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= len(view):
                raise ValueError("cut short")
            parts.append(unpack.decompress(view[at : at + STEP]))
            at += STEP
        at = min(at, len(view)) - len(unpack.unused_data)
        yield b"".join(parts)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records of the ``.warc`` and ``.warc.gz`` files in a folder, on any storage that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc{,.gz}").load(path).select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse(memoryview(batch.column(0)[i].as_buffer())):
                    rows.append(of_headers(headers, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield as_columns(rows)
                        rows, size = [], 0
                yield as_columns(rows)

    return arrow_map(files, run, RECORD)
