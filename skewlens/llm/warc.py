"""WARC derivatives: metadata and plain-text conversion records from responses.

Every response gives two records that name it in WARC-Refers-To and keep its
target address, date and payload digest: ``metadata`` (application/warc-fields:
title, language, the source's HTTP status, every line of its HTTP head as ``http-…``
and every WARC header without a column as ``source-…``, and its links) and
``conversion`` (text/plain: the page without markup). Record ids are computed from
the record, so that a task that runs twice writes the same; digests are SHA-1 in
base 32. Records are built where the response lies; nothing is shuffled.

``read_warc`` and ``write_warc`` go through files of gzip members, one per record,
on any store that pyarrow's file systems reach.

Defined cases. A null page is an empty payload; a null address is an empty one.
Markup that never ends (comments, scripts, quotes) takes the rest of the page, in
linear time. Repeated rows give equal records. An empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import io
import os
import re
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import column
from .token_files import open_folder

DATE = "2024-01-01T00:00:00Z"  # of pages that name none
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
HREF = re.compile(r"""\bhref\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
LANG = re.compile(r"""\blang\s*+=\s*+["']?([A-Za-z-]++)""", re.I)
RAW = {n: re.compile(f"</{n}", re.I) for n in ("script", "style", "noscript", "template", "title")}
BLOCK = frozenset(
    "address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav "
    "ol p pre section table tbody td tfoot th thead tr ul".split()
)


def parse(page: str) -> tuple[str, str, list[str], str]:
    """(title, language, links in order, text: one line per block, white space runs as one blank)."""
    out, links, title, lang, at, tag = [], [], "", "", 0, TAG
    while True:
        start = page.find("<", at)
        if start < 0:
            out.append(page[at:])
            break
        out.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            if end < 0:
                break
            at = end + 3
            continue
        m = tag.match(page, start)
        if not m and tag is TAG and page[start + 1:start + 2].isalpha():
            tag = LOOSE  # a quote that never ends: from here on tags end at the first >
            m = tag.match(page, start)
        if not m:
            if page[start + 1:start + 2] in ("!", "?"):
                end = page.find(">", start)
                if end < 0:
                    break
                at = end + 1
            elif page.find(">", start) < 0 and page[start + 1:start + 2].isalpha():
                break
            else:
                out.append("<")
                at = start + 1
            continue
        name, closing, at = m.group(2).lower(), m.group(1), m.end()
        if name in BLOCK:
            out.append("\n")
        if closing:
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            if name == "title" and not title:
                title = " ".join(entities.unescape(page[at:end.start() if end else len(page)]).split())
            if not end:
                break
            at = end.start()
        elif name == "a" and (h := HREF.search(m.group(3))):
            links.append(entities.unescape(next(g for g in h.groups() if g is not None)))
        elif name == "html" and not lang and (h := LANG.search(m.group(3))):
            lang = h.group(1)
    lines = (" ".join(x.split()) for x in entities.unescape("".join(out)).split("\n"))
    return title, lang, links, "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(chr(0).join(map(str, parts)).encode('utf-8', 'replace')).digest()[:16], version=5)}>"


def field(value) -> str:
    """A value that cannot start a line of its own."""
    return " ".join(str(value).split())


FIELDS = ["key", "record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", "content_length", "block", "headers"]
RECORD = pa.schema([(f, pa.int64() if f in ("key", "content_length") else pa.binary() if f == "block" else pa.string()) for f in FIELDS])
RECORD_SQL = ", ".join(f"{f} {'bigint' if f in ('key', 'content_length') else 'binary' if f == 'block' else 'string'}" for f in FIELDS)


def record(key, kind: str, refers_to, uri: str, date: str, content_type: str, payload_digest, block: bytes) -> tuple:
    own = digest(block)
    return key, kind, record_id(kind, key, uri, date, refers_to, own), refers_to, uri, date, content_type, payload_digest, own, len(block), block, None


def header_lines(head: str) -> list[tuple[str, str]]:
    """(name, value) of the lines of a head; a line that starts with a blank goes on with the one before."""
    out: list[tuple[str, str]] = []
    for line in head.split("\r\n"):
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip(), value.strip()))
    return out


def response(key, uri: str, page: str, date: str = DATE) -> tuple:
    """The response record of a page: HTTP head and body."""
    body = page.encode("utf-8", "replace")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return record(key, "response", None, uri, date, "application/http; msgtype=response", digest(body), head + body)


def derived(source: tuple) -> list[tuple]:
    """The metadata and the conversion record of a response."""
    key, _, source_id, _, uri, date, _, payload_digest, _, _, block, more = source
    head, _, body = block.partition(b"\r\n\r\n")
    status, _, head = head.decode("latin-1").partition("\r\n")
    title, lang, links, text = parse(body.decode("utf-8", "replace"))
    facts = [("title", title), ("language", lang), ("http-status", status)]
    facts += [("http-" + "-".join(n.lower().split()), v) for n, v in header_lines(head)]
    facts += [("source-payload-digest", payload_digest or "")]
    facts += [("source-" + "-".join(n.lower().split()), v) for n, v in header_lines(more or "")]
    facts += [("outlink", x) for x in links]
    meta = "".join(f"{n}: {field(v)}\r\n" for n, v in facts).encode("utf-8", "replace")
    return [
        record(key, "metadata", source_id, uri, date, "application/warc-fields", payload_digest, meta),
        record(key, "conversion", source_id, uri, date, "text/plain", payload_digest, text.encode("utf-8", "replace")),
    ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), RECORD)], schema=RECORD)


def _responses(batches):
    for b in batches:
        for i in range(0, b.num_rows, 256):
            rows = [response(k, field(u or ""), h or "") for k, u, h in zip(*(c.to_pylist() for c in b.slice(i, 256).columns))]
            yield _batch(rows)


def _derived(batches):
    for b in batches:
        for i in range(0, b.num_rows, 256):
            rows = [d for r in zip(*(c.to_pylist() for c in b.slice(i, 256).columns)) if r[1] == "response" for d in derived(r)]
            if rows:
                yield _batch(rows)


def responses(pages: DataFrame, key_col: str = "page_id", uri_col: str = "url", html_col: str = "html") -> DataFrame:
    """A response record per page."""
    return pages.select(column(pages, key_col).cast("long"), column(pages, uri_col), column(pages, html_col)).mapInArrow(_responses, RECORD_SQL)


def _whole(records: DataFrame) -> DataFrame:
    """The columns of a record; ``headers`` may be missing."""
    if "headers" not in records.columns:
        records = records.withColumn("headers", F.lit(None).cast("string"))
    return records.select(*FIELDS)


def derive(records: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response among ``records``; other records are passed over."""
    return _whole(records).mapInArrow(_derived, RECORD_SQL)


# --- files -------------------------------------------------------------------

HEADERS = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
           ("WARC-Date", "date"), ("Content-Type", "content_type"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"),
           ("X-Key", "key"), ("Content-Length", "content_length")]
COLUMN_OF = {n.lower(): f for n, f in HEADERS}  # all other headers of a record are kept as lines, in the column ``headers``


def packed(row: tuple) -> bytes:
    """A record as a gzip member."""
    values = dict(zip(FIELDS, row))
    head = "".join(f"{n}: {values[f]}\r\n" for n, f in HEADERS if values[f] is not None)
    head += "".join(f"{n}: {field(v)}\r\n" for n, v in header_lines(values["headers"] or ""))
    return gzip.compress(b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + values["block"] + b"\r\n\r\n", mtime=0)


def unpacked(stream):
    """The records of an open WARC file, gzipped or not, one at a time."""
    f = io.BufferedReader(gzip.GzipFile(fileobj=stream))
    while line := f.readline():
        if not line.strip():
            continue
        lines = []
        while (line := f.readline().rstrip(b"\r\n")):
            lines.append(line.decode("utf-8", "replace"))
        headers, more = {}, []
        for n, v in header_lines("\r\n".join(lines)):
            if n.lower() in COLUMN_OF:
                headers[n.lower()] = v
            else:
                more.append(f"{n}: {v}")
        block = f.read(int(headers.get("content-length", 0)))
        values = {field_: headers.get(n) for n, field_ in COLUMN_OF.items()} | {"block": block, "content_length": len(block)}
        values["headers"] = "\r\n".join(more) or None
        values["key"] = int(values["key"]) if values["key"] is not None else None
        yield tuple(values[x] for x in FIELDS)


def _write(folder: str):
    def run(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        own, n = f"{root}/_{uuid.uuid4().hex}", 0
        with fs.open_output_stream(own, compression=None) as f:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    f.write(packed(row))
                    n += 1
        fs.move(own, name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "n"])

    return run


def write_warc(records: DataFrame, folder: str) -> list[str]:
    """One file per part of ``records`` in a folder all executors reach; their names."""
    return [r[0] for r in _whole(records).mapInArrow(_write(folder), "file string, n bigint").collect()]


def _read(folder: str, names: list[str]):
    def run(batches):
        fs, _ = open_folder(folder)
        for b in batches:
            for i in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(names[i], compression=None) as f:
                    for row in unpacked(f):
                        rows.append(row)
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return run


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files of a folder, a task per file."""
    fs, root = open_folder(folder)
    files = fs.get_file_info(pafs.FileSelector(root, recursive=True))
    names = sorted(f.path for f in files if f.is_file and not os.path.basename(f.path).startswith("_") and ".warc" in os.path.basename(f.path))
    if not names:
        return spark.createDataFrame([], RECORD_SQL)
    return spark.range(0, len(names), 1, len(names)).mapInArrow(_read(folder, names), RECORD_SQL)
