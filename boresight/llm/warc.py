"""WARC derivative builder: linked metadata and plain-text conversion records of archived responses.

Each response gives two records. The metadata record (``application/warc-fields``) keeps the source's status line, headers
and digests, the page's title, language and links, and names the conversion record. The conversion record holds the visible
text. Both carry ``WARC-Refers-To`` with the response's identifier, its target, and digests of their own blocks. Identifiers
are name-based (UUID 5 over source and kind), so a rerun, or a task that is run again, makes the same ones. A response is
read once, whole, by one task, without a shuffle.

``write_warc`` is a text sink whose line separator is the two line ends that close a record, so Spark's committer writes
valid files to any store; ``read_warc`` cuts such files by their lengths.

Cases: a null payload counts as empty and gives empty text; without a target the header is left out; responses that repeat
exactly give the same records twice; a digest that the source brings is kept as it is, else SHA-256 is taken; broken markup,
unknown charsets and undecodable bytes never fail, and cost time in proportion to their length; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boresight.llm.common import map_batches

END = "\r\n"
# Elements whose content is never shown, and those that begin and end a line.
HIDDEN = frozenset("script style noscript template svg iframe".split())
BREAK = frozenset("address article aside blockquote body br dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table td th title tr ul".split())
LINKED = frozenset("a area link img script iframe".split())
NAME = re.compile(r"/?([A-Za-z][A-Za-z0-9]*)|[!?]")
BLANKS, LINES = re.compile(r"[^\S\n]+"), re.compile(r" ?\n[ \n]*")
LANGUAGE = re.compile(r"\slang\s*=\s*[\"']?([A-Za-z0-9-]+)", re.I)
CHARSET = re.compile(r"charset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)
META = re.compile(rb"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9._-]+)", re.I)
REFERENCE = re.compile(r"\s(href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))", re.I)

RECORDS = pa.schema([
    ("source_key", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()),
    ("content_length", pa.int64()), ("block_digest", pa.string()), ("source_digest", pa.string()), ("n_links", pa.int64()), ("header", pa.string()), ("content", pa.string()),
])
SCHEMA = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in RECORDS)


def tags(page: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it closes, start, end) of all tags and comments (name ``!--``) in page order; end is behind the ``>``.

    A tag runs to the first ``>`` and holds no ``<``; every search goes forward from the last one's result, so broken markup
    costs no more than whole markup.
    """
    at, close, dashes = page.find("<"), 0, 0
    while at >= 0:
        if page.startswith("<!--", at):
            if 0 <= dashes < at + 4:
                dashes = page.find("-->", at + 4)
            end = dashes + 3 if dashes >= 0 else len(page)
            yield "!--", False, at, end
            at = page.find("<", end)
            continue
        if 0 <= close <= at:
            close = page.find(">", at)
        if close < 0:
            return
        after = page.find("<", at + 1)
        if (after < 0 or close < after) and (m := NAME.match(page, at + 1)):
            yield (m[1] or "!").lower(), m[0][:1] == "/", at, close + 1
        at = after


def visible_text(page: str) -> str:
    """Text of a page as it is shown, a line for each block."""
    out, shown, inside, head = [], 0, None, None
    for name, closes, start, end in tags(page):
        if inside:  # what is hidden runs to its closing tag
            if closes and name == inside:
                inside, shown = None, end
            continue
        if head is not None and closes is (name == "head") and name in ("head", "body"):
            del out[head:]
            head, shown = None, start
        out.append(page[shown:start])
        shown = end
        if name in HIDDEN and not closes:
            inside = name
            out.append(" ")
        elif name == "head" and not closes and head is None:
            head = len(out)
        else:
            out.append("\n" if name in BREAK else " " if name == "!--" else "")
    if not inside:
        out.append(page[shown:])
    return LINES.sub("\n", BLANKS.sub(" ", html.unescape("".join(out)).replace("\r", "\n"))).strip()


def decoded(payload: bytes, headers: str) -> str:
    """A payload by the charset of its header, else of its markup, else UTF-8."""
    found = CHARSET.search(headers) or META.search(payload)
    name = found[1] if found else "utf-8"
    try:
        return payload.decode(name if isinstance(name, str) else name.decode(), "replace")
    except (LookupError, ValueError):  # no such charset, or one that decodes no text
        return payload.decode("utf-8", "replace")


def one_line(text: str) -> str:
    return " ".join(text.split())


def about(page: str, base: str) -> tuple[str | None, str | None, list[str]]:
    """Title, language, and ``url kind`` of all links in page order."""
    title, begun, language, found = None, None, None, []
    for name, closes, start, end in tags(page):
        if name == "title" and title is None:
            if closes and begun is not None:
                title = page[begun:start]
            elif not closes and begun is None:
                begun = end
        elif name == "html" and not closes and not language and (m := LANGUAGE.search(page, start, end)):
            language = m[1]
        elif name in LINKED and not closes and (m := REFERENCE.search(page, start, end - 1)):
            ref = html.unescape(m[2] or m[3] or m[4] or "").strip()
            if ref and not ref.lower().startswith(("javascript:", "data:", "mailto:", "#")):
                try:
                    found.append(f"{quote(urljoin(base, ref), safe=':/?#[]@!$&()*+,;=%~')} {name}/@{m[1].lower()}")
                except ValueError:  # not a reference
                    continue
    return title, language, found


def new_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {source}')}>"


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def record(kind: str, record_id: str, source_id: str, target: str | None, date: str, content_type: str, content: str, language: str | None = None) -> dict:
    """A WARC record with its header block; line ends inside values are not let through."""
    block = content.encode("utf-8", "replace")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Refers-To", source_id)]
    fields += [("WARC-Target-URI", target)] if target else []
    fields += [("WARC-Identified-Content-Language", language)] if language else []
    fields += [("WARC-Block-Digest", digest(block)), ("Content-Type", content_type), ("Content-Length", str(len(block)))]
    header = END.join(["WARC/1.1", *(f"{k}: {one_line(v)}" for k, v in fields)])
    return {"record_id": record_id, "warc_type": kind, "refers_to": source_id, "target_uri": target, "date": date, "content_type": content_type, "content_length": len(block), "block_digest": digest(block), "header": header, "content": content}


def derivatives(source_id: str, target: str | None, date: str, headers: str, payload: bytes, source_digest: str | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    kept = source_digest or digest(payload)
    page = decoded(payload, headers)
    title, language, found = about(page, target or "")
    text_id, about_id = new_id(source_id, "conversion"), new_id(source_id, "metadata")
    lines = headers.split("\n")
    fields = [("conversion-record", text_id), ("source-payload-digest", kept), ("source-payload-length", str(len(payload))), ("source-status", lines[0])]
    fields += [("source-header", line) for line in lines[1:] if line.strip()]
    fields += [("title", html.unescape(title))] if title is not None else []
    fields += [("language", language)] if language else []
    fields += [("outlink", x) for x in found]
    described = END.join(f"{k}: {one_line(v)}" for k, v in fields) + END
    both = [record("metadata", about_id, source_id, target, date, "application/warc-fields", described), record("conversion", text_id, source_id, target, date, "text/plain; charset=utf-8", visible_text(page), language)]
    return [r | {"source_digest": kept, "n_links": len(found)} for r in both]


def as_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Responses of raw pages: ``source_key, record_id, target_uri, date, http_headers, payload, payload_digest``."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.sha2(payload, 256)
    name = F.md5(F.concat_ws("\n", F.col("page_id").cast("string"), F.col("url"), sha))
    record_id = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    headers = F.concat(F.lit("HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("source_key"), record_id.alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("http_headers"), payload.alias("payload"), F.concat(F.lit("sha256:"), sha).alias("payload_digest"))


def derive(responses: DataFrame) -> DataFrame:
    """Two records, metadata and conversion, for each response."""
    names = ("source_key", "record_id", "target_uri", "date", "http_headers", "payload", "payload_digest")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for key, source_id, target, date, headers, payload, kept in zip(*(batch.column(c).to_pylist() for c in names)):
            rows += [r | {"source_key": key} for r in derivatives(source_id or new_id(str(key), "response"), target, date or "", headers or "", payload or b"", kept)]
        return pa.RecordBatch.from_pylist(rows, schema=RECORDS)

    return map_batches(responses.select(*names), run, SCHEMA)


def write_warc(records: DataFrame, path: str, compression: str = "gzip", files_of: int = 100_000) -> None:
    """Records as WARC files of at most ``files_of`` records, by Spark's own writer and committer."""
    whole = F.concat(F.col("header"), F.lit(END * 2), F.col("content"))
    records.select(whole.alias("value")).write.option("lineSep", END * 2).option("compression", compression).option("maxRecordsPerFile", files_of).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file, cut by the lengths."""
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        head = data.index(b"\r\n\r\n", at)
        fields = dict(line.split(": ", 1) for line in data[at:head].decode().split(END)[1:])
        size = int(fields["Content-Length"])
        yield fields, data[head + 4 : head + 4 + size]
        at = head + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``header`` (a map) and ``block`` of each record of the gzipped files of a folder."""
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                for fields, block in parse_warc(gzip.decompress(content)):
                    yield pa.RecordBatch.from_arrays([pa.array([list(fields.items())], pa.map_(pa.string(), pa.string())), pa.array([block], pa.binary())], names=["header", "block"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").mapInArrow(run, "header map<string,string>, block binary")
