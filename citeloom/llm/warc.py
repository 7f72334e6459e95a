"""WARC derivatives: response records become linked metadata and plain-text conversion records.

For each response record one metadata record (a JSON envelope of its WARC and HTTP headers,
title and links) and one conversion record (its visible text) are built. Both refer to the
response by WARC-Refers-To, keep its target URI and date, carry its digests in the envelope
and have digests of their own. Record ids are derived from the source record's id, so that a
rerun writes the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import json
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small_batches, written
from .html_extract import INLINE, RAW, raw_end, tags

HEADERS = "array<struct<name:string,value:string>>"
RECORD = f"warc_type string, record_id string, refers_to string, target_uri string, date string, content_type string, headers {HEADERS}, block binary, block_digest string, payload_digest string"
ARROW = pa.schema([("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("block", pa.binary()), ("block_digest", pa.string()), ("payload_digest", pa.string())])
CRAWL_DATE = "2024-01-01T00:00:00Z"
_HREF = re.compile(r"(?<![^\s\"'])href\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: What stands between the records of a file, up to the number of the version.
BETWEEN = "\r\n\r\nWARC/1."
VERSION = BETWEEN.strip().encode()
#: Bytes of BETWEEN that end a record; the others begin the next one.
END = len(BETWEEN) - len(VERSION)
#: Names of files that are read in one piece each, and all others.
PACKED, PLAIN = "*.gz", "{*[!z],*[!g]z,*[!.]gz,z,gz}"
_KNOWN = {"warc-type": "warc_type", "warc-record-id": "record_id", "warc-refers-to": "refers_to", "warc-target-uri": "target_uri", "warc-date": "date", "content-type": "content_type", "warc-block-digest": "block_digest", "warc-payload-digest": "payload_digest"}


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def derived_id(source: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{source}')}>"


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; without an empty line all is payload."""
    m = re.search(rb"\r?\n\r?\n", block)
    if not m or not block.startswith(b"HTTP/"):
        return "", [], block
    status, *lines = block[: m.start()].decode("iso-8859-1").splitlines() or [""]
    headers = [(n.strip(), v.strip()) for n, s, v in (line.partition(":") for line in lines) if s]
    return status, headers, block[m.end() :]


def read_page(page: str) -> tuple[str, str | None, list[str]]:
    """(text, title, links) of a page: all text it shows, one line a block, of every region, without scripts and styles; its first title; the links of its anchors."""
    blocks, now, at, upto, title, links = [], [], 0, 0, None, []
    for start, end, closing, name, attributes in tags(page):
        if start < upto:
            continue
        now.append(html.unescape(page[at:start]))
        at = end
        if name in RAW and not closing:
            stop, at = raw_end(page, name, end)
            upto = at
            if name in ("title", "textarea"):
                now.append(html.unescape(page[end:stop]))
            if name == "title" and title is None:
                title = " ".join(now[-1].split())
        if name == "a" and not closing and (m := _HREF.search(attributes)):
            links.append(html.unescape(next(x for x in (*m.groups(), "") if x is not None)))
        if name and name not in INLINE:
            blocks.append("".join(now))
            now = []
    now.append(html.unescape(page[at:]))
    blocks.append("".join(now))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b), title, links


def _page(payload: bytes, headers: list[tuple[str, str]]) -> str:
    kind = next((v for n, v in headers if n.lower() == "content-type"), "")
    m = re.search(r"charset=[\"']?([\w.:-]+)", kind, re.I)
    try:
        return payload.decode(m[1] if m else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def envelope(record: dict, status: str, headers: list[tuple[str, str]], payload: bytes, title: str | None, links: list[str]) -> dict:
    meta = {"Response-Message": {"Status-Line": status}, "Headers": [list(h) for h in headers], "Entity-Length": len(payload), "Entity-Digest": digest(payload), "HTML-Metadata": {"Title": title, "Links": links}}
    return {"Envelope": {"WARC-Header-Metadata": [[h["name"], h["value"]] for h in record["headers"] or []], "WARC-Record-ID": record["record_id"], "WARC-Block-Digest": record["block_digest"], "WARC-Payload-Digest": record["payload_digest"], "Payload-Metadata": {"HTTP-Response-Metadata": meta}}}


def derive_one(record: dict) -> list[dict]:
    """The metadata and the conversion record of a response record; nothing for records of other types."""
    if record["warc_type"] != "response":
        return []
    block, source = record["block"] or b"", record["record_id"] or ""
    status, headers, payload = http_parts(block)
    text, title, links = read_page(_page(payload, headers))
    about, out = json.dumps(envelope(record, status, headers, payload, title, links), ensure_ascii=False), []
    for kind, content, data in (("metadata", "application/json", about.encode()), ("conversion", "text/plain", text.encode())):
        new = {"warc_type": kind, "record_id": derived_id(source, kind), "refers_to": source, "target_uri": record["target_uri"], "date": record["date"], "content_type": content, "block": data, "block_digest": digest(data), "payload_digest": None}
        named = [("WARC-Type", kind), ("WARC-Record-ID", new["record_id"]), ("WARC-Refers-To", source), ("WARC-Target-URI", new["target_uri"]), ("WARC-Date", new["date"]), ("WARC-Block-Digest", new["block_digest"]), ("Content-Type", content), ("Content-Length", str(len(data)))]
        out.append(new | {"headers": [{"name": n, "value": v} for n, v in named if v]})
    return out


def derive(records: DataFrame) -> DataFrame:
    """Two derived records for each response record, in the columns of RECORD; records of other types give none.

    Null blocks are empty responses: an envelope without a status and an empty text. Repeated
    records give equal derived records each time; an empty table none.
    """
    small_batches(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([d for r in b.to_pylist() for d in derive_one(r)], ARROW)

    return records.select(*ARROW.names).mapInArrow(run, RECORD)


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = CRAWL_DATE) -> DataFrame:
    """Pages as WARC response records with HTTP headers; null pages have an empty payload, null URLs an empty target."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pylist([response(str(k), u or "", p or "", date) for k, u, p in zip(*(b.column(i).to_pylist() for i in range(3)))], ARROW)

    return pages.select(F.col(id_col).cast("string"), F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(run, RECORD)


def response(key: str, url: str, page: str, date: str = CRAWL_DATE) -> dict:
    payload = page.encode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    new = {"warc_type": "response", "record_id": derived_id(f"{key} {url}", "response"), "refers_to": None, "target_uri": url, "date": date, "content_type": "application/http; msgtype=response", "block": block, "block_digest": digest(block), "payload_digest": digest(payload)}
    named = [("WARC-Type", "response"), ("WARC-Record-ID", new["record_id"]), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-Block-Digest", new["block_digest"]), ("WARC-Payload-Digest", new["payload_digest"]), ("Content-Type", new["content_type"]), ("Content-Length", str(len(block)))]
    return new | {"headers": [{"name": n, "value": v} for n, v in named if v]}


def to_bytes(record: dict, compress: bool = True) -> bytes:
    """A record as it stands in a file; compressed, it is a gzip member of its own without a time."""
    head = "WARC/1.0\r\n" + "".join(f"{h['name']}: {h['value']}\r\n" for h in record["headers"]) + "\r\n"
    data = head.encode() + (record["block"] or b"") + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def parse_one(piece: bytes) -> tuple[dict | None, int]:
    """The record at the start of bytes, after the number of its version, and how many bytes its block lacks; no record without headers.

    A Content-Length that is missing or no number takes in all that is there.
    """
    end = re.compile(rb"\r?\n\r?\n").search(piece)
    lines = piece[: end.start() if end else len(piece)].decode("utf-8", "replace").splitlines()[1:]
    named = [{"name": n.strip(), "value": v.strip()} for n, s, v in (line.partition(":") for line in lines) if s]
    if not named:
        return None, 0
    rest, size = piece[end.end() :] if end else b"", next((h["value"] for h in named if h["name"].lower() == "content-length"), "")
    length = int(size) if size.isascii() and size.isdigit() else len(rest)
    record = dict.fromkeys(ARROW.names) | {"headers": named, "block": rest[:length]}
    cut = 0 if end or not length else END  # a block that begins like a record: the empty line before it went with BETWEEN
    return record | {_KNOWN[h["name"].lower()]: h["value"] for h in named if h["name"].lower() in _KNOWN}, max(0, length - len(rest)) + cut


def records(pieces: Iterable[tuple[object, bytes]]) -> Iterator[dict]:
    """Records of pieces between BETWEEN, each with the key of its file; a block that holds BETWEEN itself takes in as many pieces as it is long.

    A record begins where a piece does, unless the one before, by its length, goes beyond that.
    A block that ends early is as long as what is there; bytes without headers are no record.
    """
    held, lacks, of = [], 0, None
    for key, piece in pieces:
        if held and (key != of or lacks <= END):
            yield parse_one(BETWEEN.encode().join(held) + (BETWEEN[:END].encode() if key == of else b""))[0]
            held = []
        if held:
            held.append(piece)
            lacks -= len(BETWEEN) + len(piece)
            continue
        piece, of = piece.removeprefix(VERSION), key
        record, lacks = parse_one(piece)
        if lacks > 0:
            held = [piece]
        elif record:
            yield record
    if held:
        yield parse_one(BETWEEN.encode().join(held))[0]


def _splits(pieces: DataFrame) -> DataFrame:
    """(file, block, size, reach) of each split of a file that has several: its bytes, and how far the records that could begin in it go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, reach = None, 0, 0
        for b in batches:
            for file, block, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (file, block) != at:
                    if at:
                        yield pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "size": size, "reach": reach}])
                    at, size, reach = (file, block), 0, 0
                piece = piece.as_py().removeprefix(VERSION)
                reach = max(reach, size + len(VERSION) + len(piece) + parse_one(piece)[1])
                size += len(piece) + len(BETWEEN)
        if at:
            yield pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "size": size, "reach": reach}])

    return pieces.where("part").select("file", "block", "value").mapInArrow(run, "file string, block bigint, size bigint, reach bigint")


def _tied(pieces: DataFrame) -> DataFrame:
    """(file, block, run): splits that a record of an earlier split could go on into, and those earlier ones, by the run that they form.

    The windows are over one row for each split of a file.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    at = _splits(pieces).withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
    free = at.withColumn("free", F.col("base") >= F.coalesce(F.max(F.col("base") + F.col("reach")).over(before), F.lit(0)))
    runs = free.withColumn("run", F.sum(F.col("free").cast("long")).over(upto))
    return written(runs.withColumn("n", F.count("*").over(Window.partitionBy("file", "run"))).where("n > 1").select("file", "block", "run"), "tied")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under a path, plain or in gzip members, in the columns of RECORD.

    Spark reads and splits files at the records, wherever they lie; a task holds a batch of records, never a
    file. Files named *.gz are read by one task each, others split. A split is read for itself
    where a first pass over plain files shows that no record before it can go on into it; splits that
    could be within a record are gone through in the file's order by one task, so that results do not depend
    on where files are split. Bad lengths and records that end early have the rest as their block, as in
    records(); a gzip file that is cut short fails, unless spark.sql.files.ignoreCorruptFiles is
    set. Lines end in CR LF, as the format has it: a file with bare line feeds is one record. No files
    give no rows.
    """
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[dict] = []
        keyed = ((key, p.as_py()) for b in batches for key, p in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2)))
        for record in records(keyed):
            some.append(record)
            if len(some) == 64:
                yield pa.RecordBatch.from_pylist(some, ARROW)
                some = []
        yield pa.RecordBatch.from_pylist(some, ARROW)

    def pieces(names: str) -> DataFrame:
        at = F.col("_metadata")
        found = spark.read.option("lineSep", BETWEEN).option("pathGlobFilter", names).text(path)
        return found.select(at["file_path"].alias("file"), at["file_block_start"].alias("block"), (at["file_block_length"] < at["file_size"]).alias("part"), F.col("value").cast("binary").alias("value"))

    def parsed(df: DataFrame, key: str) -> DataFrame:
        return df.select("file", key, "value").mapInArrow(run, RECORD)

    packed, plain = pieces(PACKED), pieces(PLAIN)
    tied = _tied(plain)
    n = tied.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return parsed(packed, "block").unionByName(parsed(plain, "block"))
    few = n <= BROADCAST_ROWS
    marked = plain.withColumn("nth", F.monotonically_increasing_id()).join(F.broadcast(tied) if few else tied, ["file", "block"], "left")
    marked = marked.withColumn("run", F.coalesce("run", -1 - F.col("block")))  # a split for itself has a number below zero
    moved = (marked.where("run > 0") if few else marked).repartition("file", "run").sortWithinPartitions("file", "run", "block", "nth")
    found = parsed(packed, "block").unionByName(parsed(moved, "run"))
    return found.unionByName(parsed(marked.where("run < 0"), "run")) if few else found
