"""Legacy web archives: ARC files are parsed and rewritten as WARC, with repeated payloads as revisit records.

ARC has no fields, only a header line per record whose columns depend on the version in the archive's first block:
version 1 has ``URL IP date type length``; version 2 puts result code, checksum, location, offset and file name before
the length. The converter follows declared lengths, and synthesises what WARC asks for: record identifiers (a name-based
UUID of target, date, place and digest, so that a rerun gives the same), ISO dates from 14- or 12-digit ones, record
types (warcinfo for the version block, response for HTTP, resource for the rest) and SHA-256 digests of block and payload.

Flow: ARC files are read once for metadata; the response of each group of equal payloads is a minimum by digest; the
revisits are joined back by archive path to the file contents, and each archive becomes one WARC file. Where the revisits
are within ``BROADCAST_BYTES`` by their own count they go to the files, which stay where they are read; beyond that both
meet by path in tasks of about ``TASK_BYTES`` of compressed archives each. No group of equal payloads meets in one task. An archive written
here is of bounded size (``ARCHIVE_BYTES``, or one record if that is longer), which bounds a task's memory.

Archives are bytes throughout: payloads may be of any type and encoding, files of any name, compressed by gzip (one or more
members) or not.

Nulls and odd input: a null payload is empty; a null URL becomes urn:missing and white space in a URL is escaped, as are
bytes of a header line that aren't UTF-8; a null
page_id stays null and ranks last among equal payloads. Of repeated rows the first is the response and the others revisit
it. Empty tables give archives without records and an empty result. Other columns are ignored. A header line that can't
be parsed, or a length beyond the archive's end, makes the reader go on at the next line that is a header. A cut or damaged
gzip member gives the records that can be read of it, and reading goes on at the next member.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import drop, drop_path, materialize, scratch_path, small_batches

ARCHIVE_BYTES, BROADCAST_BYTES, TASK_BYTES = 8 << 20, 16 << 20, 64 << 20
#: Digits of a date or length in a header line; others than these aren't numbers there.
DIGITS = re.compile("[0-9]{1,18}")
#: Shortest payload that a revisit record may stand for.
LEAST_REVISIT = 100
#: Columns of a header line by version.
FIELDS = {
    1: ("uri", "ip", "date", "mime", "length"),
    2: ("uri", "ip", "date", "mime", "result", "checksum", "location", "offset", "filename", "length"),
}
LEGEND = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    block: bytes


def arc_header(version: int, uri: str, date: str, mime: str, length: int, *, filename: str, offset: int, result: int = 200) -> bytes:
    values = {"uri": uri, "ip": "0.0.0.0", "date": date, "mime": mime, "result": result, "checksum": "-", "location": "-", "offset": offset, "filename": filename, "length": length}
    return " ".join(str(values[f]) for f in FIELDS[version]).encode() + b"\n"


def arc_start(version: int, filename: str, date: str) -> bytes:
    block = f"{version} 0 factloom\n{LEGEND[version]}\n".encode()
    return arc_header(version, f"filedesc://{filename}", date, "text/plain", len(block), filename=filename, offset=0) + block + b"\n"


def clean_uri(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f-\xa0\u2028\u2029]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri) if uri else "urn:missing"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def http_parts(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head with its blank line, payload, and header fields in lower case."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.lower().split(": ", 1) for x in head.decode("latin-1").split("\r\n")[1:] if ": " in x)
    return head + gap, payload, fields


GZIP, PIECE = b"\x1f\x8b\x08", 1 << 18


def unpacked(data: bytes) -> list[bytes]:
    """What an archive file holds: itself, or its gzip members laid end to end, with a cut after whatever can be read of a damaged one."""
    if not data.startswith(GZIP):
        return [data]
    runs: list[list[bytes]] = [[]]
    at = 0
    while 0 <= at < len(data):
        member, begin = zlib.decompressobj(31), at
        try:
            while not member.eof and at < len(data):
                piece = data[at : at + PIECE]
                runs[-1].append(member.decompress(piece))
                at += len(piece) - len(member.unused_data)
            sound = member.eof
        except zlib.error:
            sound = False
        if not sound:
            runs.append([])
        at = data.find(GZIP, at if sound else begin + 1)
    return [b"".join(parts) for parts in runs if parts]


def _header_text(line: bytes) -> str:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in line)


def parse_arc(data: bytes, start: int = 0, version: int = 1) -> Iterator[ArcRecord]:
    """Records of sound bytes; offsets count from ``start``."""
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = _header_text(data[at : min(end, at + (1 << 16))].removesuffix(b"\r"))
        found = None
        for v in (version, *(FIELDS.keys() - {version})) if line.startswith("filedesc://") else (version,):
            parts = line.rsplit(" ", len(FIELDS[v]) - 1)
            if len(parts) == len(FIELDS[v]) and DIGITS.fullmatch(parts[-1]) and DIGITS.fullmatch(parts[2]) and end + 1 + int(parts[-1]) <= len(data):
                found = dict(zip(FIELDS[v], parts, strict=True))
        if not found:  # a blank line between records, or damage
            at = end + 1
            continue
        stop = end + 1 + int(found["length"])
        block = data[end + 1 : stop]
        if found["uri"].startswith("filedesc://") and block[:1] in (b"1", b"2"):
            version = int(block[:1])
        yield ArcRecord(start + at, found, block)
        at = stop


def records_of(content: bytes) -> Iterator[ArcRecord]:
    """Records of an archive file, over damage."""
    start, version = 0, 1
    for part in unpacked(content):
        for record in parse_arc(part, start, version):
            if record.fields["uri"].startswith("filedesc://") and record.block[:1] in (b"1", b"2"):
                version = int(record.block[:1])
            yield record
        start += len(part)


def iso_date(digits: str) -> str:
    d = (digits[:14] + "19700101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("-?[0-9]{1,19}", text) and -(2**63) <= int(text) < 2**63 else None


def synthesise(record: ArcRecord) -> dict:
    """WARC type, identifiers, date and digests of an ARC record."""
    f, kind = record.fields, "resource"
    head, payload, fields = b"", record.block, {}
    if f["uri"].startswith("filedesc://"):
        kind = "warcinfo"
    elif record.block.startswith(b"HTTP/"):
        kind, (head, payload, fields) = "response", http_parts(record.block)
    digest = hashlib.sha256(payload).hexdigest()
    name = f"{f['uri']} {f['date']} {record.offset} {digest} {fields.get('x-page-id', '')}"
    return {"kind": kind, "id": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "uri": f["uri"], "ip": f["ip"], "mime": f["mime"], "date": iso_date(f["date"]), "digest": digest, "head": head, "payload": payload, "page_id": _number(fields.get("x-page-id"))}


def warc_record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = {"WARC-Type": kind} | fields | {"WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        length = _number(fields.get("Content-Length"))
        if length is None or length < 0 or end + 4 + length > len(data):  # damage
            at += 7
            continue
        yield fields, data[end + 4 : end + 4 + length]
        at = end + 8 + length


def _bytes(parts: list[bytes], cut: int) -> pa.RecordBatch:
    """One archive as one row for the text writer, which ends it with its own separator of ``cut`` bytes and writes all
    others as they are, whether or not they are a text."""
    return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)[:-cut]], pa.binary()).view(pa.string())], ["value"])


def write_arc(records: DataFrame, path: str) -> None:
    """Archives of (page_id, url, payload as text or bytes, 14-digit date), of alternate versions, one gzip file each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n = [], 0, 0
        for batch in batches:
            for page_id, url, text, date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 1 + n % 2
                if not parts:
                    parts, size = [arc_start(version, f"part-{n}.arc", "20240101000000")], 0
                block = http_block(page_id, text.encode() if isinstance(text, str) else bytes(text or b""))
                parts += [arc_header(version, clean_uri(url), date, "text/html", len(block), filename=f"part-{n}.arc", offset=size), block, b"\n"]
                size += len(block)
                if size >= ARCHIVE_BYTES:
                    yield _bytes(parts, 1)
                    parts, n = [], n + 1
        if parts:
            yield _bytes(parts, 1)

    rows = records.select("page_id", "url", "payload", "date").mapInArrow(pack, "value string")
    rows.write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").text(path)


def _archives(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def read_arc(spark, path: str) -> DataFrame:
    """Metadata of every ARC record as the converter synthesises it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, content in zip(batch.column(0), batch.column(1), strict=True):
                out: dict[str, list] = {k: [] for k in ("path", "offset", "kind", "page_id", "id", "uri", "date", "bytes", "digest")}
                for r in records_of(content.as_py()):
                    s = synthesise(r)
                    for k, v in (s | {"path": at.as_py(), "offset": r.offset, "bytes": len(s["payload"])}).items():
                        if k in out:
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("offset", "page_id", "bytes") else pa.string()) for k, v in out.items()], list(out))

    return _archives(spark, path).select("path", "content").mapInArrow(scan, "path string, offset long, kind string, page_id long, id string, uri string, date string, bytes long, digest string")


def revisits(meta: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Records that revisit another of equal payload: their place, and the identifier, target and date of that other."""
    large = meta.filter((F.col("kind") == "response") & (F.col("bytes") >= least))
    rank: Column = F.struct(F.coalesce("page_id", F.lit(2**63 - 1)).alias("rank"), "path", "offset", "id", "uri", "date")
    first = large.groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).filter("n > 1")
    both = large.select("digest", "path", "offset").join(first, "digest")
    return both.filter((F.col("path") != F.col("first.path")) | (F.col("offset") != F.col("first.offset"))).select("path", F.struct("offset", "first.id", "first.uri", "first.date").alias("r"))


def convert(spark, source: str, target: str, least: int = LEAST_REVISIT) -> None:
    """Rewrite the ARC files under source as gzip WARC files under target."""
    meta = materialize(read_arc(spark, source), "arc-meta")
    again = materialize(revisits(meta, least).groupBy("path").agg(F.collect_list("r").alias("again")), "revisits")  # an archive's records at most

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, known in zip(*batch.columns, strict=True):
                seen = {x["offset"]: x for x in known.as_py() or ()}
                parts = []
                for r in records_of(content.as_py()):
                    s = synthesise(r)
                    fields = {"WARC-Record-ID": s["id"], "WARC-Date": s["date"]}
                    if s["kind"] == "warcinfo":
                        parts.append(warc_record("warcinfo", fields | {"Content-Type": "application/warc-fields"}, b"software: factloom\r\nformat: WARC File Format 1.1\r\n"))
                        continue
                    fields |= {"WARC-Target-URI": s["uri"], "WARC-IP-Address": s["ip"], "WARC-Payload-Digest": f"sha256:{s['digest']}", "Content-Type": "application/http; msgtype=response" if s["kind"] == "response" else s["mime"]}
                    if x := seen.get(r.offset):
                        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": x["id"], "WARC-Refers-To-Target-URI": x["uri"], "WARC-Refers-To-Date": x["date"], "X-Payload-Length": str(len(s["payload"]))}
                        parts.append(warc_record("revisit", fields, s["head"]))
                    else:
                        parts.append(warc_record(s["kind"], fields, r.block))
                yield _bytes(parts, 2)

    archives = _archives(spark, source)
    size = again.select(F.explode("again").alias("r")).agg(F.sum(F.length("r.id") + F.length("r.uri") + F.length("r.date") + 40)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        pairs = archives.join(F.broadcast(again), "path", "left")
    else:
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(archives.agg(F.sum("length")).first()[0]) // TASK_BYTES))
        pairs = archives.repartition(tasks, "path").join(again.repartition(tasks, "path"), "path", "left")
    with small_batches(spark, 8):
        pairs.select("content", "again").mapInArrow(rewrite, "value string").write.option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\r\n").text(target)
    drop(meta, again)


def read_warc(spark, path: str) -> DataFrame:
    """The response, revisit and resource records: identifiers, digests as recomputed (revisit: as declared), lengths."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id")}
                for fields, block in (x for part in unpacked(content.as_py()) for x in parse_warc(part)):
                    kind = fields.get("WARC-Type")
                    if kind not in ("response", "revisit", "resource"):
                        continue
                    _, payload, own = http_parts(block) if kind != "resource" else (b"", block, {})
                    out["page_id"].append(_number(own.get("x-page-id")))
                    out["payload_bytes"].append(_number(fields.get("X-Payload-Length", own.get("content-length"))) if kind == "revisit" else len(payload))
                    out["payload_digest"].append(fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest())
                    out["record_type"].append(kind)
                    out["record_id"].append(fields.get("WARC-Record-ID"))
                    out["refers_to_id"].append(fields.get("WARC-Refers-To"))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if k in ("page_id", "payload_bytes") else pa.string()) for k, v in out.items()], list(out))

    return _archives(spark, path).select("content").mapInArrow(scan, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string")


def resolve(records: DataFrame) -> DataFrame:
    """Adds refers_to: the page_id of the record that a revisit names."""
    revisit = F.col("record_type") == "revisit"
    names = records.filter(~revisit).select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.filter(~revisit).withColumn("refers_to", F.lit(None).cast("long")).unionByName(records.filter(revisit).join(names, "refers_to_id", "left"))


def op9_legacy_archives(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(31_536_000))), "yyyyMMddHHmmss")
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(pages.select("page_id", "url", F.col("html").alias("payload"), day.alias("date")), arc)
    convert(spark, arc, warc)
    drop_path(spark, arc)
    return resolve(read_warc(spark, warc)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
r AS (
  SELECT *, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS place,
    min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN least END AS refers_to
FROM r
"""
