"""Legacy archive converter: ARC files to WARC files, and readers of both.

Archives are written by Spark's text writer (one record per row, the format's own separator between records) and read
as whole files of bounded size, so they may stand in any file system that Spark reaches. Each task starts a new file
after ``FILE_BYTES`` of payload; readers hold one file at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respmosaic.llm.storage import folder, store

#: Payload bytes after which a task starts a new archive file.
FILE_BYTES = 16 << 20
#: Smallest payload that is worth a revisit record.
REVISIT_BYTES = 1000
#: Characters of a URL that stand in a header line as they are (no space, no control characters).
_PLAIN = "!#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Fixed: fields of the URL record of ARC versions 1 and 2.
FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
_TITLES = {"url": "URL", "ip": "IP-address", "date": "Archive-date", "mime": "Content-type", "status": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "filename": "Filename", "length": "Archive-length"}

ARC_SCHEMA = "file string, offset long, url string, ip string, date string, mime string, status int, payload binary, digest binary"


def _rows(rows: Iterator[dict], schema: pa.Schema, size=lambda r: 0, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``limit`` bytes by ``size``, or 2,000 rows."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= limit or len(held) >= 2000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _write(records: DataFrame, path: str, separator: str) -> None:
    """``records(piece, seq, record)``: one file per task and piece, in order of ``seq``."""
    ordered = records.sortWithinPartitions("piece", "seq").select("piece", F.col("record").cast("string").alias("value"))
    ordered.write.partitionBy("piece").option("lineSep", separator).option("compression", "gzip").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")


_RECORD = pa.schema([("piece", pa.int32()), ("seq", pa.int64()), ("record", pa.binary())])


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "20260101000000") -> None:
    """Writes ARC files of both versions: a row's version follows from a hash of its id. The id goes into the URL field as ``urn:page:<id>:<url>``."""
    slim = pages.select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"))

    def lines(batches):
        open_files = {1: [1, 0, 0], 2: [2, 0, 0]}  # per version its piece, bytes and records

        def records():
            for batch in batches:
                ids, urls, payloads = batch.columns
                for i, u, p in zip(ids.to_pylist(), urls.to_pylist(), payloads):
                    body = p.as_py()
                    version = 1 + zlib.crc32((i or "").encode()) % 2
                    state = open_files[version]
                    if state[1] and state[1] + len(body) > FILE_BYTES:
                        state[:] = state[0] + 2, 0, 0
                    piece = state[0]
                    if not state[2]:
                        intro = f"{version} 0 respmosaic\n{' '.join(_TITLES[f] for f in FIELDS[version])}\n".encode()
                        extra = "200 - - 0 - " if version == 2 else ""
                        yield {"piece": piece, "seq": 0, "record": f"filedesc://{piece}.arc 0.0.0.0 {date} text/plain {extra}{len(intro)}\n".encode() + intro}
                    state[1] += len(body) + 1
                    state[2] += 1
                    uri = f"urn:page:{i or ''}:{quote(u, safe=_PLAIN) if u else '-'}"
                    extra = f"200 {hashlib.md5(body).hexdigest()} - {state[1]} - " if version == 2 else ""
                    yield {"piece": piece, "seq": state[2], "record": f"{uri} 0.0.0.0 {date} text/html {extra}{len(body)}\n".encode() + body}

        yield from _rows(records(), _RECORD, lambda r: len(r["record"]))

    _write(slim.mapInArrow(lines, "piece int, seq long, record binary"), path, "\n")


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file by its version block's field line and the declared lengths."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"ARC header without end at byte {at}")
        values = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        if values[0].startswith("filedesc://"):
            length = int(values[-1])
            version = data[end + 1 : end + 1 + length].split(b" ", 1)[0]
            fields = FIELDS[int(version)]
        elif len(values) != len(fields):
            raise ValueError(f"ARC header at byte {at} has {len(values)} fields, {len(fields)} are declared")
        else:
            head = dict(zip(fields, values))
            length = int(head["length"])
            body = data[end + 1 : end + 1 + length]
            if len(body) != length:
                raise ValueError(f"ARC record at byte {at} is cut short")
            yield {"offset": at, "url": head["url"], "ip": head["ip"], "date": head["date"], "mime": head["mime"], "status": int(head.get("status", 200)), "payload": body, "digest": hashlib.sha1(body).digest()}
        at = end + 1 + length


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per ARC record below ``path`` (plain or gzip). ``payload=False`` keeps length and digest only."""
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("status", pa.int32())] + ([("payload", pa.binary())] if payload else [("length", pa.int64())]) + [("digest", pa.binary())])

    def records(batches):
        for batch in batches:
            for name, content in zip(*batch.columns):
                found = ({"file": name.as_py(), **r, "length": len(r["payload"])} for r in parse_arc(_plain(content.as_py())))
                yield from _rows(found, schema, lambda r: len(r["payload"]) if payload else 0)

    return _files(spark, path).mapInArrow(records, ARC_SCHEMA if payload else ARC_SCHEMA.replace("payload binary", "length long"))


def record_id(url: str, date: str, digest: bytes) -> str:
    """The same legacy record always gets the same WARC identifier."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest.hex()}')}>"


def _stamp(date: str) -> str:
    d = date.ljust(14, "0")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def page_number(uri: str | None) -> int | None:
    """The id that :func:`write_arc` put into a URI."""
    part = (uri or "").split(":", 3)
    return int(part[2]) if part[:2] == ["urn", "page"] and part[2] else None


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = REVISIT_BYTES) -> None:
    """ARC files to WARC files: identifiers, timestamps, types and digests are synthesised from the legacy headers.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest page id is a ``response`` and the others are
    ``revisit`` records without payload that refer to it; a null id is smaller than any, and where all are null, or rows
    repeat the largest id, each is a response. Smaller payloads are always responses. Empty archives give empty archives.
    """
    number = F.expr("try_cast(split_part(url, ':', 3) as long)")
    heads = read_arc(spark, arc_path, payload=False).where(F.col("length") >= min_bytes)
    groups = heads.groupBy("digest").agg(F.max_by(F.struct("url", "date"), number).alias("r"), F.max(number).alias("best"), F.count(F.lit(1)).alias("n"))
    winners = store(groups.where("n > 1 and best is not null").select("digest", F.col("r.url").alias("to_url"), F.col("r.date").alias("to_date"), "best"), "warc-winners")
    records = read_arc(spark, arc_path).withColumn("number", number).join(winners, "digest", "left")
    records = records.withColumn("revisit", F.col("best").isNotNull() & (F.length("payload") >= min_bytes) & (F.coalesce(F.col("number") < F.col("best"), F.lit(True))))
    slim = records.select("url", "ip", "date", "mime", "status", "digest", "revisit", "to_url", "to_date", F.length("payload").alias("length"), F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"))

    def build(batches):
        def made():
            piece, total, seq = 0, 0, 0
            for batch in batches:
                for i in range(batch.num_rows):
                    r = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                    if total and total + len(r["payload"]) > FILE_BYTES:
                        piece, total, seq = piece + 1, 0, 0
                    if not seq:
                        info = b"software: respmosaic\r\nformat: WARC File Format 1.1\r\n"
                        yield {"piece": piece, "seq": 0, "record": warc_record("warcinfo", {"WARC-Record-ID": record_id("info", r["date"], r["digest"]), "WARC-Date": _stamp(r["date"]), "Content-Type": "application/warc-fields"}, info)}
                    seq += 1
                    total += len(r["payload"])
                    http = f"HTTP/1.1 {r['status']} -\r\nContent-Type: {r['mime']}\r\nContent-Length: {r['length']}\r\n\r\n".encode()
                    headers = {
                        "WARC-Record-ID": record_id(r["url"], r["date"], r["digest"]),
                        "WARC-Date": _stamp(r["date"]),
                        "WARC-Target-URI": r["url"],
                        "WARC-IP-Address": r["ip"],
                        "WARC-Payload-Digest": f"sha1:{base64.b32encode(r['digest']).decode()}",
                        "Content-Type": "application/http; msgtype=response",
                    }
                    if r["revisit"]:
                        headers |= {
                            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                            "WARC-Refers-To": record_id(r["to_url"], r["to_date"], r["digest"]),
                            "WARC-Refers-To-Target-URI": r["to_url"],
                        }
                    yield {"piece": piece, "seq": seq, "record": warc_record("revisit" if r["revisit"] else "response", headers, http + r["payload"])}

        yield from _rows(made(), _RECORD, lambda r: len(r["record"]))

    _write(slim.mapInArrow(build, "piece int, seq long, record binary"), warc_path, "\r\n\r\n")


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        if stop > len(data):
            raise ValueError(f"WARC record at byte {at} is cut short")
        yield head, data[end + 4 : stop]
        at = stop


WARC_SCHEMA = "record_id string, record_type string, date string, uri string, refers_to_uri string, payload_bytes long, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Response and revisit records below ``path``. A response's payload is checked against its digest; a revisit has none."""
    schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("refers_to_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())] + [("payload", pa.binary())] * payload)

    def records(content: bytes):
        for head, block in parse_warc(_plain(content)):
            if head["warc-type"] not in ("response", "revisit"):
                continue
            top, _, body = block.partition(b"\r\n\r\n")
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            declared = next(int(x.split(b":")[1]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:"))
            if head["warc-type"] == "response" and (len(body) != declared or hashlib.sha1(body).hexdigest() != digest):
                raise ValueError(f"{head['warc-record-id']}: payload and digest differ")
            yield {"record_id": head["warc-record-id"], "record_type": head["warc-type"], "date": head["warc-date"], "uri": head["warc-target-uri"], "refers_to_uri": head.get("warc-refers-to-target-uri"), "payload_bytes": declared, "payload_digest": digest, "payload": body if head["warc-type"] == "response" else None}

    def read(batches):
        for batch in batches:
            for content in batch.column(1):
                yield from _rows(records(content.as_py()), schema, lambda r: len(r["payload"] or b"") if payload else 0)

    return _files(spark, path).mapInArrow(read, WARC_SCHEMA if payload else WARC_SCHEMA.replace(", payload binary", ""))


def original_url(uri: str) -> str:
    return unquote(uri.split(":", 3)[3])


def digest(pages: DataFrame) -> DataFrame:
    """Pages to ARC files, those to WARC files, and a row per WARC record read back."""
    spark = pages.sparkSession
    arc, warc = folder(spark, "pages-arc"), folder(spark, "pages-warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    number = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) as long)")
    return read_warc(spark, warc, payload=False).select(number("uri").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to_uri").alias("refers_to"))
