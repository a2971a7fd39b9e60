"""WARC archives: writing pages, reading records, and putting segments together again.

Writing deals records to tasks; each task streams gzip members to its own file
in the shared folder and reports it, and only reported files are read, so files
of lost or repeated attempts don't count. A block larger than ``segment_bytes``
is split into a first segment and continuation records. Reading streams each
file; continuation records are grouped by origin identifier, ordered by segment
number and checked against the total length before the HTTP message's chunked
framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if, cut, fresh_path, ship

# Fixed values of the format.
VERSION = b"WARC/1.1"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"

RECORD = (
    "kind string, record_id string, page_id long, url string, digest string, refers_to long, origin string, "
    "segment long, total long, block binary, payload_bytes long, payload_digest string, complete boolean"
)
RECORD_NAMES = [f.split()[0] for f in RECORD.split(", ")]


@dataclass(frozen=True)
class WarcParams:
    least_revisit_bytes: int = 0  # smaller equal payloads are all responses
    segment_bytes: int = 32_768  # of block in one record
    chunk_bytes: int = 8_192  # of payload in one chunk of the HTTP message
    file_bytes: int = 256 << 20  # a file is closed beyond this size
    level: int = 1
    broadcast_rows: int = 200_000  # revisits and what they refer to, some 200 bytes each, sent to every executor at most; beyond, the join shuffles


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing, with its closing chunk."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x" % len(part), CRLF, part, CRLF]
    return b"".join([*parts, b"0", CRLF, CRLF])


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; raises where the framing breaks off or lies."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0].strip() or b"x", 16)
        at = end + 2
        if not size:
            return b"".join(parts)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk isn't as long as it says")
        parts.append(body[at : at + size])
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """The entity of an HTTP response message, by its transfer framing."""
    head, _, body = block.partition(CRLF + CRLF)
    if any(line.lower().replace(b" ", b"") == b"transfer-encoding:chunked" for line in head.split(CRLF)[1:]):
        return dechunked(body)
    return body


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in fields if v is not None), b"Content-Length: %d" % len(block)]
    return CRLF.join(lines) + CRLF + CRLF + block + CRLF + CRLF


def _clean(url: str | None) -> str | None:
    return url.replace("\r", "%0D").replace("\n", "%0A") if url else None


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int, str | None] | None, referred: bool, salt: str, p: WarcParams) -> Iterator[bytes]:
    """The records of one page: a revisit, or a response and its continuations.

    A response that others revisit, ``referred``, is named by its page and digest, so that they can name it; other names hold a salt, as pages may repeat.
    """
    name = f"<urn:x-page:{'' if page_id is None else page_id}:{digest if referred else salt}"
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    common = [("WARC-Record-ID", name + ">"), ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", "sha1:" + digest)]
    if refers_to is not None:
        own = [("WARC-Type", "revisit"), ("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<urn:x-page:{refers_to[0]}:{digest}>"), ("WARC-Refers-To-Target-URI", _clean(refers_to[1])), ("WARC-Refers-To-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
        yield _record(common + own, CRLF.join([*head, b"", b""]))
        return
    block = CRLF.join([*head, b"Transfer-Encoding: chunked", b"", b""]) + chunked(payload, p.chunk_bytes)
    parts = [block[at : at + p.segment_bytes] for at in range(0, len(block), p.segment_bytes)]
    first = [("WARC-Type", "response"), ("Content-Type", "application/http; msgtype=response")]
    yield _record(common + first + ([("WARC-Segment-Number", 1)] if len(parts) > 1 else []), parts[0])
    for k, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name + ">"), ("WARC-Segment-Number", k)]
        yield _record(own + ([("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []), part)


def warcinfo(name: str) -> bytes:
    """The record that says what an archive is and who made it."""
    own = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
    return _record(own, b"software: dbpulse" + CRLF + b"format: WARC File Format 1.1" + CRLF)


def open_folder(uri: str):
    """A file system and the path in it, for any store that Arrow reaches."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _writer(folder: str, p: WarcParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        store.create_dir(base, recursive=True)
        out, name, size, rows = None, "", 0, 0

        def put(record: bytes) -> int:
            member = zlib.compressobj(p.level, zlib.DEFLATED, 31)
            return out.write(member.compress(record) + member.flush())

        for batch in batches:
            pages, urls, firsts, first_urls, referred = (batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5))
            for i, page in enumerate(pages):
                payload = (batch.column(2)[i].as_py() or "").encode()
                if out is None:
                    name, size, rows = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    size += put(warcinfo(name))
                rows += 1
                refers = None if firsts[i] is None else (firsts[i], first_urls[i])
                for record in page_records(page, urls[i], payload, base32_sha1(payload), refers, referred[i], f"{name[5:17]}-{rows}", p):
                    size += put(record)
                if size >= p.file_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "pages": [rows]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size], "pages": [rows]})

    return run


def write(pages: DataFrame, folder: str, params: WarcParams = WarcParams()) -> DataFrame:
    """Writes a record per row of (page_id, url, html) under ``folder``; returns (file, bytes, pages) of the archives.

    Of equal payloads that are long enough the smallest page_id's is the response and the others revisit it.
    A null html is an empty payload. Rows with a null page_id are responses; rows that repeat a page_id get a
    record each; where the first page of a payload itself repeats with it, no single row can bear the name by which
    the others refer to it. Other columns are not read.
    """
    ship(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    size, sha = F.octet_length("html"), F.sha1(F.encode("html", "utf-8"))
    # only digests travel: of payloads that come more than once, who is the response and who revisits it
    keyed = cut(rows.where("page_id is not null").select("page_id", "url", sha.alias("sha"), size.alias("size")).where(F.col("size") >= params.least_revisit_bytes), "digests")
    least = F.min(F.struct("page_id", "url")).alias("first")
    firsts = cut(keyed.groupBy("sha", "size").agg(least, F.count("*").alias("n")).where("n > 1").select("sha", "size", F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url")), "firsts")
    alike = keyed.join(firsts, ["sha", "size"]).groupBy(F.col("page_id").alias("__page"), F.col("sha").alias("__sha"), "first", "first_url").agg((F.count("*") > 1).alias("repeats"))
    few = cut(alike, "relations")
    both = rows.join(broadcast_if(few, few.count(), params.broadcast_rows), (F.col("page_id") == F.col("__page")) & (sha == F.col("__sha")), "left")
    own = F.col("page_id") == F.col("first")
    refers = F.when(~own, F.col("first"))
    referred = F.coalesce(own & ~F.col("repeats"), F.lit(False))
    return cut(both.select("page_id", "url", "html", refers.alias("refers_to"), F.when(~own, F.col("first_url")).alias("first_url"), referred.alias("referred")).mapInArrow(_writer(folder, params), "file string, bytes long, pages long"), "manifest")


def parse_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of a stream of gzip members or plain records."""
    buffer, inflate, ended, gz = b"", None, False, None

    def more() -> bool:
        nonlocal buffer, inflate, ended, gz
        data = stream.read(1 << 20)
        if not data:
            ended = True
            return False
        if gz is None:
            gz = data[:2] == b"\x1f\x8b"
        if not gz:
            buffer += data
            return True
        parts = [buffer]
        while data:
            inflate = inflate or zlib.decompressobj(31)
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
            if inflate.eof:
                inflate = None
        buffer = b"".join(parts)
        return True

    at = 0
    while True:
        while (end := buffer.find(CRLF + CRLF, at)) < 0:
            buffer, at = buffer[at:], 0
            if not more():
                if buffer.strip():
                    raise ValueError("an archive breaks off within a header")
                return
        lines = buffer[at:end].decode(errors="replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = int(fields["content-length"])
        start = end + 4
        while len(buffer) < start + size + 4:
            buffer, start, at = buffer[at:], start - at, 0
            if not more():
                raise ValueError("an archive breaks off within a block")
        yield fields, buffer[start : start + size]
        at = start + size + 4


def _page_of(record_id: str | None) -> int | None:
    number = (record_id or "").strip("<>").removeprefix("urn:x-page:").split(":")[0]
    return int(number) if number.lstrip("-").isdigit() else None


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}.get(k, pa.string())) for n, k in (f.split() for f in RECORD.split(", "))])
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            store, path = open_folder(uri)
            rows, held = [], 0
            with store.open_input_stream(path, compression=None) as stream:
                for fields, block in parse_records(stream):
                    kind, name = fields.get("warc-type"), fields.get("warc-record-id")
                    row = dict.fromkeys(RECORD_NAMES) | {"kind": kind, "record_id": name, "page_id": _page_of(name), "url": fields.get("warc-target-uri"), "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:")}
                    if "warc-segment-number" in fields:
                        total = fields.get("warc-segment-total-length")
                        row |= {"origin": fields.get("warc-segment-origin-id", name), "segment": int(fields["warc-segment-number"]), "total": int(total) if total else None, "block": block}
                        held += len(block)
                    elif kind == "revisit":
                        row |= {"refers_to": _page_of(fields.get("warc-refers-to")), "complete": True}
                    elif kind == "response":
                        row |= _decoded(block, row["digest"])
                    rows.append(row)
                    if len(rows) >= 5000 or held >= 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def _decoded(block: bytes, digest: str | None) -> dict:
    """Length and digest of a whole block's payload; complete if its framing holds and its digest is the one given."""
    try:
        payload = http_payload(block)
    except ValueError:
        return {"complete": False}
    found = base32_sha1(payload)
    return {"payload_bytes": len(payload), "payload_digest": found, "complete": not digest or found == digest}


def _reassemble(rows: pa.Table) -> pa.Table:
    """One row for an origin: its segments 1, 2, ... end to end, if none is missing and the total length is right."""
    got = {}
    for r in rows.to_pylist():
        got.setdefault(r["segment"], r)  # a segment that comes twice counts once
    first, numbers = got.get(1), sorted(got)
    any_row = got[numbers[0]]
    out = dict.fromkeys(["page_id", "payload_bytes", "payload_digest", "complete"]) | {"page_id": first["page_id"] if first else _page_of(any_row["origin"]), "complete": False}
    total = got[numbers[-1]]["total"]
    if first and numbers == list(range(1, len(numbers) + 1)) and total == sum(len(got[k]["block"]) for k in numbers):
        out |= _decoded(b"".join(got[k]["block"] for k in numbers), first["digest"])
    return pa.Table.from_pylist([out], pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("complete", pa.bool_())]))


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives named in ``file``; responses are decoded, segments keep their blocks."""
    spark = manifest.sparkSession
    ship(spark)
    files = manifest.select("file").distinct()
    tasks = max(1, min(files.count(), 100_000))  # given as a number, or adaptive execution would read all files in one task
    return files.repartition(tasks).mapInArrow(_reader, RECORD)


def pages(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, complete) of every response and revisit.

    complete is false, and what isn't known null, where segments are missing, a length or framing is wrong, a
    digest differs, or a revisit's response is nowhere.
    """
    kind = "page_id long, payload_bytes long, payload_digest string, complete boolean"
    parts = records.where("segment is not null").select("page_id", "digest", "origin", "segment", "total", "block")
    whole = records.where("kind = 'response' and segment is null").select("page_id", "payload_bytes", "payload_digest", "complete")
    responses = whole.unionByName(parts.groupBy("origin").applyInArrow(_reassemble, kind))
    visits = records.where("kind = 'revisit'").select("page_id", "refers_to", "digest")
    known = responses.where("page_id is not null").groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest")).agg(F.max("payload_bytes").alias("payload_bytes"))
    found = visits.join(known, ["refers_to", "digest"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), "complete").unionByName(
        found.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), "refers_to", F.col("payload_bytes").isNotNull().alias("complete"))
    )


def archived(pages_table: DataFrame, params: WarcParams = WarcParams(), folder: str | None = None) -> DataFrame:
    """Writes the pages to archives, reads these back, and returns what ``pages`` finds in them."""
    spark: SparkSession = pages_table.sparkSession
    manifest = write(pages_table, folder or fresh_path(spark, "warc"), params)
    return pages(cut(read(manifest), "records"))
