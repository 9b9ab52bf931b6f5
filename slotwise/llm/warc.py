"""WARC archives: writing pages as records, and reading them back with segment reassembly.

Writing. A payload is UTF-8 text. Of equal payloads the page of the largest id is written as a
response, with chunked transfer framing; the others are written as revisit records that refer to it.
A response longer than ``segment_bytes`` is split: the first record has segment number 1, the rest are
continuation records with the first record's id as origin and rising segment numbers, and the last
one states the total length. Archives are written by Spark's text writer, one record a line (a record
ends with a line break), compressed by gzip, in files of a bounded number of records. As a record holds
at most ``segment_bytes`` and its headers, that bounds their bytes too: 16,384 records of 16 KiB are below 280 MB
before compression.

Reading. Files are unpacked piece by piece and parsed record by record by their content lengths, so that
nothing inside a payload can look like a record, and a task holds a compressed file, one record and 256 rows. Whole responses are decoded where they are found. Segments are grouped by
origin id, ordered by segment number and joined; their total length is verified, then the chunked
transfer framing is decoded. Only segments travel. A missing, repeated or overlong segment, a wrong
total or broken framing raises an error.

Defined cases: a null payload counts as empty; payloads of length 0 are equal payloads; rows that
repeat a page id with an equal payload are all responses if the id is the largest, and each has record
and segment ids of its own, made from page id, digest, address and the number of the copy; a revisit
refers to a first copy; a null id ranks lowest and is written empty; an empty table gives an archive
without records; further columns, whatever their names, are left out; a payload of any length is split,
none is cut.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.llm.common import col, cut, shared_dir
from slotwise.llm.words import slices

SEGMENT_BYTES, CHUNK_BYTES, RECORDS_A_FILE, PIECE = 16 << 10, 4 << 10, 16384, 1 << 18
CRLF = b"\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def unchunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != CRLF:
            raise ValueError("broken chunked framing")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + CRLF + block + CRLF + CRLF


def unpacked(content: bytes) -> Iterator[bytes]:
    """The bytes of a file in pieces, decompressed if it is gzip, of one member or more."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    rest = memoryview(content)
    while rest:
        member = zlib.decompressobj(31)
        for at in range(0, len(rest), PIECE):
            yield member.decompress(rest[at : at + PIECE])
            if member.eof:
                rest = rest[min(at + PIECE, len(rest)) - len(member.unused_data) :]
                break
        else:
            raise ValueError("the archive ends within a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of every record of an archive that comes in pieces."""
    source = iter(pieces)
    held, at, done = b"", 0, 0

    def have(n: int) -> bool:
        """Whether ``n`` bytes from the record's first on are there, reading on as needed."""
        nonlocal held, at
        if len(held) - at < n:
            parts, size = [held[at:]], len(held) - at
            while size < n and (piece := next(source, None)) is not None:
                parts.append(piece)
                size += len(piece)
            held, at = b"".join(parts), 0
        return len(held) - at >= n

    while have(1):
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            there = len(held) - at
            if not have(there + 1):
                raise ValueError(f"no end of the headers of the record at byte {done}")
        lines = held[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {done}")
        fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        head = end + 4 - at
        length = head + int(fields["Content-Length"])
        if not have(length + 4) or held[at + length : at + length + 4] != b"\r\n\r\n":
            raise ValueError(f"wrong length of the record at byte {done}")
        yield fields, held[at + head : at + length]
        at += length + 4
        done += length + 4


def _id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, ':'.join(map(str, parts)))}>"


def _cuts(block: bytes, most: int) -> list[bytes]:
    """The block in pieces of about ``most`` bytes, each valid UTF-8."""
    out, at = [], 0
    while at < len(block):
        stop = min(at + most, len(block))
        while stop < len(block) and block[stop] & 0xC0 == 0x80:
            stop += 1
        out.append(block[at:stop])
        at = stop
    return out


def page_records(page: int | None, url: str, payload: bytes, keeper: int | None, response: bool, segment_bytes: int, copy: int = 0, keeper_url: str = "") -> list[bytes]:
    """The records of one page, the ``copy``-th from 0 of those of equal id, address and payload."""
    sha = base32_sha1(payload)
    name = "" if page is None else str(page)
    fields = {"WARC-Record-ID": _id("page", name, sha, copy, url), "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"), "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Page-ID": name}
    if not response:
        target = "" if keeper is None else str(keeper)
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _id("page", target, sha, 0, keeper_url), "WARC-Refers-To-Page": target}
        return [record("revisit", fields, f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode())]
    block = _HTTP + chunked(payload)
    if len(block) <= segment_bytes:
        return [record("response", fields, block)]
    parts = _cuts(block, segment_bytes)
    out = [record("response", fields | {"WARC-Segment-Number": "1"}, parts[0])]
    for k, part in enumerate(parts[1:], 2):
        more = {"WARC-Record-ID": _id("segment", name, sha, copy, k, url), "WARC-Segment-Origin-ID": fields["WARC-Record-ID"], "WARC-Segment-Number": str(k)}
        out.append(record("continuation", more | ({"WARC-Segment-Total-Length": str(len(block))} if k == len(parts) else {}), part))
    return out


def chunked(payload: bytes) -> bytes:
    """Chunked framing whose chunks are valid UTF-8."""
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in _cuts(payload, CHUNK_BYTES)) + b"0\r\n\r\n"


def write_archives(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", segment_bytes: int = SEGMENT_BYTES, records_a_file: int = RECORDS_A_FILE) -> None:
    """Write the pages as archive files below ``path``."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = pages.select(col(id_col).cast("bigint").alias("id"), F.coalesce(col(url_col).cast("string"), F.lit("")).alias("url"), text.alias("text"), F.sha1(text).alias("sha"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat_ws("\n", "sha", F.coalesce(F.col("id").cast("string"), F.lit("")), "url").cast("binary"))))
    keepers = rows.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "k")
    kept = rows.select("sha", "key").distinct().join(cut(keepers), "sha").select("key", "k")
    # Repeated rows meet before the shuffle and are counted; each copy is written with its number.
    pages_once = rows.groupBy("key").agg(F.first("text").alias("text"), F.first("id").alias("id"), F.first("url").alias("url"), F.count(F.lit(1)).alias("n"))
    known = pages_once.join(kept, "key", "left").select("text", "id", "url", F.coalesce("k.id", "id").alias("keeper"), F.coalesce("k.url", "url").alias("keeper_url"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("copy"))

    def run(batches):
        for whole in batches:
            for batch in slices(whole, 0):
                out = [
                    r[:-1].decode()
                    for payload, page, url, keeper, keeper_url, copy in zip(*[c.to_pylist() for c in batch.columns], strict=True)
                    for r in page_records(page, url, payload.encode(), keeper, page == keeper, segment_bytes, copy, keeper_url)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    known.mapInArrow(run, "value string").write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_a_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload, payload_bytes, payload_digest, record_type, refers_to of every response and revisit."""
    schema = "page_id bigint, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    parsed = files.mapInArrow(_parse, f"{schema}, origin string, segment int, total bigint")
    whole = parsed.where("origin IS NULL").drop("origin", "segment", "total")
    parts = parsed.where("origin IS NOT NULL")
    joined = parts.groupBy("origin").agg(
        F.max("page_id").alias("page_id"),
        F.max("payload_digest").alias("payload_digest"),
        F.max("total").alias("total"),
        F.transform(F.sort_array(F.collect_list(F.struct("segment", "payload"))), lambda x: x["segment"]).alias("segments"),
        F.transform(F.sort_array(F.collect_list(F.struct("segment", "payload"))), lambda x: x["payload"]).alias("blocks"),
    )
    return whole.unionByName(joined.select("page_id", "payload_digest", "total", "segments", "blocks").mapInArrow(_join, schema))


def _payload(block: bytes, said: str) -> tuple[bytes, str]:
    head, body = block.split(b"\r\n\r\n", 1)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    sha = base32_sha1(payload)
    if sha != said:
        raise ValueError("the payload does not have the digest that its record states")
    return payload, sha


_PLAIN = pa.schema([("page_id", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_PARSED = pa.schema([*_PLAIN, ("origin", pa.string()), ("segment", pa.int32()), ("total", pa.int64())])


def _number(text: str | None) -> int | None:
    return int(text) if text else None


def _row(f: dict[str, str], block: bytes) -> tuple | None:
    """A record as a row: a revisit or whole response, or a segment."""
    kind, page, said = f["WARC-Type"], _number(f.get("WARC-Page-ID")), f.get("WARC-Payload-Digest", "")[5:] or None
    if "WARC-Segment-Number" in f:
        origin = f.get("WARC-Segment-Origin-ID", f["WARC-Record-ID"])
        return page, block, None, said, kind, None, origin, int(f["WARC-Segment-Number"]), _number(f.get("WARC-Segment-Total-Length"))
    if kind == "revisit":
        length = next(int(x.split(b":")[1]) for x in block.split(CRLF) if x.lower().startswith(b"content-length:"))
        return page, None, length, said, kind, _number(f.get("WARC-Refers-To-Page")), None, None, None
    if kind == "response":
        payload, sha = _payload(block, said)
        return page, payload, len(payload), sha, kind, None, None, None, None
    return None


def _parse(batches):
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for fields, block in records(unpacked(content.as_py())):
                if row := _row(fields, block):
                    rows.append(row)
                if len(rows) == 256:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)


def _join(batches):
    for batch in batches:
        for r in batch.to_pylist():
            if r["segments"] != list(range(1, len(r["segments"]) + 1)) or r["total"] != sum(map(len, r["blocks"])):
                raise ValueError(f"segments of page {r['page_id']} are not whole")
            payload, sha = _payload(b"".join(r["blocks"]), r["payload_digest"])
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((r["page_id"], payload, len(payload), sha, "response", None), _PLAIN, strict=True)], schema=_PLAIN)


def archive_and_read(pages: DataFrame, *, path: str | None = None, **options) -> DataFrame:
    """The rows read back from archives of ``pages``, written to ``path`` or a new folder of the shared one."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/slotwise/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, **options)
    return read_archives(spark, path)
