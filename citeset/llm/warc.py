"""WARC archives, index first.

``write_warc`` writes one gzip member per record and an index row ``page_id, url, path, offset, length,
digest`` per record. ``read_warc`` takes any selection of index rows, sorts them by place, coalesces
neighbouring byte ranges and reads each merged range once.

Of records with equal payloads of at least ``least`` bytes, the one with the smallest page id holds the
payload; the others are revisits that refer to it. The first id of each digest comes from a partial
aggregation, so a payload that a third of the pages share is one row there.

Null payloads count as empty. A null page id is written as ``null`` and comes back as null; it is never
the smallest id while another exists. Rows that repeat the smallest id and its payload are responses
too. Null urls leave out the target URI. Pages of any length are one record, held by one task. Empty tables give
no files. Only id, url and html are read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeReader, bounded, lean, new_path, partitions, slices, stage, write_file

LEAST = 100
FILE_BYTES = 64 << 20
#: Ranges at most GAP bytes apart are read as one, up to RANGE bytes.
GAP, RANGE = 64 << 10, 8 << 20
_PLAIN = re.compile("[!-~]+")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())])
INDEX_DDL = "page_id long, url string, path string, offset long, length long, digest string"


def _urn(page_id: int | None, place: str = "") -> str:
    """The name of a page; with a place in the archives, of one record, as page ids may repeat."""
    return f"<urn:x-page:{'null' if page_id is None else page_id}{place and ':' + place}>"


def _page(urn: str) -> int | None:
    name = urn.strip("<>").split(":")[2]
    return None if name == "null" else int(name)


def _target(url: str | None) -> list[tuple[str, str]]:
    """A URL as it is, or, if a header can't hold it (white space, controls, other than ASCII), escaped and marked so."""
    if url is None:
        return []
    if _PLAIN.fullmatch(url):
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", quote(url, safe="/:?#[]@!$&'()*+,;=~")), ("X-Target-Escaped", "percent")]


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, revisit: bool, place: str = "") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id, place)),
        ("WARC-Date", DATE),
        *_target(url),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(first))] if revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(1, wbits=31)
    return pack.compress(raw) + pack.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one record."""
    head, _, block = zlib.decompress(member, wbits=31).partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def write_warc(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write the archives; returns the staged index."""

    def write(batches):
        task, part, held, rows, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            path = f"{folder}/{task:06d}-{part:06d}.warc.gz"
            write_file(path, held)
            return pa.RecordBatch.from_pylist([x | {"path": path} for x in rows], schema=INDEX)

        for batch in batches:
            for piece in slices(batch, "html"):
                for x in piece.to_pylist():
                    revisit = x["first"] is not None and x["first"] != x["page_id"]
                    raw = record(x["page_id"], x["url"], x["html"].encode(), x["digest"], x["first"], revisit, f"{task}.{part}.{size}")
                    rows.append({"page_id": x["page_id"], "url": x["url"], "offset": size, "length": len(raw), "digest": x["digest"]})
                    held.append(raw)
                    size += len(raw)
                    if size >= FILE_BYTES:
                        yield flush()
                        part, held, rows, size = part + 1, [], [], 0
        if rows:
            yield flush()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # Staged apart, so that the pages of a frequent payload are a skewed partition that can be split. Short pages are dealt by their id.
    first = bounded(stage(first.where("n > 1").select(F.col("digest").alias("meet"), "first"), "warc-first"))
    meet = F.when(F.octet_length("html") >= least, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    return stage(rows.withColumn("meet", meet).join(first, "meet", "left").select("page_id", "url", "html", "digest", "first").mapInArrow(lean(write), INDEX_DDL), "warc-index")


def read_warc(index: DataFrame) -> DataFrame:
    """Read the records of the given index rows: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload``."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def ranges(batches):
        path, begin, end, own = None, 0, 0, []
        for batch in batches:
            for p, at, n in zip(*(batch.column(x).to_pylist() for x in ("path", "offset", "length")), strict=True):
                if own and (p != path or at > end + GAP or at + n - begin > RANGE):
                    yield path, begin, end, own
                    own = []
                if not own:
                    path, begin, end = p, at, at
                own.append((at - begin, n))
                end = max(end, at + n)
        if own:
            yield path, begin, end, own

    def read(batches):
        opened, reader = None, None
        for path, begin, end, own in ranges(batches):
            if path != opened:
                opened, reader = path, RangeReader(path)
            raw, out = reader.read(begin, end - begin), []
            for at, n in own:
                head, http, payload = parse(raw[at : at + n])
                digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                if head["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{path}: the payload at {begin + at} is damaged")
                url, refers = head.get("WARC-Target-URI"), head.get("WARC-Refers-To")
                out.append((_page(head["WARC-Record-ID"]), unquote(url) if "X-Target-Escaped" in head else url, head["WARC-Type"], int(http["Content-Length"]), digest, None if refers is None else _page(refers), payload))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    placed = index.repartitionByRange(partitions(index.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return placed.select("path", "offset", "length").mapInArrow(lean(read), ddl)


def warc_round_trip(pages: DataFrame) -> DataFrame:
    return read_warc(write_warc(pages, new_path(pages.sparkSession, "warc")))
