"""WARC archives in Zstandard: a writer and a validating reader.

An archive starts with a skippable frame that holds the compression dictionary,
then has one frame for each record. They are written and read through Spark's
own file sources, so any file system that Spark reaches will do: each frame is
one row of a text table whose line end is the one-byte body of an empty
skippable frame, which Zstandard readers pass over.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir, table

# Fixed values of the formats.
DICT_MAGIC = 0x184D2A5D
SPACER = struct.pack("<II", 0x184D2A5C, 1)  # its body is the writer's line end
#: Bytes of payloads that an archive should hold at most: it is read as one value.
ARCHIVE = 256 << 20
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class BadArchive(ValueError):
    pass


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value without line ends."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in str(value))


def record_bytes(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record; a revisit (``refers_to`` set) has the HTTP head only, whose
    Content-Length still tells the size of the full payload."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{payload_digest(payload)}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def train_dictionary(pages: DataFrame, rows: int = 256, chars: int = 16_384, size: int = 16_384) -> bytes:
    """A dictionary from at most ``rows`` pages, of each at most ``chars``
    characters (it only serves compression). Empty if there is too little."""
    got = pages.where("length(html) > 0").select(F.substring("html", 1, chars).alias("h")).limit(rows).collect()
    samples = [r["h"].encode() for r in got]
    if len(samples) < 16 or sum(map(len, samples)) < 8 * size:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(records: DataFrame, path: str, dictionary: bytes = b"", archive: int = ARCHIVE) -> None:
    """``records(page_id, url, html, refers_to)`` as archives in ``path``; every row
    becomes a record (null html: empty payload). There are as many archives as
    tasks; where those would hold more than about ``archive`` bytes of payloads
    each, the rows are dealt out to more."""

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=3, dict_data=given, write_checksum=True, write_content_size=True)
        yield pd.DataFrame({"value": [struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary + SPACER]})
        none = lambda x: None if pd.isna(x) else int(x)
        for p in parts:
            yield pd.DataFrame({"value": [
                pack.compress(record_bytes(none(i), u, (h or "").encode(), none(r))) + SPACER
                for i, u, h, r in zip(p["page_id"], p["url"], p["html"], p["refers_to"], strict=True)
            ]})

    # Strings keep 64-bit ids exact where a batch holds nulls.
    rows = records.select(F.col("page_id").cast("string"), "url", "html", F.col("refers_to").cast("string"))
    total = records.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    if total > archive * partitions(records.sparkSession):
        rows = rows.repartition(-(-2 * total // archive), F.xxhash64("page_id", "url"))
    # a file cut by rows would lack its dictionary
    rows.mapInPandas(frames, "value binary").select(F.col("value").cast("string")).write.option("compression", "none").option("maxRecordsPerFile", 0).text(path)


def frame_end(data, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends."""
    try:
        info = zstandard.get_frame_parameters(data[at : at + 18])
        pos = at + zstandard.frame_header_size(data[at : at + 18])
        while True:
            if pos + 3 > len(data):
                raise BadArchive(f"a frame at {at} is cut short")
            head = int.from_bytes(data[pos : pos + 3], "little")
            pos += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
            if head & 1:
                break
    except zstandard.ZstdError as e:
        raise BadArchive(f"no frame at {at}: {e}") from e
    pos += 4 * info.has_checksum
    if pos > len(data):
        raise BadArchive(f"a frame at {at} is cut short")
    return pos


def iter_records(data: bytes) -> Iterator[bytes]:
    """The records of one archive, decoded frame by frame."""
    at, unpack, view = 0, zstandard.ZstdDecompressor(), memoryview(data)
    while at < len(data):
        if at + 4 > len(data):
            raise BadArchive(f"{len(data) - at} stray bytes at the end")
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic >> 4 == 0x184D2A5:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            body = bytes(view[at + 8 : at + 8 + size])
            if at + 8 > len(data) or len(body) != size:
                raise BadArchive("a skippable frame is cut short")
            if at == 0 and magic == DICT_MAGIC and body:
                if body[:4] == ZSTD_MAGIC:
                    body = zstandard.ZstdDecompressor().decompress(body)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        end = frame_end(view, at)
        try:
            yield unpack.decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise BadArchive(f"the frame at {at} can't be decoded: {e}") from e
        at = end


def _fields(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for x in lines:
        name, colon, value = x.decode("utf-8").partition(":")
        if not colon:
            raise BadArchive(f"no header line: {x[:60]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse_record(raw: bytes) -> dict:
    """One record's fields after checks of its headers, lengths and digest."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not lines[0].startswith(b"WARC/1."):
        raise BadArchive("no WARC header")
    h = _fields(lines[1:])
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        raise BadArchive(f"headers missing: {missing}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive("Content-Length doesn't match the record")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise BadArchive("no HTTP head")
    inner = _fields(http.split(b"\r\n")[1:])
    digest, n = h.get("warc-payload-digest", "").removeprefix("sha1:"), inner.get("content-length", "")
    if not n.isdigit():
        raise BadArchive("no payload length")
    kind, refers = h["warc-type"], h.get("warc-refers-to")
    if kind == "response":
        if len(payload) != int(n) or payload_digest(payload) != digest:
            raise BadArchive("length or digest doesn't match the payload")
    elif kind != "revisit" or payload or not refers or h.get("warc-profile") != PROFILE:
        raise BadArchive(f"no valid {kind} record")
    number = lambda v: None if v is None or v == "<urn:page:none>" else v.removeprefix("<urn:page:").removesuffix(">")
    return {
        "page_id": number(h["warc-record-id"]), "url": h.get("warc-target-uri"), "payload": payload if kind == "response" else None,
        "payload_bytes": int(n), "payload_digest": digest, "record_type": kind, "refers_to": number(refers),
    }


READ_SCHEMA = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives in ``path``; BadArchive ends the job where
    a frame, header, length or digest is wrong. ``payloads=False`` leaves the
    payloads out once they have been checked."""

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
        for p in parts:
            for content in p["content"]:
                rows, held = [], 0
                for raw in iter_records(content):
                    r = parse_record(raw)
                    held += len(raw)
                    rows.append(r if payloads else r | {"payload": None})
                    if held > 16 << 20:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").load(path).select("content")
    out = files.mapInPandas(decode, READ_SCHEMA)
    return out.withColumn("page_id", F.col("page_id").cast("long")).withColumn("refers_to", F.col("refers_to").cast("long"))


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages(page_id, url, html)`` with ``refers_to``: of rows with equal
    payloads of at least ``least_bytes`` the largest page_id stays a response.

    Payloads are equal if SHA-1 and length are; null html is an empty payload.
    Rows that share the largest page_id are all responses; a null page_id is
    less than any other; a group of null ids only is all responses.
    """
    # Only the columns named are used, so others' names can't clash.
    p = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("_sha"), F.octet_length(F.coalesce("html", F.lit(""))).alias("_n"))
    last = p.where(F.col("_n") >= least_bytes).groupBy("_sha", "_n").agg(F.max("page_id").alias("_last"), F.count("*").alias("_c")).where("_c > 1").drop("_c")
    other = (F.col("page_id").isNull() | (F.col("page_id") < F.col("_last"))) & F.col("_last").isNotNull()
    return p.join(last, ["_sha", "_n"], "left").select("page_id", "url", "html", F.when(other, F.col("_last")).alias("refers_to"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back of the archives of all pages. They stay in the shared
    folder, since the rows are read from them when the result is computed."""
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(mark_revisits(pages), path, train_dictionary(pages))
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
