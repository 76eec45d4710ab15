"""WARC archives under Zstandard: writer with revisit records, and a reader that validates.

An archive is a byte string: a leading skippable frame (magic 0x184D2A5D) that holds the archive's dictionary, then one
Zstandard frame per record.  The reader loads the dictionary from the first frame (decompressing it if it is compressed itself),
decodes frame by frame, and checks version line, mandatory fields, Content-Length, the closing CRLFs, block and payload
digests and the HTTP length.  A damaged record is reported in `error`; it doesn't hide the records that follow it.

Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others revisit it.

Defined cases: null html is the empty payload; rows that share the largest page_id and the payload are all responses; a null page_id
never is the largest, unless the group has no other (then all its rows are responses); null urls are empty; an empty table gives no archive
and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY = b"\x37\xa4\x30\xec"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Uncompressed bytes after which an archive is closed; the dictionary's size, and the bytes of records it is trained on.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING_BYTES = 4 << 20, 16 << 10, 512 << 10
LEVEL = 3
STEP = 1 << 15
#: Bytes of a dictionary at most; its frame is decompressed by so many compressed bytes at a time that no step makes over some 8 MB.
DICTIONARY_LIMIT, SMALL_STEP = 64 << 20, 256
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
HTTP_LENGTH = re.compile(rb"^Content-Length: *([0-9]+)\r$", re.M | re.I)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; with refers_to a revisit, which keeps the HTTP header only."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}",
        "WARC-Block-Digest": f"sha1:{base32_sha1(block)}",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], dictionary_bytes: int = DICTIONARY_BYTES) -> bytes:
    """Leading dictionary frame (none if there is too little to train on), then a frame per record."""
    samples, held = [], 0
    for r in records:
        if held >= TRAINING_BYTES:
            break
        samples.append(r[: TRAINING_BYTES // 8])
        held += len(samples[-1])
    dictionary = None
    if len(samples) >= 16 and held >= 8 * dictionary_bytes:
        try:
            dictionary = zstandard.train_dictionary(dictionary_bytes, samples)
        except zstandard.ZstdError:  # the samples have nothing in common
            dictionary = None
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    lead = b""
    if dictionary is not None:
        body = zstandard.ZstdCompressor(level=9).compress(dictionary.as_bytes())
        lead = struct.pack("<II", SKIPPABLE, len(body)) + body
    return lead + b"".join(pack.compress(r) for r in records)


def unpacked(body: bytes, most: int) -> bytes:
    """The content of one frame, with or without its size in the header; a frame of more than `most` bytes is refused before it fills the memory."""
    reader, out, held = zstandard.ZstdDecompressor().decompressobj(), [], 0
    view = memoryview(body)
    for at in range(0, len(body), SMALL_STEP):
        out.append(reader.decompress(view[at : at + SMALL_STEP]))
        held += len(out[-1])
        if held > most:
            raise ValueError(f"the dictionary is larger than {most} bytes")
        if reader.eof:
            return b"".join(out)
    raise ValueError("the dictionary frame is cut off")


def load_dictionary(data: bytes, most: int = DICTIONARY_LIMIT) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, and where the records begin.  It may be compressed at once or as a stream."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        return None, 0
    size = struct.unpack_from("<I", data, 4)[0]
    body = data[8 : 8 + size]
    if len(body) != size:
        raise ValueError("the dictionary frame is cut off")
    if body[:4] == FRAME:
        body = unpacked(body, most)
    if body[:4] != DICTIONARY:
        raise ValueError("the leading frame holds no dictionary")
    return zstandard.ZstdCompressionDict(body), 8 + size


def frames(data: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(offset, content) of every frame; content is None for one that can't be decoded."""
    dictionary, at = load_dictionary(data)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    view = memoryview(data)
    while at < len(data):
        begin, out, one = at, [], reader.decompressobj()
        try:
            while at < len(data) and not one.eof:
                out.append(one.decompress(view[at : at + STEP]))
                at = min(at + STEP, len(data))
            if not one.eof:
                raise zstandard.ZstdError("cut off")
            at -= len(one.unused_data)
            yield begin, b"".join(out)
        except zstandard.ZstdError:
            yield begin, None
            at = data.find(FRAME, begin + 4)  # go on at the next frame
            if at < 0:
                return


def parse(content: bytes | None) -> dict:
    """Fields of a decoded record; `error` says what is wrong, None if nothing."""
    if content is None:
        return {"error": "frame can't be decoded"}
    head, found, rest = content.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return {"error": "no WARC version or no end of header"}
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or name.lower() in fields:
            return {"error": f"bad header line: {line[:80]}"}
        fields[name.lower()] = value.strip()
    if missing := [m for m in MANDATORY if m.lower() not in fields]:
        return {"error": f"missing {', '.join(missing)}"}
    size = fields["content-length"]
    if not size.isdigit() or len(rest) != int(size) + 4 or rest[-4:] != b"\r\n\r\n":
        return {"error": "Content-Length differs from the block"}
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        return {"error": "block digest differs"}
    http, _, payload = block.partition(b"\r\n\r\n")
    length = HTTP_LENGTH.search(http + b"\r\n")
    kind = fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (length is None or int(length[1]) != len(payload) or digest != base32_sha1(payload)):
        return {"error": "payload length or digest differs"}
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?[0-9]+)>", fields.get(name, ""))) else None
    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": page("warc-refers-to"), "payload_digest": digest,
        "payload_bytes": int(length[1]) if length else len(payload), "payload": payload if kind == "response" else None, "error": None,
    }


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to) of every row of pages(page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.unhex(F.sha1("payload")), "size": F.octet_length("payload")})
    # Counted map-side first, so a payload that a third of all pages share is a few rows; only shared payloads are joined.
    # Size is a join key, too: thus Spark deals both sides anew and can split a hot digest (adaptive skew join).
    groups = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.max("size").alias("size"), F.count("*").alias("n"))
    shared = groups.where("n > 1").select("digest", "size", "first")
    joined = rows.join(shared, ["digest", "size"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(content binary), an archive each, from with_revisits' rows; as many at a time as fill archive_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(i) for i in range(4)), strict=True):
                held.append(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["content"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["content"])

    return rows.mapInArrow(run, "content binary")


RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()),
     ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("error", pa.string())]
)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives(content binary), also those of spark.read.format('binaryFile'): columns of RECORD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                data = content.as_py()
                if not data:
                    continue
                try:
                    found = [parse(x) for _, x in frames(data)]
                except (ValueError, zstandard.ZstdError) as e:
                    found = [{"error": str(e)}]
                if not with_payload:
                    found = [r | {"payload": None} for r in found]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in RECORD.names} for r in found], RECORD)

    return archives.select("content").mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary, error string")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: one row per page, read back from the archives."""
    archives = Scratch(spark, "warc").written(write_archives(with_revisits(table(spark, sf_dir, "pages"))), "archives")
    records = read_archives(archives, with_payload=False)
    checked = records.withColumn("page_id", F.when(F.col("error").isNull(), F.col("page_id")).otherwise(F.raise_error(F.col("error")).cast("long")))
    return checked.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h),
r AS (SELECT page_id, strlen(h) AS payload_bytes, top, top IS NULL OR page_id IS NOT DISTINCT FROM top AS response,
  array_to_string(list_transform(string_split(sha1(h), ''), lambda x: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][instr('0123456789abcdef', x)]), '') AS bits FROM p JOIN g USING (h))
SELECT page_id, payload_bytes, CASE WHEN response THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN NOT response THEN top END AS refers_to,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, i * 5 + 1, 1)::INT + 8 * substr(bits, i * 5 + 2, 1)::INT + 4 * substr(bits, i * 5 + 3, 1)::INT + 2 * substr(bits, i * 5 + 4, 1)::INT + substr(bits, i * 5 + 5, 1)::INT, 1)), '') AS payload_digest FROM r
"""
