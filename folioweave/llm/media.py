"""Media columns: content-defined chunks of payloads, stored once, and media rebuilt from ordered chunk lists.

A payload becomes a medium: a binary greymap (PGM) of 64 samples a row, 8 bits each.  A gear hash rolls over its bytes; where the
hash's top bits are zero the medium is cut, no chunk being shorter than LEAST or longer than MOST bytes.  Chunks go by their SHA-256;
equal ones are stored once (Zstandard-coded, with a dictionary
trained on a bounded sample, as chunks are small).  A recipe lists a medium's chunks in order.

Chunks lie in containers, one for each medium.  Digests alone are joined to find the chunks that have several places: the first of
these keeps the chunk and lends it, the others are left empty.  So the bodies of all chunks cross one exchange, by their medium, and
only lent ones travel again.  Rebuilding fills the empty places from what other containers lend, puts each medium together in order,
and verifies its length and SHA-256; then come the features.

The gear hash of a place depends on the 32 bytes up to it, so it is computed for all places at once, by doubling.

Every medium goes this way, whatever its length: LEAST lies well below the usual document, so that short ones share passages, too.

Defined cases: null text is the empty payload, 64 zero bytes; equal texts have one medium, whatever their number; repeated rows are
answered row by row; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, hashed_sample, table

ROW = 64
LEAST, MOST = 256, 65_536
#: A cut where this many top bits of the gear hash are zero: 1 KB in the mean, after LEAST.
CUT_BITS = 10
LEVEL = 6
#: The dictionary's size, the documents it is trained on, and the characters taken of each.
DICTIONARY_BYTES, SAMPLE, SAMPLE_BYTES = 64 << 10, 1_000, 4_096
SPAN = 32


def gear_table() -> np.ndarray:
    """256 fixed random words, by rule: the first four bytes of each byte's SHA-256."""
    return np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "big") for b in range(256)], dtype=np.uint32)


def cuts(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of data."""
    n = len(data)
    if n <= LEAST:
        return [n]
    h = gear[np.frombuffer(data, dtype=np.uint8)]
    shift = 1
    while shift < SPAN:  # h[i] covers 2 * shift bytes from now on
        h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        shift *= 2
    places = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, at = [], 0
    while n - at > LEAST:
        i = int(np.searchsorted(places, at + LEAST))
        end = int(min(places[i] if i < len(places) else n, at + MOST, n))
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def medium(text: str | None) -> tuple[bytes, int]:
    """The greymap of a text, and the text's bytes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(raw) // ROW))
    return b"P5\n%d %d\n255\n" % (ROW, rows) + raw.ljust(rows * ROW, b"\0"), len(raw)


def samples(data: bytes) -> bytes:
    """The samples of a greymap; checks its header and length."""
    kind, size, depth, body = data.split(b"\n", 3)
    width, height = map(int, size.split())
    if kind != b"P5" or depth != b"255" or width != ROW or len(body) != width * height:
        raise ValueError("not a greymap of 64 samples a row")
    return body


def feature(body: bytes, chunks: int) -> str:
    """rows:mean (thousandths):least:greatest:distinct:mean step between neighbours (thousandths):chunks"""
    x = np.frombuffer(body, dtype=np.uint8).astype(np.int64)
    step = int(np.abs(np.diff(x)).sum())
    return f"{len(x) // ROW}:{1000 * int(x.sum()) // len(x)}:{x.min()}:{x.max()}:{len(np.unique(x))}:{1000 * step // (len(x) - 1)}:{chunks}"


FEATURES = pa.schema([("media_id", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
FEATURES_SQL = "media_id binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media_id: bytes, data: bytes, chunks: int) -> dict:
    digest = hashlib.sha256(data)
    if digest.digest() != media_id:
        raise ValueError(f"medium {media_id.hex()} was rebuilt wrongly")
    body = samples(data)
    return {
        "media_id": media_id, "payload_bytes": len(body), "payload_sha256": hashlib.sha256(body).hexdigest(), "tail_crc32": zlib.crc32(body[-64:]), "media_bytes": len(data),
        "media_sha256": digest.hexdigest(), "feature": feature(body, chunks),
    }


def recipes(docs: DataFrame) -> DataFrame:
    """(doc_id, media_id, n_bytes, chunks array<binary>) of every row of docs(doc_id, text): no payload."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        for b in batches:
            media, sizes, lists = [], [], []
            for text in b.column(1).to_pylist():
                data, n = medium(text)
                ends = cuts(data, gear)
                media.append(hashlib.sha256(data).digest())
                sizes.append(n)
                lists.append([hashlib.sha256(data[x:y]).digest() for x, y in zip([0, *ends[:-1]], ends, strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(media, pa.binary()), pa.array(sizes, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], names=["doc_id", "media_id", "n_bytes", "chunks"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, media_id binary, n_bytes long, chunks array<binary>")


def loaded(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def train_dictionary(texts: DataFrame) -> bytes:
    """A compression dictionary for small chunks, from the chunks of at most SAMPLE documents (SAMPLE_BYTES of each); empty if they are too few.

    It changes how chunks are stored, never what they hold.
    """
    sample = hashed_sample(texts.select("doc_id", "text"), ["doc_id", "text"], SAMPLE, 3).select(F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    gear = gear_table()
    parts = [data[x:y] for r in sample.collect() for data, _ in [medium(r.text)] for ends in [cuts(data, gear)] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    if len(parts) < 64:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:  # the chunks have nothing in common
        return b""


def places(lists: DataFrame) -> DataFrame:
    """(media_id, place, chunk_id) of lists(media_id, chunks)."""
    return lists.select("media_id", F.posexplode("chunks").alias("place", "chunk_id"))


def first_places(lists: DataFrame) -> DataFrame:
    """(chunk_id, media_id, place, n): where each chunk comes first, by media_id and place, and at how many places it is."""
    found = places(lists).groupBy("chunk_id").agg(F.min(F.struct("media_id", "place")).alias("first"), F.count("*").alias("n"))
    return found.select("chunk_id", "first.media_id", "first.place", "n")


def links(lists: DataFrame) -> DataFrame:
    """(media_id, place, chunk_id, lends) of the places of every chunk that has several: the first lends it to the others."""
    shared = first_places(lists).where("n > 1").select("chunk_id", F.struct("media_id", "place").alias("first"))
    return places(lists).join(shared, "chunk_id").select("media_id", "place", "chunk_id", (F.struct("media_id", "place") == F.col("first")).alias("lends"))


PACKED = T.StructType([T.StructField("media_id", T.BinaryType(), False), T.StructField("bodies", T.ArrayType(T.BinaryType()), False)])


def packed(texts: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """(media_id, bodies) of every distinct medium of texts(text): its chunks in order, Zstandard-coded each.  Equal media meet map-side first.

    media_id is never null, so that no join puts a filter before the exchange: all that reads these rows then shares that exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear, pack = gear_table(), zstandard.ZstdCompressor(level=LEVEL, dict_data=loaded(dictionary), write_checksum=False, write_dict_id=False)
        out = lambda ids, bodies: pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(bodies, pa.list_(pa.binary()))], names=["media_id", "bodies"])
        for b in batches:
            seen: set[bytes] = set()
            ids, bodies, held = [], [], 0
            for text in b.column(0):
                data, _ = medium(text.as_py())
                key = hashlib.sha256(data).digest()
                if key in seen:
                    continue
                seen.add(key)
                ends = cuts(data, gear)
                ids.append(key)
                bodies.append([pack.compress(data[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True)])
                held += sum(map(len, bodies[-1]))
                if held > 8 << 20:
                    yield out(ids, bodies)
                    ids, bodies, held = [], [], 0
            if ids:
                yield out(ids, bodies)

    return texts.select("text").mapInArrow(run, PACKED).groupBy("media_id").agg(F.first("bodies").alias("bodies"))


def containers(media: DataFrame, linked: DataFrame) -> DataFrame:
    """The chunk store, (media_id, bodies): a container for each of media(media_id, bodies), null at the places that borrow, so that every chunk is stored once."""
    borrowed = linked.where("not lends").groupBy("media_id").agg(F.sort_array(F.collect_list("place")).alias("borrowed"))
    gap = lambda p, before: F.concat(F.array_repeat(F.lit(False), p - before - 1), F.array(F.lit(True)))
    before = F.slice(F.concat(F.array(F.lit(-1)), F.col("borrowed")), F.lit(1), F.size("borrowed"))
    marks = borrowed.select("media_id", F.flatten(F.zip_with("borrowed", before, gap)).alias("lacks"))
    kept = F.transform("bodies", lambda body, i: F.when(~F.coalesce(F.get("lacks", i), F.lit(False)), body))
    return media.join(marks, "media_id", "left").select("media_id", F.when(F.col("lacks").isNull(), F.col("bodies")).otherwise(kept).alias("bodies"))


def taken(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """(chunk_id, body) at the wanted(media_id, place, chunk_id) of the store's containers."""
    each = wanted.groupBy("media_id").agg(F.collect_list(F.struct("place", "chunk_id")).alias("wanted"))
    return store.join(each, "media_id").select(F.inline(F.transform("wanted", lambda w: F.struct(w.chunk_id.alias("chunk_id"), F.get("bodies", w.place).alias("body")))))


def chunk_store(texts: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """(chunk_id, body) of every distinct chunk of texts(doc_id, text), out of the containers; body is Zstandard-coded."""
    lists = media_lists(recipes(texts))
    return taken(containers(packed(texts, dictionary), links(lists)), first_places(lists).select("media_id", "place", "chunk_id"))


def media_lists(made: DataFrame) -> DataFrame:
    """(media_id, chunks) of every distinct medium of made, as recipes() gives it."""
    return made.groupBy("media_id").agg(F.first("chunks").alias("chunks"))


def rebuild(store: DataFrame, linked: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """Features of the media of the store, each put together from its container and the chunks that others lend it, one at a time."""
    lent = linked.where("not lends").select("media_id", "place", "chunk_id").join(taken(store, linked.where("lends")), "chunk_id")
    parts = lent.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("lent"))
    whole = store.join(parts, "media_id", "left").select("media_id", "bodies", F.col("lent.place").alias("places"), F.col("lent.body").alias("lent"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=loaded(dictionary))
        for b in batches:
            done = []
            for media_id, bodies, at, lent in zip(*(b.column(i) for i in range(4)), strict=True):
                own, rest = bodies.as_py(), dict(zip(at.as_py() or [], lent.as_py() or [], strict=True))
                chunks = [rest.get(i) if body is None else body for i, body in enumerate(own)]
                if None in chunks:
                    raise ValueError(f"medium {media_id.as_py().hex()} lacks a chunk")
                done.append(described(media_id.as_py(), b"".join(map(unpack.decompress, chunks)), len(chunks)))
            yield pa.RecordBatch.from_pylist(done, FEATURES)

    return whole.mapInArrow(run, FEATURES_SQL)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: one row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scratch = Scratch(spark, "media")
    made = scratch.written(recipes(docs), "recipes")
    linked = scratch.written(links(media_lists(made)), "links")
    words = train_dictionary(docs)
    rows = made.select("doc_id", "media_id", "n_bytes").join(rebuild(containers(packed(docs, words), linked), linked, words), "media_id")
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
