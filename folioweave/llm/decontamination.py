"""Benchmark decontamination: which documents hold passages of test items, by Wu-Manber search over words.

Texts are lower-cased (A-Z) and cut into words.  A test string is a window of ten consecutive words of an item; an item of fewer words, but not none, is one
window.  For the windows of one length m, a table gives for every block of two words how far the search may move on: m less the last place (in any window) at
which the block ends, and m - 1 for all other blocks, so most places of a document are never looked at.  Where the block ends a window, the bucket of that block
holds the windows that end so, and the document's last m words are compared with them.  Windows of fewer than ten words are searched length by length, those of
one word with blocks of one.

Windows are spread over blocks of at most about BLOCK_WINDOWS windows, of words of at most LONG bytes (longer words stand as their SHA-256), so a block has a
proven size; each is sent to the tasks once.  One block is held by a task at a time: with more blocks, a task takes some texts at a time through all of them.

Windows that stand in the same items form a class, named by the number of its items and two exclusive-or sums of their hashes (no list of items is gathered).
A search returns a document's classes; equal lists of classes are looked up once, however many documents share them, and only these become lists of items.

Defined cases: a null text has no words; items without an id mark words but aren't counted or listed; equal ids of several rows are one item with all their
windows; repeated document rows stay, each with its result; empty tables give no rows, an empty benchmark no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

WINDOW = 10
BLOCK_WORDS = 2
#: Windows of a block, about; bytes of a word at most; bytes of text that a task takes through all blocks at a time.
BLOCK_WINDOWS, LONG, TEXT_BYTES = 200_000, 64, 32 << 20
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: Bytes that part words become blanks, capitals small letters; the rest, other alphabets too, stays.
TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def named(word: bytes) -> bytes:
    """A word of at most LONG bytes; capitals never stand in other words, so a long word's name meets no other word."""
    return word if len(word) <= LONG else b"W" + hashlib.sha256(word).digest()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some PIECE bytes at a time."""
    text = text.translate(TO_WORDS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        words = text[at:end].split()
        yield words if max(map(len, words), default=0) <= LONG else list(map(named, words))
        at = end


class Matcher:
    """Wu-Manber tables of windows of one length."""

    def __init__(self, windows: Iterable[tuple[tuple[bytes, ...], bytes]], m: int) -> None:
        self.m, self.block = m, min(BLOCK_WORDS, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(dict)
        for window, name in windows:
            for end in range(self.block, m + 1):
                key = self.key(window, end)
                self.shift[key] = min(m - end, self.shift.get(key, self.far))
            self.buckets[self.key(window, m)][window] = name

    def key(self, words: tuple[bytes, ...] | list[bytes], end: int) -> bytes | tuple[bytes, bytes]:
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def found(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        """(end, class) of every window that occurs."""
        m, far, shift, end, n = self.m, self.far, self.shift.get, self.m, len(words)
        single = self.block == 1
        while end <= n:
            key = words[end - 1] if single else (words[end - 2], words[end - 1])
            step = shift(key, far)
            if step:
                end += step
                continue
            name = self.buckets[key].get(tuple(words[end - m : end]))
            if name is not None:
                yield end, name
            end += 1


def matchers(windows: list[tuple[bytes, bytes]]) -> list[Matcher]:
    """Of (window, class), words joined by blanks."""
    by_length = defaultdict(list)
    for window, name in windows:
        words = tuple(window.split(b" "))
        by_length[len(words)].append((words, name))
    return [Matcher(w, m) for m, w in sorted(by_length.items(), reverse=True)]


class Hits:
    """What a document holds: its number of words, which of them are hit, and the classes of the windows found."""

    def __init__(self) -> None:
        self.marks, self.classes, self.n_words = bytearray(), set(), 0

    def search(self, text: bytes, tables: list[Matcher]) -> None:
        tail: list[bytes] = []
        at = 0  # number of the first word looked at
        for words in pieces(text):
            words = tail + words
            if len(self.marks) < at + len(words):
                self.marks.extend(bytes(at + len(words) - len(self.marks)))
            for t in tables:
                done = 0
                for end, name in t.found(words):
                    self.classes.add(name)
                    first = max(done, end - t.m)
                    self.marks[at + first : at + end] = b"\x01" * (end - first)
                    done = end
            tail = words[-(WINDOW - 1) :]
            at += len(words) - len(tail)
        self.n_words = at + len(tail)


def windows_of(benchmark: DataFrame) -> DataFrame:
    """(item_id string, window binary) of benchmark(item_id, text), a row for each place of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(item: str | None, windows: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([item] * len(windows), pa.string()), pa.array(windows, pa.binary())], names=["item_id", "window"])

        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tail: list[bytes] = []
                whole = False
                for words in pieces((text.as_py() or "").encode()):
                    words = tail + words
                    if len(words) >= WINDOW:
                        whole = True
                        for k in range(0, len(words) - WINDOW + 1, 10_000):
                            yield rows(item, [b" ".join(words[i : i + WINDOW]) for i in range(k, min(k + 10_000, len(words) - WINDOW + 1))])
                    tail = words[-(WINDOW - 1) :]
                if tail and not whole:
                    yield rows(item, [b" ".join(tail)])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(run, "item_id string, window binary")


def blocks_of(patterns: DataFrame, n: int, size: int) -> list[Broadcast]:
    """The patterns(window, class) in blocks of about `size`, each collected and sent to the tasks by itself."""
    context = patterns.sparkSession.sparkContext
    count = -(-n // size)
    part = F.pmod(F.xxhash64("window"), F.lit(count))
    return [context.broadcast([(bytes(r.window), bytes(r["class"])) for r in patterns.where(part == k).select("window", "class").collect()]) for k in range(count)]


def searched(docs: DataFrame, blocks: list[Broadcast], text_bytes: int = TEXT_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, classes) of every row of docs(doc_id, text)."""
    source = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [matchers(blocks[0].value)] if len(blocks) == 1 else None

        def flush(ids: list[pa.Array], texts: list[bytes | None]) -> pa.RecordBatch:
            found = [Hits() for _ in texts]
            for k in range(max(1, len(blocks))):
                tables = kept[0] if kept else matchers(blocks[k].value) if blocks else []
                for hits, text in zip(found, texts, strict=True):
                    hits.search(text or b"", tables)
            columns = [pa.array([h.n_words for h in found]), pa.array([h.marks.count(1) for h in found]), pa.array([sorted(h.classes) for h in found], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *columns], names=["doc_id", "n_words", "n_hit", "classes"])

        ids, texts, size = [], [], 0
        for b in batches:
            ids.append(b.column(0))
            texts += b.column(1).cast(pa.binary()).to_pylist()
            size += b.column(1).nbytes
            if len(blocks) < 2 or size >= text_bytes:
                yield flush(ids, texts)
                ids, texts, size = [], [], 0
        if texts:
            yield flush(ids, texts)

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, classes array<binary>")


def contaminated(documents: DataFrame, benchmark: DataFrame, scratch: Scratch, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of documents(doc_id, text)."""
    pairs = scratch.written(windows_of(benchmark).distinct(), "pairs")
    item = F.col("item_id")
    members = (F.count(item), F.bit_xor(F.xxhash64(item, F.lit(1))), F.bit_xor(F.xxhash64(item, F.lit(2))))
    of_window = pairs.groupBy("window").agg(F.concat_ws(":", *(F.when(F.count(item) > 0, m).otherwise(0).cast("string") for m in members)).alias("members"))
    patterns = scratch.written(of_window.select("window", F.unhex(F.md5("members")).alias("class")), "patterns")
    blocks = blocks_of(patterns, patterns.count(), block_windows)
    found = scratch.written(searched(documents, blocks), "found")
    for b in blocks:
        b.destroy()
    # A hit list of classes stands for all documents that hold it; one window of a class tells the items of all.
    signed = found.withColumn("signature", F.sha2(F.array_join(F.transform("classes", F.hex), ","), 256))
    lists = signed.where("size(classes) > 0").groupBy("signature").agg(F.first("classes").alias("classes"))
    example = patterns.groupBy("class").agg(F.min("window").alias("window"))
    items = pairs.where(item.isNotNull()).join(example, "window").select("class", "item_id")
    listed = lists.select("signature", F.explode("classes").alias("class")).join(items, "class").groupBy("signature").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    known = scratch.written(listed.select("signature", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "known")
    none = (F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"))
    columns = ("doc_id", "n_words", "n_hit")
    clean = signed.where("size(classes) = 0").select(*columns, *none)
    hit = signed.where("size(classes) > 0").join(known, "signature", "left").select(*columns, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"))
    return clean.unionByName(hit).withColumn("contaminated", F.col("n_hit") > 0)


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: one row per document."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), Scratch(spark, "decontamination"))


SMALL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = f"regexp_extract_all({SMALL}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH items AS (SELECT row_number() OVER () AS r, item_id::VARCHAR AS item_id, {WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS win FROM items, unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS u(i) WHERE len(w) > 0),
docs AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM docs),
ten AS (SELECT rid, i, [word, {', '.join(f'lead(word, {k}) OVER p' for k in range(1, WINDOW))}] AS t FROM words WINDOW p AS (PARTITION BY rid ORDER BY i)),
places AS (SELECT rid, i, m, array_to_string(t[1:m], ' ') AS win FROM ten, (SELECT DISTINCT m FROM windows) WHERE t[m] IS NOT NULL),
met AS (SELECT rid, i, m, item_id FROM places JOIN windows USING (m, win)),
hit AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT rid, i, m FROM met), unnest(range(i, i + m)) AS u(j) GROUP BY rid),
held AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT rid, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM docs LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)
"""
