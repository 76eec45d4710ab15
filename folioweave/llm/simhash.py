"""SimHash near-duplicates by anchor points of a covering code, and connected components of the links.

A fingerprint has 64 bits, cut into three parts of 22, 21 and 21 bits.  If two fingerprints differ in at most 4 bits, then the
first part differs in at most 1, or the second in at most 1, or the third in none (2 + 2 + 1 would be 5).  So each part is
joined by itself with its threshold t = 1, 1, 0.  The anchors of a part are the words whose first 15 bits form a codeword of the
(15, 11) Hamming code, which is perfect: each word has exactly one codeword within radius 1, its home anchor.  A
fingerprint goes to every anchor within the covering radius plus t of its part; wherever two are within t, the home
anchor of one receives the other.  Each anchor compares those at home with all it received, by the full distance.

Anchors of many rows are cut into blocks of homes times blocks of members, each pair of blocks a task of its own.  An anchor
emits for each linked fingerprint one edge to the least of its component there, so the output is linear in what it received.

Defined cases: null text counts as empty; texts without words have fingerprint zero and are linked like others; a null doc_id is
never the least one (component_id is null only if no id in the component is known); repeated rows and ids are answered row by row;
an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SEED = 42
SHINGLE = 4
THRESHOLD = 4
#: (lowest bit, bits, threshold) of each part; sum of (threshold + 1) = THRESHOLD + 1.
PARTS = ((0, 22, 1), (22, 21, 1), (43, 21, 0))
HAMMING = 15
#: Rows of an anchor in one task.
BLOCK = 20_000
#: Hashes whose bits are counted at once.
PIECE = 65_536


def shingle_hashes(text: str | None) -> list[int]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return [digest(line, SEED)]
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends)]
    return [digest(line[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]


def bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """The fingerprint of each text, as int64."""
    out = np.zeros(len(texts), dtype=np.int64)
    waiting: list[tuple[int, list[int]]] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not waiting:
            return
        sizes = np.array([len(h) for _, h in waiting])
        flat = np.fromiter((x for _, h in waiting for x in h), dtype=np.uint64, count=int(sizes.sum()))
        set_bits = 2 * bit_counts(flat, np.concatenate(([0], np.cumsum(sizes)[:-1]))) > sizes[:, None]
        out[[i for i, _ in waiting]] = np.packbits(set_bits, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
        waiting.clear()
        held = 0

    for i, text in enumerate(texts):
        hashes = shingle_hashes(text)
        if len(hashes) > PIECE:  # a very long text: its bits are counted piece by piece
            flat = np.array(hashes, dtype=np.uint64)
            counts = sum(bit_counts(flat[a : a + PIECE], np.array([0]))[0] for a in range(0, len(flat), PIECE))
            out[i] = np.packbits(2 * counts > len(flat)).view(">u8").astype(np.uint64).view(np.int64)[0]
        elif hashes:
            waiting.append((i, hashes))
            held += len(hashes)
            if held > PIECE:
                flush()
    flush()
    return out


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row of docs."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1).to_pylist()))], names=["doc_id", "fp"])

    return source.mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Of the first 15 bits; 0 for codewords, else the place (from 1) of the bit whose flip makes one."""
    s = np.zeros(len(words), dtype=np.int64)
    for place in range(1, HAMMING + 1):
        s ^= ((words >> (place - 1)) & 1) * place
    return s


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, is_home) of every anchor each fingerprint goes to, by rule; key holds the part and the anchor."""
    keys, rows, homes = [], [], []
    unsigned = fps.view(np.uint64)

    def emit(part: int, words: np.ndarray, at: np.ndarray, home: bool) -> None:
        keys.append(words | (part << 40))
        rows.append(at)
        homes.append(np.full(len(at), home))

    everyone = np.arange(len(fps))
    for part, (low, bits, t) in enumerate(PARTS):
        words = ((unsigned >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        s = syndromes(words)
        home = np.where(s > 0, words ^ (1 << np.maximum(s - 1, 0)), words)
        emit(part, home, everyone, True)
        emit(part, home, everyone, False)
        if not t:
            continue
        for place in range(HAMMING, bits):  # the difference lies outside the code: the same codeword, one other bit
            emit(part, home ^ (1 << place), everyone, False)
        for i in range(1, HAMMING + 1):  # it lies inside: the other codewords within radius + t, two flips away
            j = s ^ i
            two = (s > 0) & (j > i)
            emit(part, words[two] ^ (1 << (i - 1)) ^ (1 << (j[two] - 1)), everyone[two], False)
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(homes)


def to_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for a in range(0, len(fps), 20_000):
            part = fps[a : a + 20_000]
            keys, rows, homes = anchors(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows]), pa.array(homes)], names=["anchor", "fp", "home"])


def linked(homes: np.ndarray, members: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, least of its component) among homes and members that differ in at most threshold bits."""
    nodes, where = np.unique(np.concatenate((homes, members)), return_inverse=True)
    at_home, at_member = where[: len(homes)], where[len(homes) :]
    label = np.arange(len(nodes))
    theirs = members.view(np.uint64)
    itself = np.isin(homes, members)  # not so in most blocks of an anchor that is cut
    step = max(1, 2_000_000 // max(1, len(members)))
    for a in range(0, len(homes), step):
        near = np.bitwise_count(homes[a : a + step].view(np.uint64)[:, None] ^ theirs[None, :]) <= threshold
        for i in np.flatnonzero(near.sum(axis=1) > itself[a : a + step]):
            met = np.unique(label[np.append(at_member[near[i]], at_home[a + i])])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    joined = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[joined], nodes[label[joined]]


def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor and block; a group may run over several batches."""
    held: list[pd.DataFrame] = []

    def edges(rows: pd.DataFrame) -> pd.DataFrame:
        fp, home = rows["fp"].to_numpy(), rows["home"].to_numpy()
        change = np.flatnonzero(np.diff(rows["anchor"].to_numpy()) | np.diff(rows["i"].to_numpy()) | np.diff(rows["j"].to_numpy())) + 1
        bounds = np.concatenate(([0], change, [len(rows)]))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if home[a:b].any() and not home[a:b].all() and (b - a > 2 or fp[a] != fp[a + 1]):
                x, y = linked(fp[a:b][home[a:b]], fp[a:b][~home[a:b]])
                if len(x):
                    found.append((x, y))
        return pd.DataFrame({k: np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i, k in enumerate(("a", "b"))})

    def same(x: pd.DataFrame, y: pd.DataFrame) -> bool:
        return all(x[c].iloc[-1] == y[c].iloc[0] for c in ("anchor", "i", "j"))

    for b in batches:
        if not len(b):
            continue
        last = (b["anchor"].to_numpy() == b["anchor"].iloc[-1]) & (b["i"].to_numpy() == b["i"].iloc[-1]) & (b["j"].to_numpy() == b["j"].iloc[-1])
        cut = int(np.argmax(last))
        if held and cut == 0 and same(held[-1], b):
            held.append(b)
            continue
        yield edges(pd.concat([*held, b.iloc[:cut]], ignore_index=True)) if held or cut else pd.DataFrame({"a": [], "b": []}, dtype="int64")
        held = [b.iloc[cut:]]
    if held:
        yield edges(pd.concat(held, ignore_index=True))


def fingerprint_links(fps: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints fps(fp) just as all their links do; linear in size."""
    rows = fps.select("fp").mapInArrow(to_anchors, "anchor long, fp long, home boolean")
    heavy = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home")).where(F.col("n") > BLOCK)
    heavy = (scratch or Scratch(fps.sparkSession, "links")).written(heavy, "anchors")
    rows = rows.join(heavy, "anchor", "left")
    blocks = {c: F.greatest(F.lit(1), F.ceil(F.coalesce(F.col(n), F.lit(0)) / BLOCK)).cast("int") for c, n in (("bi", "n_home"), ("bj", "n"))}
    rows = rows.withColumns(blocks).withColumn("x", F.pmod(F.xxhash64("fp"), F.when(F.col("home"), F.col("bi")).otherwise(F.col("bj"))).cast("int"))
    rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("bj")).otherwise(F.col("bi")) - 1)))
    rows = rows.select("anchor", F.when(F.col("home"), F.col("x")).otherwise(F.col("y")).alias("i"), F.when(F.col("home"), F.col("y")).otherwise(F.col("x")).alias("j"), "fp", "home")
    rows = rows.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
    return rows.mapInPandas(compare, "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, root) of every node of edges(a, b): root is the same for two nodes exactly if a path joins them.

    Every round hooks each node to its least neighbour, follows pointers once more, and keeps the edges between different ones.
    At least half of the nodes that still have edges go in a round, so the rounds are logarithmic.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pairs = scratch.written(edges.where("a <> b"), "edges")
    labels = scratch.written(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().select("node", F.col("node").alias("root")), "labels")
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select("b", "a"))
        hooked = scratch.written(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")), "hooks")
        up = hooked.select(F.col("a").alias("to"), F.col("to").alias("top"))
        hooks = scratch.written(hooked.join(up, "to").select("a", "top"), "hooks")
        old, labels = (labels, pairs, hooked, hooks), scratch.written(labels.join(hooks, labels.root == hooks.a, "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        ends = hooks.select(F.col("a").alias("b"), F.col("top").alias("b_top"))
        moved = pairs.join(hooks, "a").join(ends, "b").where("top <> b_top")
        pairs = scratch.written(moved.select(F.least("top", "b_top").alias("a"), F.greatest("top", "b_top").alias("b")).distinct(), "edges")
        scratch.drop(*old)
    scratch.drop(pairs)
    return labels


def near_duplicates(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "near-duplicates")
    written = scratch.written
    rows = written(with_fingerprints(docs), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(fps, scratch), scratch).withColumnRenamed("node", "fp")
    members = written(fps.join(roots, "fp"), "members")
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(least, "root").select("fp", "component_id", F.lit(True).alias("linked"))
    classes = written(fps.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id")), "classes")
    scratch.drop(fps, members)
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: one row per document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate_documents(docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component the document with the least doc_id stays.

    If rows repeat that id, the least of them by all columns in their order stays (null first).  Rows without a doc_id can't be named by a component; they all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text"))
    stay = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.where(F.col("doc_id").isNotNull()).join(stay, "doc_id", "left_semi")
    named = named.groupBy("doc_id").agg(F.min(F.struct("*")).alias("row")).select([F.col(f"row.`{c}`") for c in docs.columns])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
