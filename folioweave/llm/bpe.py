"""BPE encoding and decoding by tree concatenation.

Texts of at most LEAF characters are encoded as they are.  Longer ones are cut into leaves, wherever that falls, which are rows of
their own and are encoded in parallel all over the cluster (those of equal texts once); the leaves of a text then meet in order, and neighbours are joined
pairwise, level by level.  A join keeps both sides' tokens but for a window around the seam, which is encoded anew: first a
small one, then larger ones, until its first and last tokens agree with those of the sides there.  Its ends are laid where a
word ends before a blank: there every text is cut before merges begin, whatever stands around, so the join is exact.

Text without such places (no blanks for thousands of characters) is joined inside the piece that the pre-tokenizer leaves unsplit, by
tokens: a window of k tokens of either side is merged anew, k doubling, until its first and last tokens equal the sides'.  A
sequence of tokens is the BPE encoding of its bytes if and only if each neighbouring pair is that of its own bytes, so this is exact as well.
Where the piece around the seam is none that both sides share, all of it is encoded anew.

Leaves and windows are encoded by ranks (tiktoken) where the file allows it: a byte-level vocabulary whose ids follow its merges, the
usual pre-tokenizer, special tokens without options.  Both libraries were compared over every code point.  Other files go through tokenizers.

Decoding maps ids to bytes and bytes to text (malformed UTF-8 becomes U+FFFD, as in the library).

Defined cases: null and empty texts have no tokens; repeated rows are encoded row by row; an empty table gives no rows; other columns
are carried only as `carry` says.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAF = 16_384
#: First window in characters of either side, and the size up from which text counts as unsplit.
WINDOW, UNSPLIT = 64, 4_096
#: Characters given to the encoder at once.
SLICE = 1 << 18
#: The pre-tokenizer's pattern, a fixed value of byte-level BPE files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A place before a blank and after a letter or digit of any script.
SURE = re.compile(r"(?<=[^\W_])(?=[ \n])")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes and decodes with a byte-level BPE file; one per process and path (see codec())."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = byte_alphabet()
        back = {c: b for b, c in enumerate(self.letters)}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.special = {t["id"]: t["content"] for t in file["added_tokens"]}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes: list[bytes] = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = self.special[i].encode() if i in self.special else bytes(back[c] for c in token)
        self.names = [str(i) for i in range(len(self.bytes))]
        self.ranked = self.by_rank(file)
        self.by_content = {c: i for i, c in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.by_content, key=len, reverse=True))) + ")") if self.special else None

    def by_rank(self, file: dict):
        """An encoder by ranks, None if the file asks for more than ranks say."""
        import tiktoken

        model, split = file["model"], file["pre_tokenizer"] or {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in merges]
        plain_model = file["normalizer"] is None and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        plain_split = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain_special = not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        ascending = ids == sorted(set(ids)) and len(ids) + 256 == len(self.bytes) - len(self.special)
        if not (plain_model and plain_split and plain_special and ascending):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in self.special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        if self.ranked is not None:
            yield from map(self.encode, texts)
            return
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE):
                size += len(texts[end])
                end += 1
            yield from (e.ids for e in self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False))
            at = end

    def encode(self, text: str) -> list[int]:
        if self.ranked is None:
            return self.tokenizer.encode(text, add_special_tokens=False).ids if text else []
        if self.cut is None or self.cut.search(text) is None:
            return self.ranked.encode_ordinary(text)
        out: list[int] = []
        for part in self.cut.split(text):
            out += [self.by_content[part]] if part in self.by_content else self.ranked.encode_ordinary(part)
        return out

    def merge(self, data: bytes) -> list[int]:
        """The tokens of bytes that the pre-tokenizer doesn't split."""
        return [t.id for t in self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, data)))]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")

    def split_last(self, ids: list[int], size: int) -> int:
        """How many tokens stand before the last `size` bytes."""
        i = len(ids)
        while size > 0:
            i -= 1
            size -= len(self.bytes[ids[i]])
        if size:
            raise AssertionError("a token lies across a place that splits text")
        return i

    def split_first(self, ids: list[int], size: int) -> int:
        i = 0
        while size > 0:
            size -= len(self.bytes[ids[i]])
            i += 1
        if size:
            raise AssertionError("a token lies across a place that splits text")
        return i

    def join(self, left: tuple[str, list[int]], right: tuple[str, list[int]]) -> tuple[str, list[int]]:
        (a, x), (b, y) = left, right
        size = WINDOW
        while True:
            low = max(0, len(a) - size)
            starts = [m.start() for m in SURE.finditer(a, low + 1, len(a) - 1)] if len(a) - low > 2 else []
            ends = [m.start() for m in SURE.finditer(b, 1, min(size, len(b) - 1))]
            begin = starts[0] if starts else 0 if size >= len(a) else None
            end = ends[-1] if ends else len(b) if size >= len(b) else None
            if begin is not None and end is not None:
                if len(a) - begin + end > UNSPLIT and (not starts or not ends):
                    return a + b, self.join_unsplit(a, x, b, y, begin, end)
                i, j = self.split_last(x, len(a[begin:].encode())), self.split_first(y, len(b[:end].encode()))
                middle = self.encode(a[begin:] + b[:end])
                agree = (begin == 0 or middle[:1] == x[i : i + 1]) and (end == len(b) or middle[-1:] == y[j - 1 : j])
                if agree or (size >= len(a) and size >= len(b)):
                    return a + b, x[:i] + middle + y[j:]
            size *= 2

    def join_unsplit(self, a: str, x: list[int], b: str, y: list[int], begin: int, end: int) -> list[int]:
        """The join of a window that is long because text around the seam has no sure places."""
        i, j = self.split_last(x, len(a[begin:].encode())), self.split_first(y, len(b[:end].encode()))
        u, v = a[begin:], b[:end]
        whole, seam = u + v, len(u)
        if any(s in whole for s in self.special.values()):
            return x[:i] + self.encode(whole) + y[j:]
        ends_of = lambda s: [0, *(e for _, (_, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(s))]
        p, pu, pv = ends_of(whole), ends_of(u), [seam + e for e in ends_of(v)]
        same = 0
        while same + 1 < min(len(p), len(pu)) and p[same + 1] == pu[same + 1] and p[same + 1] <= seam:
            same += 1
        lo, later = p[same], set(pv)
        k = next(k for k, e in enumerate(p) if e >= seam and e > lo and e in later) if seam < len(whole) else len(p) - 1
        hi = p[k]
        i2 = self.split_last(x, len(u[lo:].encode()))
        j2 = self.split_first(y, len(v[: hi - seam].encode()))
        one = k == same + 1 and lo < seam < hi and pu[-2] == lo and pv[1] == hi
        pieces = zip(p[same:k], p[same + 1 : k + 1], strict=True)  # one by one: what follows a piece has shaped it
        middle = self.join_tokens(x[i2:], y[:j2]) if one else [t for s, e in pieces for t in self.merge(whole[s:e].encode())]
        return x[:i2] + middle + y[j2:]

    def join_tokens(self, x: list[int], y: list[int]) -> list[int]:
        """Tokens of one unsplit piece whose parts have the tokens x and y."""
        k = 8
        while True:
            head, tail = x[-k:], y[:k]
            made = self.merge(b"".join(self.bytes[t] for t in head + tail))
            if (k >= len(x) or made[0] == head[0]) and (k >= len(y) or made[-1] == tail[-1]) and (len(made) > 1 or k >= max(len(x), len(y))):
                return x[: max(0, len(x) - k)] + made + y[k:]
            k *= 2

    def tree(self, nodes: list[tuple[str, list[int]]]) -> list[int]:
        while len(nodes) > 1:
            nodes = [self.join(nodes[i], nodes[i + 1]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0][1] if nodes else []


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(
    docs: DataFrame, path: str, finish: Callable[[Codec, list[int]], tuple], made: pa.Schema, made_sql: str, leaf: int = LEAF, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """docs' columns `keep` (none of them named as in `made`), and what finish makes of each text's ids, as `made` (in DDL: made_sql).

    Long texts are known by their SHA-256: equal ones are cut and encoded once, and a recomputed task names them alike.
    """
    source = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    at = len(keep)
    kept_sql = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(at))

    def out(keys: list, names: list[str], rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(made)
        return pa.RecordBatch.from_arrays([*keys, *(pa.array(list(c), t) for c, t in zip(columns, made.types, strict=True))], names=[*names, *made.names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for first in range(0, b.num_rows, 512):
                part = b.slice(first, 512)
                yield out(part.columns[:at], part.schema.names[:at], [finish(own, ids) for ids in own.encode_all(part.column(at).to_pylist())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                parts = [text[i : i + leaf] for i in range(0, len(text), leaf)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array([n] * n, pa.int32()), pa.array(parts)], names=["digest", "leaf", "leaves", "text"],
                )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in batches:
            for first in range(0, b.num_rows, 32):
                part = b.slice(first, 32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(own.encode_all(part.column(3).to_pylist())), pa.list_(pa.int32()))], names=[*part.schema.names, "ids"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        held: list[tuple[str, list[int]]] = []
        for b in batches:
            names, rows = [], []
            for name, place, n, text, ids in zip(*(b.column(i) for i in range(5)), strict=True):
                if place.as_py() != len(held):
                    raise ValueError("a leaf is missing")
                held.append((text.as_py(), ids.as_py()))
                if len(held) == n.as_py():
                    names.append(name.as_py())
                    rows.append(finish(own, own.tree(held)))
                    held = []
            if names:
                yield out([pa.array(names, pa.string())], ["digest"], rows)
        if held:
            raise ValueError("a leaf is missing")

    few = source.where(F.length("text") <= leaf).mapInArrow(short, f"{kept_sql}, {made_sql}")
    long = source.where(F.length("text") > leaf).withColumn("digest", F.sha2("text", 256))
    leaf_sql = "digest string, leaf int, leaves int, text string"
    leaves = long.select("digest", "text").mapInArrow(cut, leaf_sql).groupBy("digest", "leaf", "leaves").agg(F.first("text").alias("text"))
    tokens = leaves.mapInArrow(encoded, f"{leaf_sql}, ids array<int>")
    whole = tokens.repartition("digest").sortWithinPartitions("digest", "leaf").mapInArrow(joined, f"digest string, {made_sql}")
    several = long.drop("text").join(whole, "digest").drop("digest")
    return few.unionByName(several).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *made.names)


def digest(own: Codec, ids: list[int]) -> tuple:
    return len(ids), hashlib.sha256(",".join(map(own.names.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: one row per document."""
    made = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return encode_documents(table(spark, sf_dir, "documents"), default_path(), digest, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, n_tokens and ids array<int> of every row."""
    made = pa.schema([("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return encode_documents(docs, path, lambda own, ids: (len(ids), ids), made, "n_tokens long, ids array<int>", keep=keep)


def token_files(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row of docs, which come from files, in the files' order; the pipeline's last stage.

    The files' numbers and the rows' places in them are carried along, and the rows dealt back by number: partition i holds what part i held.
    """
    part = F.coalesce(F.try_to_number(F.regexp_extract("_metadata.file_name", r"part-([0-9]+)", 1), F.lit("9999999999")).cast("int"), F.lit(0))
    placed = docs.select("doc_id", "text", part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("place"))
    n = 1 + max((int(m[1]) for f in docs.inputFiles() if (m := re.search(r"part-([0-9]+)", f.rsplit("/", 1)[-1]))), default=0)
    tokens = token_documents(placed, path, ("doc_id", "part", "file", "place"))
    return tokens.repartitionById(n, F.col("part")).sortWithinPartitions("file", "place").select("doc_id", "n_tokens", "ids")
