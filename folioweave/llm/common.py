"""What the operators of this subpackage share: tables, written intermediates, span lists."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Callable
from typing import ClassVar

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and Spark is local (as in tests), a fresh local folder, which goes with the process; the session's setting stays as it is.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return local_dir()


@functools.cache
def local_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-')}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder by the file system it lies in."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Owner of a job's written intermediates: one folder under the shared one, cleared by clear(), or when the process ends.

    drop() takes single intermediates that no later step reads; what a returned DataFrame still reads stays until the end.
    """

    live: ClassVar[list[Scratch]] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/folioweave/{name}-{uuid.uuid4().hex}"
        self.made: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
        Scratch.live.append(self)
        atexit.register(self.clear)

    def folder(self, name: str) -> str:
        """A new place under this owner's folder, for tables that are written bit by bit."""
        return f"{self.path}/{name}-{uuid.uuid4().hex[:8]}"

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """Cuts the lineage: df is written once, and read again from there.

        A lost executor then costs a re-read of files, not a recomputation; and joins see the true sizes.
        """
        path = self.folder(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.made[out] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = self.made.pop(df, None)
            if path is not None:
                remove(self.spark, path)

    def clear(self) -> None:
        """Deletes the whole folder; once the session is gone, only a local one can be reached."""
        atexit.unregister(self.clear)
        Scratch.live = [s for s in Scratch.live if s is not self]
        self.made.clear()
        try:
            if self.spark.sparkContext._jsc is not None:
                remove(self.spark, self.path)
                return
        except (Py4JError, OSError):  # the JVM has gone before
            pass
        if self.path.startswith("file:"):
            shutil.rmtree(self.path.removeprefix("file://"), ignore_errors=True)


def hashed_sample(df: DataFrame, keys: list[str], size: int, seed: int) -> DataFrame:
    """The `size` rows of df whose keys hash lowest (all, if there are no more), with the hash as `order`; for fits only.

    A cut on the hash, set from the count, leaves little more than the sample to sort, however many rows there are.
    """
    n = df.count()
    share = min(1.0, (size + 10 * size**0.5 + 100) / max(1, n))
    hashed = df.withColumn("order", F.xxhash64(*keys, F.lit(seed)))
    near = hashed.where(F.col("order") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    return near.orderBy("order", *keys).limit(size)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, for use inside higher-order functions."""
    return F.transform(F.array(value), body)[0]


#: Elements that a fold appends to one array; longer outputs are arrays of such blocks, so that a fold stays linear.
FOLD_BLOCK = 128


def stepped(state: Column, more: Column) -> Column:
    """What a step of fold_out gives: the next state, and an array to append."""
    return F.struct(state.alias("state"), more.alias("more"))


def fold_out(items: Column, state: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """struct<state, out> of a fold over items; step(state, item) gives the next state and an array<kind> to append to out, as stepped().

    Appending to an array copies it.  So each block of FOLD_BLOCK items has an array of its own, and the blocks are flattened at the end.
    """
    empty, blocks = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def within(acc: Column, x: Column) -> Column:
        return let(step(acc.state, x), lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, r.more).alias("out")))

    def over(xs: Column) -> Column:
        def block(acc: Column, k: Column) -> Column:
            part = F.aggregate(F.slice(xs, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), F.struct(acc.state.alias("state"), empty.alias("out")), within)
            return let(part, lambda r: F.struct(r.state.alias("state"), F.concat(acc.out, F.array(r.out)).alias("out")))

        first = F.struct(state.alias("state"), blocks.alias("out"))
        many = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / FOLD_BLOCK).cast("int")), first, block, lambda acc: F.struct(acc.state.alias("state"), F.flatten(acc.out).alias("out")))
        return F.when(F.size(xs) > 0, many).otherwise(F.struct(state.alias("state"), empty.alias("out")))

    return let(items, over)


# ---- spans: arrays of struct<start, end, rank, kind, value>, offsets in code points, end exclusive ----

SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"
MATCH = "struct<start:int,end:int,value:string,before:string>"


def span(start: Column, end: Column, rank: int, kind: str, value: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))


def last_characters(text: Column, n: int) -> Column:
    return F.substring(text, -n, n) if n else F.lit("")


def with_matches(df: DataFrame, text: str, patterns: dict[str, str], context: int = 0) -> DataFrame:
    """Adds for each (column, pattern) the array of its leftmost non-overlapping matches as struct<start, end, value, before>.

    The pieces between matches (split) and the matches (regexp_extract_all) give the offsets, by one fold; before holds the last
    `context` characters before a match.  Patterns must not match the empty string.  Time is linear in the matches.
    """
    df = df.withColumns({c: F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)) for c, p in patterns.items()})

    def located(c: str, p: str) -> Column:
        gaps = F.slice(F.split(F.col(text), p, -1), F.lit(1), F.size(c))
        pairs = F.zip_with(gaps, F.col(c), lambda gap, hit: F.struct(gap.alias("gap"), hit.alias("hit")))

        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + F.length(x.gap)
            end = begin + F.length(x.hit)
            before = last_characters(F.concat(s.tail, last_characters(x.gap, context)), context)
            tail = last_characters(F.concat(s.tail, last_characters(x.gap, context), last_characters(x.hit, context)), context)
            one = F.struct(begin.alias("start"), end.alias("end"), x.hit.alias("value"), before.alias("before"))
            return stepped(F.struct(end.alias("at"), tail.alias("tail")), F.array(one))

        found = fold_out(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), step, MATCH)
        return F.when(F.size(c) > 0, found.out).otherwise(F.expr(f"cast(array() as array<{MATCH}>)"))

    return df.withColumns({c: located(c, p) for c, p in patterns.items()})


def as_spans(matches: Column, rank: int, kind: str) -> Column:
    return F.transform(matches, lambda m: span(m.start, m.end, rank, kind, m.value))


def joined(spans: Column, by_kind: bool = False) -> Column:
    """kind:start:end of each span, comma-joined; by start and then kind, or by kind and then start."""
    keyed = F.transform(
        spans,
        lambda s: F.struct(*((s["rank"], s.start) if by_kind else (s.start, s["rank"])), s.end.alias("end"), s.kind.alias("kind")),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s.kind, *((s["start"], s.end)))), ",")


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """text with each maximal run of overlapping spans replaced by the mark; time is linear in the spans."""

    def step(s: Column, x: Column) -> Column:
        piece = F.array(F.struct(s["at"].alias("from"), x.start.alias("to")))
        more = F.when(x.start >= s["at"], piece).otherwise(F.expr("cast(array() as array<struct<from:int,to:int>>)"))
        return stepped(F.struct(F.greatest(s["at"], x.end).alias("at")), more)

    def join(pieces: Column) -> Column:
        """Pieces are cut from the text by blocks: a place in a string is found by walking to it."""

        def block(k: Column) -> Column:
            def cut(ps: Column) -> Column:
                begin, end = ps[0]["from"], F.element_at(ps, -1)["to"]
                return let(text.substr(begin + 1, end - begin), lambda part: F.array_join(F.transform(ps, lambda p: part.substr(p["from"] - begin + 1, p["to"] - p["from"])), mark))

            return let(F.slice(pieces, k * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK)), cut)

        return F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD_BLOCK).cast("int")), block), mark)

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"))))
    done = fold_out(ordered, F.struct(F.lit(0).alias("at")), step, "struct<from:int,to:int>")
    rest = lambda d: F.concat(d.out, F.array(F.struct(d["state"]["at"].alias("from"), F.length(text).alias("to"))))
    return F.when(F.size(spans) > 0, let(let(done, rest), join)).otherwise(text)


# ---- SQL of span lists: the same offsets, written with unnested matches and sums over windows ----


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def matches_sql(patterns: dict[str, tuple[int, str]], source: str = "docs") -> str:
    """SELECT rid, rank, kind, i, value, start, "end" of the leftmost non-overlapping matches of each kind's (rank, pattern)."""
    each = " UNION ALL ".join(
        f"SELECT rid, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(text, {quoted(p)}) AS v, string_split_regex(text, {quoted(p)}) AS g FROM {source}" for kind, (rank, p) in patterns.items()
    )
    return f"""SELECT rid, rank, kind, i, value, stop - length(value) AS start, stop AS "end" FROM (
  SELECT *, (sum(length(gap) + length(value)) OVER (PARTITION BY rid, rank ORDER BY i))::BIGINT AS stop FROM (SELECT rid, rank, kind, i, v[i] AS value, g[i] AS gap FROM ({each}), unnest(range(1, len(v) + 1)) AS u(i)))"""


def joined_sql(where: str, order: str) -> str:
    return f"""coalesce(string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY {order}) FILTER ({where}), '')"""
