"""Given tables, and the translation memory as versioned Parquet."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

MEMORY = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])


#: A union that counts as dealt out by a key, though adaptive execution has coalesced its sides apart, splits the groups of an aggregate above it (Spark 4.1).
UNIONS = "spark.sql.unionOutputPartitioning"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set(UNIONS, "false")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_memory(spark: SparkSession, path: str) -> DataFrame:
    """The translation memory at path; empty where there is none yet."""
    try:
        return spark.read.schema(MEMORY).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], MEMORY)


def upsert_memory(memory: DataFrame, news: DataFrame) -> DataFrame:
    """memory(key, value) with news(key, value, source, version): value differs from source; the greatest version wins.

    The winner is an aggregate, so equal keys meet map-side; write the result to a new version's folder.
    """
    fresh = news.where("value IS NOT NULL AND NOT (value <=> source)").groupBy("key").agg(F.max_by("value", F.struct("version", "value")).alias("value"))
    return memory.join(fresh, "key", "left_anti").select("key", "value").unionByName(fresh)


#: The layout tables that decoders of documents write, by name.
LAYOUT = {
    "spans": "doc_id bigint, page int, line_id int, span_no int, text string, font string, size double, color int, x0 double, y0 double, x1 double, y1 double",
    "rects": "doc_id bigint, page int, rect_no int, x0 double, y0 double, x1 double, y1 double, fill string",
    "rules": "doc_id bigint, page int, rule_no int, x0 double, y0 double, x1 double, y1 double",
    "images": "doc_id bigint, page int, xref int, px_w int, px_h int, x0 double, y0 double, x1 double, y1 double",
    "page_sizes": "doc_id bigint, page int, width double, height double",
}


def load_layout(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A layout table by its schema, whatever else the files hold; spans without a text, or outside a line, are no spans."""
    df = spark.read.schema(LAYOUT[name]).parquet(path)
    return df.where("text IS NOT NULL AND line_id IS NOT NULL AND text <> ''") if name == "spans" else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir; it is deleted when the process ends.

    Where the setting is missing and Spark is local, as in tests, it is a local one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def clear() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(clear)
    return path
