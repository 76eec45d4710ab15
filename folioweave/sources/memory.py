"""The translation memory in buckets: versions of new rows beside each other, joined without a shuffle of the memory.

A memory is a folder with a table of (key, value), partitioned by version and bucketed by key, and a list of its versions.  An upsert writes only its own rows, as
a partition of a new version; nothing else is rewritten.  A version is read as the last whole one before it (`base`) and the rows since, the newest of each
key; since all versions have the same buckets, neither that nor a join by key shuffles the memory.  compact() writes a new whole version.  A version counts once
it is listed, after its rows are written: what a failed writer leaves is written over by the next one.  One writer at a time; readers keep the version they took.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

VERSIONS = "version bigint, base boolean, buckets int, source string"


class Memory:
    """The memory at path, made there if there is none; `buckets` holds for new ones: no fewer than the shuffle partitions, or Spark shuffles the memory to those."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"memory_{uuid.uuid4().hex}"
        first = self.versions().agg(F.first("buckets")).first()[0]
        self.buckets = first or buckets or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if first is None:
            self.commit(0, True, None)
        spark.sql(
            f"CREATE TABLE {self.name} (key STRING, value STRING, version BIGINT) USING parquet PARTITIONED BY (version)"
            f" CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{self.path}/rows'"
        )
        self.files(self.path).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows"))
        self.refresh()

    def files(self, path: str):  # noqa: ANN201
        """The file system that the path lies in."""
        return self.spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> DataFrame:
        """The list of versions: which are whole (base), and what wrote them (source)."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/versions")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def refresh(self) -> None:
        """Finds what other sessions have written."""
        self.spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def latest(self) -> int:
        return self.versions().agg(F.max("version")).first()[0]

    def written_by(self, source: str) -> int | None:
        """The version that the source has written, if it has."""
        return self.versions().where(F.col("source") == source).agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        """(key, value) as of a version; the latest, if none is given."""
        known = self.versions()
        if version is not None:
            known = known.where(F.col("version") <= version)
        last, base = known.agg(F.max("version"), F.max(F.when(F.col("base"), F.col("version")))).first()
        rows = self.spark.table(self.name).where(F.col("version").between(base, last))
        return rows.groupBy("key").agg(F.max_by("value", "version").alias("value"))

    def upsert(self, news: DataFrame, source: str | None = None) -> int:
        """Adds news(key, value, source, version) as a new version, whose number is returned.

        Values that equal their source aren't kept; of equal keys the greatest version wins, then the greatest value.  With a source, which may be given again after
        a failure, nothing is written twice.
        """
        done = self.written_by(source) if source else None
        if done is not None:
            return done
        fresh = news.where("value IS NOT NULL AND key IS NOT NULL AND NOT (value <=> source)").groupBy("key").agg(F.max_by("value", F.struct("version", "value")).alias("value"))
        return self.add(fresh, False, source)

    def compact(self) -> int:
        """Writes the latest version as a whole one; older ones stay readable.  Spark can't write to the table it reads, so the rows are set aside in between."""
        aside = f"{self.path}/aside-{uuid.uuid4().hex}"
        self.read().write.parquet(aside)
        try:
            return self.add(self.spark.read.schema("key string, value string").parquet(aside), True, None)
        finally:
            self.files(aside).delete(self.spark._jvm.org.apache.hadoop.fs.Path(aside), True)

    def add(self, rows: DataFrame, base: bool, source: str | None) -> int:
        version = self.latest() + 1
        view = f"{self.name}_news"
        rows.select("key", "value").repartition(self.buckets, "key").createOrReplaceTempView(view)
        try:
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (version = {version}) SELECT key, value FROM {view}")
        finally:
            self.spark.catalog.dropTempView(view)
        self.commit(version, base, source)
        return version

    def commit(self, version: int, base: bool, source: str | None) -> None:
        self.spark.createDataFrame([(version, base, self.buckets, source)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.path}/versions")

    def close(self) -> None:
        """Forgets the session's name of the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
