"""Summaries kept between runs, so that only changed files are described again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import sha_key
from sedimenta.session import written

KEYS = ["project", "path_hash", "mode", "key"]
SCHEMA = "project string, path_hash string, mode string, key string, summary string"


def with_cache_key(files: DataFrame, mode: str) -> DataFrame:
    """Path hash, mode and a content-free key of path, size and modification time."""
    stamp = F.concat_ws(":", "path", F.col("size").cast("string"), F.coalesce(F.unix_micros("mtime").cast("string"), F.lit("0")))
    return files.withColumn("path_hash", sha_key(F.col("path"), 12)).withColumn("mode", F.lit(mode)).withColumn(
        "key", sha_key(stamp, 16)
    )


def incremental_changed(files: DataFrame, cache: DataFrame, mode: str) -> DataFrame:
    """Files without a valid cached summary. The key is unique per file, so no group is hot."""
    return with_cache_key(files, mode).join(cache.select(*KEYS), KEYS, "left_anti")


def cached_hits(files: DataFrame, cache: DataFrame, mode: str) -> DataFrame:
    return with_cache_key(files, mode).join(cache.select(*KEYS, "summary"), KEYS).select("project", "path", *KEYS[1:], "summary")


def refresh(files: DataFrame, cache: DataFrame, mode: str, describe: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Summaries of all files: cached where valid, else from ``describe`` (which adds ``summary``)."""
    fresh = describe(incremental_changed(files, cache, mode)).select("project", "path", *KEYS[1:], "summary")
    return cached_hits(files, cache, mode).unionByName(fresh)


# rows of a project are dealt into so many buckets by path hash
BUCKETS = 16
_PLACE = ["part", "bucket"]


class SummaryCache:
    """Cache table of Parquet files, partitioned by project and a bucket of the path hash.

    A save rewrites the buckets it touches and no others. The rewritten rows are first laid down complete in a folder
    beside the table; then they replace their buckets by Spark's dynamic partition overwrite, and the folder goes. A job
    that dies in between leaves the folder, and whoever reads or saves next finishes the replacement from it, so no
    cached row is lost. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self._buckets = spark, path.rstrip("/"), buckets
        # names with an underscore in front are no rows to Spark
        self._table, self._ahead = f"{self.path}/rows", f"{self.path}/_ahead"

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _exists(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def _remove(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    def _placed(self, rows: DataFrame) -> DataFrame:
        name = F.coalesce(F.concat(F.lit("="), "project"), F.lit(""))
        bucket = F.pmod(F.xxhash64("path_hash"), F.lit(self._buckets)).cast("int")
        return rows.select(*KEYS, "summary", F.substring(F.sha2(name, 256), 1, 16).alias("part"), bucket.alias("bucket"))

    def _rows(self) -> DataFrame:
        if not self._exists(self._table):
            return self._placed(self.spark.createDataFrame([], SCHEMA))
        return self.spark.read.schema(f"{SCHEMA}, part string, bucket int").parquet(self._table)

    def _finish(self) -> None:
        """Put rows that were laid down complete in place of their buckets; what is not complete was never promised."""
        if self._exists(f"{self._ahead}/_SUCCESS"):
            rows = self.spark.read.schema(f"{SCHEMA}, part string, bucket int").parquet(self._ahead)
            rows.repartition(*_PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACE).parquet(self._table)
        self._remove(self._ahead)

    def read(self) -> DataFrame:
        if self._exists(self._ahead):
            self._finish()
        return self._rows().select(*KEYS, "summary")

    def save(self, summaries: DataFrame) -> None:
        """Merge new rows; older keys of the same file and mode are dropped. Only buckets of new rows are read and rewritten."""
        self.read()
        new = written(self._placed(summaries), "cache-new")
        touched = new.select(*_PLACE).distinct()
        same = ["project", "path_hash", "mode"]
        old, met = self._rows().join(touched, _PLACE, "left_semi"), new.select(*same).distinct()
        on = [old[c].eqNullSafe(met[c]) for c in same]
        old.join(met, on, "left_anti").unionByName(new).write.mode("overwrite").parquet(self._ahead)
        self._finish()
        for path in new.inputFiles()[:1]:
            self._remove(path.rpartition("/")[0])

    def clear(self, projects: Sequence[str] | None = None) -> int:
        """Remove cached rows (of some projects or all) and return how many there were; other projects are not touched."""
        self.read()
        rows = self._rows()
        if projects is None:
            gone = rows.count()
            self._remove(self._table)
            return gone
        chosen = rows.filter(F.col("project").isin(*projects))
        counts = chosen.groupBy("part").count().collect()
        for r in counts:
            self._remove(f"{self._table}/part={r.part}")
        return sum(r["count"] for r in counts)
