"""Folders of files as tables."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions import paths
from sedimenta.functions.text import decode_text

# root files whose raw text is tested by technology and audit rules, also when their suffix is not readable
MANIFESTS = (
    "package.json", "composer.json", "requirements.txt", "pyproject.toml", "Pipfile", "pom.xml", "build.gradle",
    "build.gradle.kts", "docker-compose.yml", "docker-compose.yaml",
)
BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
def _qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _located(df: DataFrame, base: str, many_projects: bool, column: str = "uri") -> DataFrame:
    """Add project and path below ``base``."""
    relative = F.substring(F.col(column), F.lit(len(base) + 2), F.length(column))
    if many_projects:
        inner = F.when(relative.contains("/"), relative)
        project = F.substring_index(inner, "/", 1)
        return df.withColumn("project", project).withColumn(
            "_below", F.substring(inner, F.length("project") + 2, F.length(inner))
        ).filter(F.col("project").isNotNull()).withColumn("path", F.col("_below")).drop("_below")
    return df.withColumn("project", F.lit(base.rsplit("/", 1)[-1])).withColumn("path", relative)


def _filesystem(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))


def _listing(infos) -> pd.DataFrame:
    rows = [(i.path, i.size, i.mtime) for i in infos if i.type == fs.FileType.File]
    return pd.DataFrame(rows, columns=["uri", "size", "mtime"]).astype({"size": "int64", "mtime": "datetime64[us, UTC]"})


def _walk(root: str):
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(root)
        for pdf in batches:
            for start in pdf["folder"]:
                yield _listing(store.get_file_info(fs.FileSelector(start, recursive=True)))

    return walk


def _load(root: str, chunk_bytes: int = 32 << 20):
    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, _ = _filesystem(root)

        def content(uri: str) -> tuple[bytes | None, str | None]:
            try:
                with store.open_input_stream(uri) as stream:
                    return stream.readall(), None
            except PermissionError:
                return None, "permission_denied"
            except Exception as e:  # noqa: BLE001 - an unreadable file is a row, not a failed job
                return None, str(e)

        for pdf in batches:
            # a chunk holds a bounded number of bytes, whatever the number of rows in the batch
            for _, part in pdf.groupby((pdf["size"].cumsum() // chunk_bytes).to_numpy()):
                loaded = [content(u) if wanted else (None, None) for u, wanted in zip(part["uri"], part["wanted"])]
                yield part.drop(columns="wanted").assign(
                    content=[c for c, _ in loaded], read_error=[e for _, e in loaded]
                )

    return load


def list_files(spark: SparkSession, root: str, many_projects: bool = False) -> DataFrame:
    """(project, path, size, mtime, uri) of every file below ``root``; file contents are not opened.

    Spark's own file sources hide names that start with ``.`` or ``_`` (``.env``, ``.github/``, ``__init__.py``), which the
    rules need to see, so folders are listed by tasks: the first level on the driver, one sub-folder per row from there.
    """
    store, base = _filesystem(checked_root(root))
    top = store.get_file_info(fs.FileSelector(base))
    folders = [(i.path,) for i in top if i.type == fs.FileType.Directory]
    schema = "uri string, size bigint, mtime timestamp"
    here = spark.createDataFrame([(i.path, i.size, i.mtime) for i in top if i.type == fs.FileType.File], schema)
    tasks = max(1, min(len(folders), 10 * spark.sparkContext.defaultParallelism))
    below = spark.createDataFrame(folders, "folder string").repartition(tasks, "folder").mapInPandas(_walk(root), schema)
    return _located(here.unionByName(below), base.rstrip("/"), many_projects).select("project", "path", "size", "mtime", "uri")


def read_files(spark: SparkSession, root: str, many_projects: bool = False, partitions: int | None = None) -> DataFrame:
    """files(project, path, size, mtime, content, read_error) of a folder, or of one project per sub-folder.

    Only files that some rule looks into are opened: readable by name, or one of the text-tested manifests. A file that
    cannot be opened is a row with a ``read_error``.
    """
    path = F.col("path")
    name = paths.file_name(path)
    manifest = path.isin(*MANIFESTS) | (name == "schema.prisma")
    wanted = manifest | (paths.skip_reason(path).isNull() & (paths.ignored_prefix(path) == ""))
    listed = list_files(spark, root, many_projects).withColumn("wanted", wanted)
    tasks = partitions or 4 * spark.sparkContext.defaultParallelism
    schema = "project string, path string, size bigint, mtime timestamp, uri string, content binary, read_error string"
    loaded = listed.repartition(tasks, "uri").mapInPandas(_load(root), schema)
    return loaded.select("project", "path", "size", "mtime", decode_text(F.col("content")).alias("content"), "read_error")


def stream_files(spark: SparkSession, root: str, many_projects: bool = False, max_files: int | None = None) -> DataFrame:
    """files rows as a stream of arriving files. The streaming source of Spark hides names starting with ``.`` or ``_``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_SCHEMA).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    raw = _located(reader.load(root).withColumnRenamed("path", "uri"), _qualified(spark, root), many_projects)
    return raw.select(
        "project", "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"),
        decode_text(F.col("content")).alias("content"),
    )


def checked_root(path: str) -> str:
    if not path or not path.strip():
        raise ValueError("a folder is required")
    return path


def corpus_source(df: DataFrame, project: str, path: Column, text: str) -> DataFrame:
    """Any text table as a files table."""
    return df.select(
        F.col(project).cast("string").alias("project"), paths.normalized(path).alias("path"),
        F.length(text).cast("bigint").alias("size"), F.lit(None).cast("timestamp").alias("mtime"), F.col(text).alias("content"),
    )
